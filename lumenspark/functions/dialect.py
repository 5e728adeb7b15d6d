"""Expression text for Spark SQL, and its rendering for the oracle's SQL.

Text is Spark SQL but for two marks: `` DIV `` is integer division and ``ROUND_EVEN(x)`` rounds halves to even.
Numbers are written with an exponent, which both engines read as double.
"""

from __future__ import annotations


def n(value: float) -> str:
    text = repr(float(value))
    return text if "e" in text else f"{text}e0"


def spark_text(sql: str) -> str:
    return sql.replace(" DIV ", " div ").replace("ROUND_EVEN(", "bround(")


def duck_text(sql: str) -> str:
    return sql.replace(" DIV ", " // ").replace("ROUND_EVEN(", "round_even(")


def chain(steps: list[tuple[str, str]]) -> str:
    """A query of named steps; the last one is the result."""
    *first, (_, last) = steps
    return ("WITH " + ",\n".join(f"{name} AS ({sql})" for name, sql in first) + "\n" if first else "") + last


def clamp(x: str, low: float = 0.0, high: float = 1.0) -> str:
    return f"greatest({n(low)}, least({n(high)}, {x}))"


def rounded(x: str, digits: int) -> str:
    """Halves upwards, by the same arithmetic in both engines (their ``round`` differs in ties)."""
    k = n(10.0**digits)
    return f"(floor(({x}) * {k} + 0.5e0) / {k})"


def r6(x: str) -> str:
    return rounded(x, 6)
