"""Steps of exposure brackets of a given number of frames: motion mask, sampling, normal equations of the response, radiance.

The frames of a pixel come together in one row by one grouping, so all that follows are projections and small windows.
"""

from __future__ import annotations

from collections.abc import Callable

from ..functions import pixel as px
from ..functions.dialect import n
from .steps import KEYS, RGB

#: Share of motion from which a pixel counts as static.
STATIC = 0.6


def framed(source: str = "bracket", count: int = 3) -> tuple[str, str]:
    """Columns r0, g0, b0, l0 (logarithm of the exposure) and so on for each frame."""
    columns = [f"max(CASE frame WHEN {f} THEN {c} END) AS {k}{f}" for f in range(count) for c, k in (*((c, c) for c in RGB), ("loge", "l"))]
    return "framed", f"SELECT {KEYS}, {', '.join(columns)} FROM {source} GROUP BY {KEYS}"


def _light(f: int) -> str:
    return f"({px.luma(*(f'{c}{f}' for c in RGB))} / 255.0e0)"


def scene(count: int = 3) -> tuple[str, str]:
    """scene: average luminance of the frames of each image, from 0 to 1."""
    return "scene", f"SELECT image_id, greatest(0.0e0, least(1.0e0, avg(({' + '.join(_light(f) for f in range(count))}) / {n(count)}))) AS scene FROM framed GROUP BY image_id"


def motion_alpha(strength: float) -> float:
    """Of a motion strength from 1 to 100; nothing counts as motion at 0 or below."""
    return max(1.0, min(100.0, strength)) * 0.12 if strength > 0 else 0.0


def masked(alpha: float, count: int = 3) -> tuple[str, str]:
    """m: the product over frames of exp(-difference to the reference frame) to the third."""
    terms = " + ".join(f"abs({_light(f)} / exp(l{f} - l0) - {_light(0)})" for f in range(1, count))
    return "masked", f"SELECT *, exp(-3.0e0 * {n(alpha)} * ({terms})) AS m FROM framed"


def merged(response: Callable[[str, str], str], count: int = 3, carried: str = "") -> list[tuple[str, str]]:
    """Radiance: weighted means over frames of ``response(channel, level)`` less the exposure; the darkest frame without weights.  ``carried``: further
    columns, each with a comma behind."""
    gate = f"CASE WHEN m > {n(STATIC)} THEN 1.0e0 ELSE 0.0e0 END"
    weights = ", ".join(f"least({', '.join(px.hat_weight(f'{c}{f}') for c in RGB)}) * {gate if f else '1.0e0'} AS w{f}" for f in range(count))
    total = " + ".join(f"w{f}" for f in range(count))
    least = f"least({', '.join(f'l{f}' for f in range(count))})"

    def channel(c: str) -> str:
        light = [f"({response(c, f'{c}{f}')} - l{f})" for f in range(count)]
        darkest = "CASE " + " ".join(f"WHEN l{f} = {least} THEN {light[f]}" for f in range(count)) + " END"
        return f"exp(CASE WHEN {total} > 0.0e0 THEN ({' + '.join(f'{light[f]} * w{f}' for f in range(count))}) / ({total}) ELSE {darkest} END) AS {c}"

    return [("weighted", f"SELECT *, {weights} FROM masked"), ("merged", f"SELECT {KEYS}, {carried}{', '.join(channel(c) for c in RGB)} FROM weighted")]


def sample(total: int) -> list[tuple[str, str]]:
    """``total`` static pixels of each image, by quotas of 64 bins of luminance in the order of a hash.  Bins that hold less than
    their share leave places, which the other static pixels of the image fill in the same order."""
    place = "((cast(x AS bigint) * cast(73856093 AS bigint) + cast(y AS bigint) * cast(19349663 AS bigint) + cast(42 AS bigint) * cast(83492791 AS bigint)) % cast(1000003 AS bigint))"
    share = f"{total} DIV 64 + CASE WHEN bin < {total % 64} THEN 1 ELSE 0 END"
    return [
        ("static", f"SELECT *, cast(floor({_light(0)} * 63.0e0) AS int) AS bin, {place} AS h FROM masked WHERE m > {n(STATIC)}"),
        ("ranked", "SELECT *, row_number() OVER (PARTITION BY image_id, bin ORDER BY h, y, x) AS rk FROM static"),
        ("quota", f"SELECT *, CASE WHEN rk <= {share} THEN 0 ELSE 1 END AS later FROM ranked WHERE rk <= {total}"),
        ("filled", "SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY later, h, y, x) AS place FROM quota"),
        ("sample", f"SELECT * FROM filled WHERE place <= {total}"),
    ]


def normal_equations(count: int = 3) -> list[tuple[str, str]]:
    """Cells (image_id, channel, z, zz, v) of each sampled pixel's share, its own exposure eliminated; zz = -1: right side."""
    each = range(count)

    def of(i: str, column: str) -> str:
        return f"(CASE {i} {' '.join(f'WHEN {f} THEN {column}{f}' for f in each)} END)"

    def numbers(column: str, values) -> str:
        return " UNION ALL ".join(f"SELECT {v} AS {column}" for v in values)

    levels = ", ".join(f"CASE channel {' '.join(f'WHEN {k} THEN {c}{f}' for k, c in enumerate(RGB))} END AS z{f}" for f in each)
    squares = ", ".join(f"({px.hat_weight(f'z{f}')}) * ({px.hat_weight(f'z{f}')}) AS w{f}" for f in each)
    wi, wj = of("i", "w"), of("j", "w")
    value = f"CASE WHEN j = -1 THEN {wi} * {of('i', 'l')} - {wi} * sl / s WHEN i = j THEN {wi} - {wi} * {wi} / s ELSE -{wi} * {wj} / s END"
    return [
        ("channels", numbers("channel", range(3))),
        ("channelled", f"SELECT {KEYS}, channel, {levels}, {', '.join(f'l{f}' for f in each)} FROM sample CROSS JOIN channels"),
        ("squares", f"SELECT *, {squares} FROM channelled"),
        ("totals", f"SELECT *, {' + '.join(f'w{f}' for f in each)} AS s, {' + '.join(f'w{f} * l{f}' for f in each)} AS sl FROM squares"),
        ("places", f"SELECT i, j FROM ({numbers('i', each)}) p CROSS JOIN ({numbers('j', range(-1, count))}) q"),
        ("cells", f"SELECT image_id, channel, {of('i', 'z')} AS z, CASE WHEN j = -1 THEN -1 ELSE {of('j', 'z')} END AS zz, {value} AS v FROM totals CROSS JOIN places"),
    ]
