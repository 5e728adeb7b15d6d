"""Secret scans in DataFrame operations.

Base kinds are patterns.  The method adds spans: candidate strings (runs of characters that keys are made of) are swept by a
window of fixed width, once for each character class; the Shannon entropy of the window follows from incremental counts (one
character leaves, one enters), and a candidate with a window above the threshold is a span, unless the allow-list knows it.

Entropy is kept as a sum of integers: with counts c of a window of width w the entropy is log2(w) - sum(c log2 c) / w, and
c log2 c is a table of integers (millionths), so results do not depend on the order of additions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Kinds in the order in which they are listed; the last two are the method's.
KINDS = ["assign", "access", "hex", "entropy_hex", "entropy_mixed"]

ASSIGN = r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
LEAST_VALUE = 6

#: Window in characters; the entropies (in bits) that a window needs, by class.
WIDTH = 20
CLASSES = {"entropy_hex": (r"[0-9a-fA-F]{20,}", 3.0), "entropy_mixed": (r"[A-Za-z0-9+/_=-]{20,}", 3.7)}
#: Harmless strings: digits only, letters only (long words), one letter case with punctuation (slugs), uuids, placeholders.
ALLOWED = [r"^[0-9]+$", r"^[A-Za-z/_=+-]+$", r"^[a-z0-9/_=-]*[a-z]{12,}[a-z0-9/_=-]*$", r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$", r"(?i)(example|sample|placeholder|dummy|changeme|xxxxx)"]
#: Written in the place of a secret.
MARK = "[SECRET]"

_SCALE = 1_000_000
_TABLE = [0, *(round(c * math.log2(c) * _SCALE) for c in range(1, WIDTH + 1))]


def least_sum(bits: float) -> int:
    """The largest sum of c log2 c that a window with this entropy has."""
    return math.floor((math.log2(WIDTH) - bits) * WIDTH * _SCALE)


def _running(lengths: str) -> Column:
    """Sums of the elements before each: in chunks, so that long arrays cost little more than in proportion."""
    size = 256
    return F.expr(f"""
        flatten(transform(
            aggregate(
                transform(sequence(0, (size({lengths}) - 1) div {size}), k -> slice({lengths}, k * {size} + 1, {size})),
                cast(array() as array<struct<o: int, c: array<int>>>),
                (acc, c) -> concat(acc, array(struct(
                    case when size(acc) = 0 then 0 else acc[size(acc) - 1].o + aggregate(acc[size(acc) - 1].c, 0, (s, v) -> s + v) end as o, c as c)))),
            x -> slice(aggregate(x.c, array(x.o), (acc, v) -> concat(acc, array(acc[size(acc) - 1] + v))), 1, size(x.c))))""")


def _running_max(values: str) -> str:
    """The greatest of the elements up to each, in chunks as ``_running``."""
    size = 256
    return f"""
        flatten(transform(
            aggregate(
                transform(sequence(0, (size({values}) - 1) div {size}), k -> slice({values}, k * {size} + 1, {size})),
                cast(array() as array<struct<o: int, c: array<int>>>),
                (acc, c) -> concat(acc, array(struct(if(size(acc) = 0, -1, greatest(acc[size(acc) - 1].o, array_max(acc[size(acc) - 1].c))) as o, c as c)))),
            x -> slice(aggregate(x.c, array(x.o), (acc, v) -> concat(acc, array(greatest(acc[size(acc) - 1], v)))), 2, size(x.c))))"""


def _matches(df: DataFrame, pattern: str, out: str, group: int = 0) -> DataFrame:
    """Column ``out``: structs s, e, v (start, end in code points; the group's text) of all matches in ``__t``.

    Arrays are arguments of their functions, not read inside a lambda: a column that a lambda reads once would be put in
    its place and computed for each element.
    """
    literal = F.lit(pattern)
    carried = [c for c in df.columns]
    whole = F.regexp_extract_all("__t", literal, F.lit(0))
    step = df.select(*carried, F.when(F.col("__t").rlike(pattern), whole).alias("__m"))
    step = step.select(*carried, "__m", F.when(F.col("__m").isNotNull(), F.split("__t", pattern, -1)).alias("__p"), (F.when(F.col("__m").isNotNull(), F.regexp_extract_all("__t", literal, F.lit(group))) if group else F.col("__m")).alias("__v"))
    step = step.select(*carried, "__m", "__v", F.expr("flatten(zip_with(slice(__p, 1, size(__m)), __m, (p, m) -> array(length(p), length(m))))").alias("__n"))
    step = step.select(*carried, "__m", "__v", F.when(F.col("__n").isNotNull(), _running("__n")).alias("__b"))
    return step.select(*carried, F.coalesce(F.expr("transform(arrays_zip(__m, __v), (x, i) -> struct(__b[2 * i + 1] as s, __b[2 * i + 1] + length(x.__m) as e, x.__v as v))"), F.expr("cast(array() as array<struct<s: int, e: int, v: string>>)")).alias(out))


def _windowed(value: str, bits: float) -> str:
    """Has a window of this string at least this entropy?  Counts are a map from characters; each step moves two of them."""
    table = "array(" + ",".join(f"{v}L" for v in _TABLE) + ")"
    count = "coalesce(acc.m[{0}], 0)"
    gone, come = f"c[i - {WIDTH + 1}]", "c[i - 1]"
    drop = "map_concat(map_filter({m}, (k, w) -> k <> {x}), map({x}, {n}))"
    removed = f"if(i > {WIDTH}, {drop.format(m='acc.m', x=gone, n=f'{count.format(gone)} - 1')}, acc.m)"
    lost = f"if(i > {WIDTH}, {table}[{count.format(gone)}] - {table}[{count.format(gone)} - 1], 0L)"
    step1 = f"transform(array(struct({removed} as m, acc.s - {lost} as s, acc.best as best)), a -> "
    n = f"coalesce(a.m[{come}], 0)"
    total = f"a.s + {table}[{n} + 1] - {table}[{n}]"
    step2 = f"struct({drop.format(m='a.m', x=come, n=f'{n} + 1')} as m, {total} as s, if(i >= {WIDTH}, least(a.best, {total}), a.best) as best))[0]"
    start = f"struct(cast(map() as map<string, int>) as m, 0L as s, {1 << 60}L as best)"
    return f"transform(array(split({value}, '')), c -> aggregate(sequence(1, size(c)), {start}, (acc, i) -> {step1}{step2}, acc -> acc.best <= {least_sum(bits)}L))[0]"


def spans(docs: DataFrame, text: Column, keep: list[str]) -> DataFrame:
    """``keep`` and ``found``: an array of structs s, e, k (place of the kind in KINDS), by start and kind.

    A null or empty text has no spans.  A span of the method is left out where a base span, or, for the mixed class, one of the
    hexadecimal class holds all of it; one that reaches beyond stays beside the other.
    """
    step = docs.select(*keep, F.coalesce(text, F.lit("")).alias("__t"))
    step = _matches(step, ASSIGN, "__assign", 1)
    step = _matches(step, ACCESS, "__access")
    step = _matches(step, HEX, "__hex")
    for kind, (pattern, bits) in CLASSES.items():
        step = _matches(step, pattern, f"__{kind}")
        step = step.withColumn(f"__{kind}", F.expr(f"filter(__{kind}, x -> {' and '.join(f'not x.v rlike {_quoted(a)}' for a in ALLOWED)} and {_windowed('x.v', bits)})"))
    base = {k: "filter(__assign, x -> length(x.v) >= " + str(LEAST_VALUE) + ")" if k == "assign" else f"__{k}" for k in KINDS[:3]}
    named = lambda source, i: F.expr(f"transform({source}, x -> struct(x.s as s, x.e as e, {i} as k))")
    step = step.select(*keep, "__t", *[named(base[k], i).alias(f"__{k}") for i, k in enumerate(KINDS[:3])], *[named(f"__{k}", i).alias(f"__{k}") for i, k in enumerate(KINDS[3:], 3)])
    for i, k in enumerate(KINDS[3:], 3):
        for other in KINDS[:i]:
            step = step.withColumn(f"__{k}", F.expr(_beyond(f"__{k}", f"__{other}")))
    return step.select(*keep, "__t", F.expr(f"transform(array_sort(transform(concat({', '.join(f'__{k}' for k in KINDS)}), x -> struct(x.s as s, x.k as k, x.e as e))), x -> struct(x.s as s, x.e as e, x.k as k))").alias("found"))


def _beyond(own: str, others: str) -> str:
    """Those of the spans ``own`` that none of ``others`` holds; spans of either don't overlap and are sorted.

    Starts of both are sorted together, those of ``others`` first among equals: a span's place less the number of spans of its own before it
    is the number of others that begin no later, and the last of these is the only one that can hold it.
    """
    places = f"filter(transform(array_sort(concat(transform({others}, b -> struct(b.s as s, 0 as t)), transform({own}, x -> struct(x.s as s, 1 as t)))), (v, i) -> if(v.t = 1, i, -1)), i -> i >= 0)"
    return f"transform(array(struct({others} as b, {places} as p)), q -> filter({own}, (x, j) -> coalesce(get(q.b, get(q.p, j) - j - 1).e < x.e, true)))[0]"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _joined(where: str) -> Column:
    names = "array(" + ",".join(f"'{k}'" for k in KINDS) + ")"
    return F.expr(f"array_join(transform(filter(found, x -> {where}), x -> concat({names}[x.k], ':', x.s, ':', x.e)), ',')")


def secrets(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_assign, n_access, n_hex, base_sha256 and spans of every document; rows stay one to one, also repeated ones;
    a null text counts as empty; an empty table gives no rows; other columns aren't read."""
    found = spans(docs.select(docs[key].alias("__key"), docs[text].alias("__text")), F.col("__text"), ["__key"])
    counts = [F.expr(f"cast(size(filter(found, x -> x.k = {i})) as long)").alias(f"n_{k}") for i, k in enumerate(KINDS[:3])]
    return found.select(F.col("__key").alias(key), *counts, common.digest(_joined("x.k < 3")).alias("base_sha256"), _joined("true").alias("spans"))


def redacted(docs: DataFrame, text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """``docs`` with every span replaced by ``MARK`` (overlapping spans by one), and ``length`` set where a text changed.

    Null and empty texts stay as they are; rows stay one to one, repeated ones too; an empty table gives an empty one; names of
    other columns may be any."""
    columns = docs.columns
    named = docs.select(*[docs[c].alias(f"__c{i}") for i, c in enumerate(columns)])
    keep = named.columns
    at = columns.index(text)
    found = spans(named, F.col(keep[at]), keep)
    # a union of overlapping spans begins where a span begins no sooner than all before it end; ends so far are running maxima
    begins = "filter(transform(q.f, (x, i) -> if(i = 0 or x.s >= q.m[i - 1], i, -1)), i -> i >= 0)"
    union = "transform(r.g, (i, n) -> struct(q.f[i].s as s, q.m[coalesce(get(r.g, n + 1), size(q.f)) - 1] as e))"
    merged = f"transform(array(struct(found as f, {_running_max('transform(found, x -> x.e)')} as m)), q -> transform(array(struct({begins} as g)), r -> {union})[0])[0]"
    step = found.select(*keep, "__t", F.when(F.size("found") > 0, F.expr(merged)).alias("__u"))
    rest = f"""concat(array_join(transform(__u, (x, i) -> concat(substring(__t, if(i = 0, 0, __u[i - 1].e) + 1, x.s - if(i = 0, 0, __u[i - 1].e)), '{MARK}')), ''),
        substring(__t, __u[size(__u) - 1].e + 1, length(__t)))"""
    step = step.select(*keep, F.when(F.col("__u").isNotNull(), F.expr(rest)).alias("__new"))
    out = []
    for name, c in zip(columns, keep, strict=True):
        if name == text:
            out.append(F.coalesce(F.col("__new"), F.col(c)).alias(name))
        elif name == length:
            out.append(F.when(F.col("__new").isNotNull(), F.length("__new").cast(docs.schema[name].dataType)).otherwise(F.col(c)).alias(name))
        else:
            out.append(F.col(c).alias(name))
    return step.select(*out)
