"""Steps of alignment: pyramids, threshold bitmaps in packed words, shift scores, search of shifts and angles, resampling.

A shift (dx, dy) moves the candidate onto the reference: reference (x, y) is candidate (x - dx, y - dy).  Bitmaps are packed into
words of 32 pixels of a row, so the 81 shifts of a search multiply words and not pixels, and a join on rows compares them.
"""

from __future__ import annotations

import math

from ..functions.dialect import n, rounded
from .steps import KEYS, RGB, downsample, threshold_bitmap

WORD, RADIUS, LEAST_SIDE = 32, 4, 64
#: Angles in tenths of a degree: bound, steps of the coarse and of the fine search; levels that the search of angles looks at.
BOUND, COARSE, SEARCHED = 30, 10, 2


def cos(degrees: float) -> float:
    return math.cos(math.radians(degrees))


def sin(degrees: float) -> float:
    return math.sin(math.radians(degrees))


def sizes(w: int, h: int) -> list[tuple[int, int]]:
    """Sizes of the levels, halved while both sides are long enough."""
    out = [(w, h)]
    while out[-1][0] >= LEAST_SIDE and out[-1][1] >= LEAST_SIDE:
        out.append((out[-1][0] // 2, out[-1][1] // 2))
    return out


def levels(w: int, h: int) -> int:
    return len(sizes(w, h))


def pyramid(source: str, w: int, h: int, name: str) -> list[tuple[str, str]]:
    first = [(f"{name}0", f"SELECT {KEYS}, v, valid, w, h FROM {source}")]
    return first + [step for k in range(1, levels(w, h)) for step in downsample(f"{name}{k - 1}", f"{name}{k}")]


def tiles(source: str, name: str) -> list[tuple[str, str]]:
    """Words of the bits and masks of each row."""
    packed = ", ".join(f"cast(sum(CASE WHEN {c} = 1 THEN place ELSE 0 END) AS bigint) AS {c}" for c in ("bit", "mask"))
    return [
        (f"{name}_placed", f"SELECT image_id, y, x DIV {WORD} AS t, bit, mask, cast(pow(2.0e0, x % {WORD}) AS bigint) AS place FROM {source}"),
        (name, f"SELECT image_id, y, t, {packed} FROM {name}_placed GROUP BY image_id, y, t"),
    ]


def _numbers(column: str, values) -> str:
    return " UNION ALL ".join(f"SELECT {v} AS {column}" for v in values)


def scores(reference: str, candidate: str, pairs: str, name: str, radius: int = RADIUS) -> list[tuple[str, str]]:
    """Mismatching and valid pixels for each shift about the centre of each pair (image_id, ref_id, cx, cy).

    A moved word falls into two words of the reference's grid, whose overlaps are counted one by one.
    """
    near = range(-radius, radius + 1)
    full = 2**WORD
    half = lambda c: f"CASE part WHEN 0 THEN ({c} * power) % {full} ELSE ({c} * power) DIV {full} END AS {c}"
    return [
        (f"{name}_near", _numbers("d", near)),
        (f"{name}_parts", _numbers("part", (0, 1))),
        (f"{name}_shifts", f"SELECT p.image_id, p.ref_id, p.cx, p.cy, p.cx + a.d AS dx, p.cy + b.d AS dy FROM {pairs} p CROSS JOIN {name}_near a CROSS JOIN {name}_near b"),
        (f"{name}_powers", f"SELECT *, cast(floor(dx / {WORD}.0e0) AS int) AS words, cast(pow(2.0e0, ((dx % {WORD}) + {WORD}) % {WORD}) AS bigint) AS power FROM {name}_shifts"),
        (f"{name}_moved", f"SELECT s.image_id, ref_id, cx, cy, dx, dy, c.y + dy AS y, c.t + words + part AS t, {half('bit')}, {half('mask')} FROM {name}_powers s JOIN {candidate} c ON s.image_id = c.image_id CROSS JOIN {name}_parts"),
        (name, f"SELECT m.image_id, m.ref_id, m.cx, m.cy, m.dx, m.dy, cast(coalesce(sum(bit_count(((m.bit + r.bit - 2 * (m.bit & r.bit)) & m.mask) & r.mask)), 0) AS bigint) AS mismatch, cast(coalesce(sum(bit_count(m.mask & r.mask)), 0) AS bigint) AS valid FROM {name}_moved m LEFT JOIN {reference} r ON m.ref_id = r.image_id AND m.y = r.y AND m.t = r.t GROUP BY m.image_id, m.ref_id, m.cx, m.cy, m.dx, m.dy"),
    ]


def best(source: str, pairs: str, name: str) -> list[tuple[str, str]]:
    """The first least share of mismatches by dy, then dx; where nothing overlaps, the centre with no mismatch."""
    order = "CASE WHEN valid = 0 THEN 1.0e300 ELSE mismatch / cast(valid AS double) END, dy, dx"
    return [
        (f"{name}_ranks", f"SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY {order}) AS rk FROM {source}"),
        (name, f"SELECT image_id, ref_id, CASE WHEN valid = 0 THEN cx ELSE dx END AS dx, CASE WHEN valid = 0 THEN cy ELSE dy END AS dy, CASE WHEN valid = 0 THEN 0 ELSE mismatch END AS mismatch, CASE WHEN valid = 0 THEN 1 ELSE valid END AS valid FROM {name}_ranks WHERE rk = 1"),
    ]


def _bitmaps(source: str, count: int, name: str, first: int = 0) -> list[tuple[str, str]]:
    return [step for k in range(first, count) for step in (*threshold_bitmap(f"{source}{k}", f"{name}{k}_bits"), *tiles(f"{name}{k}_bits", f"{name}{k}"))]


def _descent(reference: str, candidate: str, pairs: str, name: str, top: int, bottom: int) -> list[tuple[str, str]]:
    """From the coarsest level to the finest one that is looked at; each level starts from twice the shift before."""
    out: list[tuple[str, str]] = []
    for k in range(top, bottom - 1, -1):
        if k < top:
            out.append((f"{name}_pairs{k}", f"SELECT image_id, ref_id, 2 * dx AS cx, 2 * dy AS cy FROM {name}_best{k + 1}"))
            pairs = f"{name}_pairs{k}"
        out += [*scores(f"{reference}{k}", f"{candidate}{k}", pairs, f"{name}_scores{k}"), *best(f"{name}_scores{k}", pairs, f"{name}_best{k}")]
    return out


def translation(reference: str, candidate: str, w: int, h: int) -> list[tuple[str, str]]:
    """``translation``: image_id, dx, dy and the share of mismatches of the shift that is found from coarse to fine."""
    count = levels(w, h)
    return [
        *pyramid(reference, w, h, "ref_level"), *pyramid(candidate, w, h, "cand_level"),
        *_bitmaps("ref_level", count, "ref_words"), *_bitmaps("cand_level", count, "cand_words"),
        ("tr_pairs", "SELECT DISTINCT image_id, image_id AS ref_id, 0 AS cx, 0 AS cy FROM cand_level0"),
        *_descent("ref_words", "cand_words", "tr_pairs", "tr", count - 1, 0),
        ("translation", "SELECT image_id, dx, dy, mismatch / cast(valid AS double) AS score FROM tr_best0"),
    ]


def _sampled_at(c: str, s: str, w: int, h: int, x: str = "x", y: str = "y") -> tuple[str, str]:
    cx, cy = n((w - 1) / 2), n((h - 1) / 2)
    return f"({c} * ({x} - {cx}) + {s} * ({y} - {cy}) + {cx})", f"({c} * ({y} - {cy}) - {s} * ({x} - {cx}) + {cy})"


def turned(x: str, y: str, degrees: float, w: int, h: int) -> str:
    """ny, nx: the nearest pixel from which an image turned about its centre takes (x, y)."""
    sx, sy = _sampled_at(n(cos(degrees)), n(sin(degrees)), w, h, x, y)
    return f"cast(ROUND_EVEN({rounded(sy, 9)}, 0) AS int) AS ny, cast(ROUND_EVEN({rounded(sx, 9)}, 0) AS int) AS nx"


def rotation(reference: str, candidate: str, w: int, h: int) -> list[tuple[str, str]]:
    """``transform``: image_id, dx, dy, angle, score: whole degrees, then tenths about the best, on the two coarsest levels;
    the shift at the chosen angle through all levels.  A turned image is a candidate of its own: image_id * 100 + angle."""
    count, size = levels(w, h), sizes(w, h)
    bottom = max(0, count - SEARCHED)
    angles = " UNION ALL ".join(f"SELECT {k} AS k, {n(cos(k / 10))} AS c, {n(sin(k / 10))} AS s" for k in range(-BOUND, BOUND + 1))
    out = [*pyramid(reference, w, h, "ref_level"), *pyramid(candidate, w, h, "cand_level"), *_bitmaps("ref_level", count, "ref_words"), ("angles", angles)]

    def searched(asked: str, name: str, last: int) -> list[tuple[str, str]]:
        """``name``: image_id, k, dx, dy (of level 0), score for the images and angles (image_id, k, c, s) that are asked for."""
        steps: list[tuple[str, str]] = []
        for level in range(count - 1, last - 1, -1):
            sx, sy = _sampled_at("c", "s", *size[level])
            steps += [
                (f"{name}_near{level}", f"SELECT g.image_id, k, y, x, cast(ROUND_EVEN({rounded(sy, 9)}, 0) AS int) AS ny, cast(ROUND_EVEN({rounded(sx, 9)}, 0) AS int) AS nx FROM cand_level{level} g JOIN {asked} a ON g.image_id = a.image_id"),
                (f"{name}_turned{level}", f"SELECT p.image_id * 100 + p.k + 50 AS image_id, p.y, p.x, coalesce(g.v, 0) AS v, coalesce(g.valid, 0) AS valid FROM {name}_near{level} p LEFT JOIN cand_level{level} g ON p.image_id = g.image_id AND p.ny = g.y AND p.nx = g.x"),
            ]
        steps += _bitmaps(f"{name}_turned", count, f"{name}_words", last)
        steps.append((f"{name}_pairs", f"SELECT image_id * 100 + k + 50 AS image_id, image_id AS ref_id, 0 AS cx, 0 AS cy FROM {asked}"))
        steps += _descent("ref_words", f"{name}_words", f"{name}_pairs", name, count - 1, last)
        steps.append((name, f"SELECT ref_id AS image_id, cast(image_id - ref_id * 100 - 50 AS int) AS k, dx * {2**last} AS dx, dy * {2**last} AS dy, mismatch / cast(valid AS double) AS score FROM {name}_best{last}"))
        return steps

    def first(name: str, source: str, order: str) -> list[tuple[str, str]]:
        return [(f"{name}_ranks", f"SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY {order}) AS rk FROM {source}"), (name, f"SELECT * FROM {name}_ranks WHERE rk = 1")]

    out += [("asked_coarse", f"SELECT i.image_id, k, c, s FROM (SELECT DISTINCT image_id FROM cand_level0) i CROSS JOIN angles WHERE k % {COARSE} = 0")]
    out += [*searched("asked_coarse", "coarse", bottom), *first("coarse_best", "coarse", "score, k")]
    out += [("asked_fine", f"SELECT b.image_id, a.k, c, s FROM coarse_best b JOIN angles a ON abs(a.k - b.k) <= {COARSE}"), *searched("asked_fine", "fine", bottom)]
    out += [("found", "SELECT image_id, 0 AS phase, k, dx, dy, score FROM coarse_best UNION ALL SELECT image_id, 1 AS phase, k, dx, dy, score FROM fine"), *first("chosen", "found", "score, phase, k")]
    last = "chosen"
    if bottom:
        out += [("asked_last", "SELECT b.image_id, a.k, c, s FROM chosen b JOIN angles a ON a.k = b.k"), *searched("asked_last", "last", 0)]
        last = "last"
    return [*out, ("transform", f"SELECT image_id, dx, dy, k / 10.0e0 AS angle, score FROM {last}")]


def subpixel(reference: str, candidate: str, centres: str, w: int, h: int, stride: int = 8) -> list[tuple[str, str]]:
    """``correlations`` of the shifts within a pixel of each centre in quarters, at every ``stride``-th pixel, and ``refined``,
    the first greatest of each image.  Values and masks of the candidate are taken bilinearly; the mask is the weight."""
    offsets = " UNION ALL ".join(f"SELECT {n(k / 4)} AS o" for k in range(-4, 5))
    taps = " UNION ALL ".join(f"SELECT {ty} AS ty, {tx} AS tx" for ty in (0, 1) for tx in (0, 1))
    share = "CASE ty WHEN 1 THEN fy ELSE 1.0e0 - fy END * CASE tx WHEN 1 THEN fx ELSE 1.0e0 - fx END"
    moments = ", ".join(f"sum({v}) AS {k}" for k, v in (("a", "cw * rv"), ("b", "cw * cv"), ("aa", "cw * rv * rv"), ("bb", "cw * cv * cv"), ("ab", "cw * rv * cv"), ("n", "cw")))
    return [
        ("sp_offsets", offsets),
        ("sp_taps", taps),
        ("sp_shifts", f"SELECT image_id, dx + a.o AS dx, dy + b.o AS dy FROM {centres} CROSS JOIN sp_offsets a CROSS JOIN sp_offsets b"),
        ("sp_points", f"SELECT image_id, y, x, v AS rv FROM {reference} WHERE valid = 1 AND y % {stride} = 0 AND x % {stride} = 0 AND y >= {stride} AND y < {h - stride} AND x >= {stride} AND x < {w - stride}"),
        ("sp_places", "SELECT p.image_id, dx, dy, y, x, rv, x - dx AS sx, y - dy AS sy FROM sp_points p JOIN sp_shifts s ON p.image_id = s.image_id"),
        ("sp_cells", f"SELECT *, cast(floor(sx) AS int) AS x0, cast(floor(sy) AS int) AS y0, sx - floor(sx) AS fx, sy - floor(sy) AS fy FROM sp_places WHERE sx >= 0.0e0 AND sx < {w - 1} AND sy >= 0.0e0 AND sy < {h - 1}"),
        ("sp_tapped", f"SELECT image_id, dx, dy, y, x, rv, x0 + tx AS tx, y0 + ty AS ty, {share} AS share FROM sp_cells CROSS JOIN sp_taps"),
        ("sp_values", f"SELECT t.image_id, dx, dy, t.y, t.x, max(rv) AS rv, sum(share * c.v) AS cv, sum(share * c.valid) AS cw FROM sp_tapped t JOIN {candidate} c ON t.image_id = c.image_id AND t.ty = c.y AND t.tx = c.x GROUP BY t.image_id, dx, dy, t.y, t.x"),
        ("sp_sums", f"SELECT image_id, dx, dy, {moments} FROM sp_values WHERE cw > 0.001e0 GROUP BY image_id, dx, dy"),
        ("sp_parts", "SELECT *, (aa - a * a / n) * (bb - b * b / n) AS spread FROM sp_sums"),
        ("correlations", "SELECT image_id, dx, dy, (ab - a * b / n) / sqrt(spread) AS corr FROM sp_parts WHERE spread > 1.0e-18"),
        ("sp_ranks", f"SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY {rounded('corr', 9)} DESC, dy, dx) AS rk FROM correlations"),
        ("refined", "SELECT image_id, dx, dy, corr FROM sp_ranks WHERE rk = 1"),
    ]


def resampled(source: str, transforms: str, w: int, h: int, fill: str | None = None) -> list[tuple[str, str]]:
    """``resampled``: bytes of the source by each image's transform (dx, dy, cosine c, sine s), bilinear.  Pixels that come from
    outside are black, the pixel itself (``own``), or that of another image table of full size, the reference.  An image that stays
    where it is is kept as it is.

    The four taps of each destination pixel are met in one join and summed in one grouping, which carries the fill along.
    """
    grid = source if fill in (None, "own") else fill
    sx, sy = _sampled_at("c", "s", w, h, "(x - dx)", "(y - dy)")
    taps = " UNION ALL ".join(f"SELECT {ty} AS ty, {tx} AS tx" for ty in (0, 1) for tx in (0, 1))
    share = "CASE ty WHEN 1 THEN fy ELSE 1.0e0 - fy END * CASE tx WHEN 1 THEN fx ELSE 1.0e0 - fx END"
    kept = lambda c: f"f_{c}" if fill else "0"
    return [
        ("rs_taps", taps),
        ("rs_places", f"SELECT p.image_id, y, x, r AS f_r, g AS f_g, b AS f_b, {rounded(sx, 9)} AS sx, {rounded(sy, 9)} AS sy, CASE WHEN dx = 0 AND dy = 0 AND abs(s) < 1.0e-5 THEN 1 ELSE 0 END AS still FROM {grid} p JOIN {transforms} t ON p.image_id = t.image_id"),
        ("rs_cells", "SELECT *, cast(floor(sx) AS int) AS x0, cast(floor(sy) AS int) AS y0, sx - floor(sx) AS fx, sy - floor(sy) AS fy FROM rs_places"),
        ("rs_tapped", f"SELECT image_id, y, x, f_r, f_g, f_b, still, x0 + tx AS tx, y0 + ty AS ty, {share} AS share FROM rs_cells CROSS JOIN rs_taps"),
        ("rs_sums", "SELECT t.image_id, t.y, t.x, max(f_r) AS f_r, max(f_g) AS f_g, max(f_b) AS f_b, max(still) AS still, count(p.r) AS found, " + ", ".join(f"sum(share * p.{c}) AS {c}" for c in RGB) + f" FROM rs_tapped t LEFT JOIN {source} p ON t.image_id = p.image_id AND t.ty = p.y AND t.tx = p.x GROUP BY t.image_id, t.y, t.x"),
        ("resampled", f"SELECT {KEYS}, " + ", ".join(f"CASE WHEN found = 4 OR still = 1 AND found > 0 THEN cast(ROUND_EVEN({rounded(c, 6)}, 0) AS int) ELSE {kept(c)} END AS {c}" for c in RGB) + " FROM rs_sums"),
    ]
