"""Alignment of frames to the first frame of their image: angle, shift, sub-pixel shift, and the moved frames.

The plan is staged, level by level, in the shared folder:

1. The pyramids of all frames, within their tiles.
2. The two coarsest levels of an image (their shorter side has less than 128 pixels, whatever the image's size) meet in one task, which
   searches whole degrees, then tenths about the best, each with the shifts within four pixels.
3. The finer levels, turned by the angle that was found, for all levels in one exchange; medians from histograms; bitmaps.
4. From coarse to fine, one job a level: each tile of the reference counts mismatches for 81 shifts about twice the shift before.
5. By option, correlations at quarters of a pixel.
6. The frames, resampled by what was found.

Jobs are as many as levels, whatever the number of images and frames.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import Stage
from . import tiles as ti
from .alignment import BOUND, COARSE, RADIUS, SEARCHED, cos, levels, sin
from .tiles import Rect

#: A bitmap's bits: above the median; far enough from it and valid.
BIT, MASK = 1, 2
#: Quarters of a pixel, and the distance between the samples of correlations.
QUARTERS, STRIDE = 4, 8
_SHIFTS = [(dy, dx) for dy in range(-RADIUS, RADIUS + 1) for dx in range(-RADIUS, RADIUS + 1)]
_PARTS = [(dy / QUARTERS, dx / QUARTERS) for dy in range(-QUARTERS, QUARTERS + 1) for dx in range(-QUARTERS, QUARTERS + 1)]
#: Levels from a row's own to the coarsest: its shorter side is halved down to below 64.
_LEVELS_LEFT = "1 + greatest(0, length(bin(least(h, w))) - 6)"
_FOUND = "image_id long, frame int, k int, dx int, dy int, mismatch long, valid long"


def gray(rgb: np.ndarray) -> np.ndarray:
    r, g, b = (rgb[..., c].astype(np.int32) for c in range(3))
    return ((54 * r + 183 * g + 19 * b) >> 8).astype(np.uint8)[..., None]


def bitmap(values: np.ndarray, there: np.ndarray, median: int) -> np.ndarray:
    return (values >= median) * np.uint8(BIT) | (there & (np.abs(values.astype(np.int32) - median) > 4)) * np.uint8(MASK)


def median_of(values: np.ndarray, there: np.ndarray) -> int:
    """The lower median; 0 where nothing is valid."""
    counts = np.cumsum(np.bincount(values[there], minlength=1))
    return int(np.searchsorted(counts, (counts[-1] - 1) // 2, side="right")) if counts[-1] else 0


def mismatches(reference: np.ndarray, window: np.ndarray, rect: Rect, own: Rect, cy: int, cx: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the bitmap of ``own`` against the candidate's in ``rect``, for each shift about the centre: pixels that differ, pixels that count.
    The reference's (x, y) is the candidate's (x - dx, y - dy)."""
    out = np.zeros((2, len(_SHIFTS)), np.int64)
    for i, (dy, dx) in enumerate(_SHIFTS):
        seen = Rect(own.y0 - cy - dy, own.y1 - cy - dy, own.x0 - cx - dx, own.x1 - cx - dx).cut(rect)
        if seen.there():
            a = Rect(seen.y0 + cy + dy, seen.y1 + cy + dy, seen.x0 + cx + dx, seen.x1 + cx + dx).of(reference, own.y0, own.x0)
            b = seen.of(window, rect.y0, rect.x0)
            both = a & b & MASK
            out[:, i] = np.count_nonzero((a ^ b) & (both >> 1)), np.count_nonzero(both)
    return out[0], out[1]


def first_best(mismatch: np.ndarray, valid: np.ndarray, cy: int, cx: int) -> tuple[int, int, int, int]:
    """dx, dy, mismatch and valid of the first least share; where nothing overlaps, the centre with no mismatch."""
    if not valid.any():
        return cx, cy, 0, 1
    i = int(np.argmin(np.where(valid > 0, mismatch / np.maximum(valid, 1), np.inf)))
    return cx + _SHIFTS[i][1], cy + _SHIFTS[i][0], int(mismatch[i]), int(valid[i])


def turned(image: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """A whole level, turned by tenths of a degree; the values, and the pixels that there are and that take a value."""
    h, w = image.shape[:2]
    rect = Rect(0, h, 0, w)
    values, there = ti.nearest({"h": h, "w": w, "dx": 0, "dy": 0, "c": cos(k / 10), "s": sin(k / 10)}, image, rect, rect)
    return values[..., 0], there & (image[..., 1] > 0)


def searched(reference: list[np.ndarray], candidate: list[np.ndarray]) -> tuple[int, int, int, int, int]:
    """Angle in tenths, dx, dy, mismatch, valid of the finest of the levels, which come from coarse to fine."""
    known = [bitmap(v, there, median_of(v, there)) for v, there in ((level[..., 0], level[..., 1] > 0) for level in reference)]

    def at(k: int) -> tuple[float, int, tuple]:
        dx = dy = 0
        for n, (side, image) in enumerate(zip(known, candidate, strict=True)):
            values, there = turned(image, k)
            rect, own = Rect(0, image.shape[0], 0, image.shape[1]), Rect(0, side.shape[0], 0, side.shape[1])
            cy, cx = (2 * dy, 2 * dx) if n else (0, 0)
            dx, dy, mismatch, valid = first_best(*mismatches(side, bitmap(values, there, median_of(values, there)), rect, own, cy, cx), cy, cx)
        return mismatch / valid, k, (dx, dy, mismatch, valid)

    coarse = min((at(k) for k in range(-BOUND, BOUND + 1, COARSE)), key=lambda x: x[:2])
    fine = min((at(k) for k in range(max(-BOUND, coarse[1] - COARSE), min(BOUND, coarse[1] + COARSE) + 1)), key=lambda x: x[:2])
    score, k, found = fine if fine[0] < coarse[0] else coarse
    return k, *found


def coarse_search(pyramid: DataFrame, side: int) -> DataFrame:
    """The search on the coarsest levels of each frame but the first: image_id, frame, level, k, dx, dy, mismatch, valid."""
    schema = _FOUND.replace("k int", "level int, k int")
    arrow = ti._arrow(schema)

    def scan(batches):
        held: dict[tuple[int, int], list[dict]] = {}
        now = None

        def found():
            whole: dict[int, list[np.ndarray]] = {}
            for (frame, level), rows in sorted(held.items(), key=lambda x: (x[0][0], -x[0][1])):
                out = np.zeros((rows[0]["h"], rows[0]["w"], 2), np.uint8)
                for row in rows:
                    rect = ti.rect_of(row, side)
                    out[rect.y0 : rect.y1, rect.x0 : rect.x1] = ti.samples(row, rect, "u1")
                whole.setdefault(frame, []).append(out)
            level = min(x[1] for x in held)
            return [(now, frame, level, *searched(whole[0], images)) for frame, images in whole.items() if frame and 0 in whole and [i.shape for i in images] == [i.shape for i in whole[0]]]

        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if row["image_id"] != now:
                    if held and (out := found()):
                        yield ti._batch(arrow, out)
                    now, held = row["image_id"], {}
                held.setdefault((row["frame"], row["level"]), []).append(row)
        if held and (out := found()):
            yield ti._batch(arrow, out)

    return pyramid.filter(f"{_LEVELS_LEFT} <= {SEARCHED}").repartition("image_id").sortWithinPartitions("image_id").mapInArrow(scan, schema)


def _angles(found: DataFrame) -> DataFrame:
    """Cosine c and sine s of k tenths of a degree."""
    table = lambda f: F.element_at(F.array(*[F.lit(f(k / 10)) for k in range(-BOUND, BOUND + 1)]), F.col("k") + BOUND + 1)
    return found.withColumns({"c": table(cos), "s": table(sin)})


def _turned_levels(pyramid: DataFrame, found: DataFrame, side: int, subpixel: bool) -> DataFrame:
    """Levels that are finer than the search's, and with ``subpixel`` the finest: two planes (value, valid), turned; the first frame as it is."""
    finer = F.expr(f"{_LEVELS_LEFT} > {SEARCHED}")
    wanted = pyramid.filter(finer | (F.col("level") == 0) if subpixel else finer)
    moves = _angles(found.select("image_id", "frame", "k")).select("image_id", "frame", F.lit(0.0).alias("dx"), F.lit(0.0).alias("dy"), "c", "s")

    def work(row, window, rect, base):
        if row["c"] is None or not window.size:
            return [ti._tile(row, np.zeros_like(base))]
        values, there = ti.nearest(row, window, rect, ti.rect_of(row, side))
        return [ti._tile(row, values, there & (base[..., 1] > 0))]

    candidates = wanted.filter("frame > 0").join(moves, ["image_id", "frame"])
    moved = ti.windows(candidates, ti.Move(1), work, ti.TILE, side, "u1", candidates.drop("c", "s", "dx", "dy"), "u1", "dx double, dy double, c double, s double")
    return moved.unionByName(wanted.filter("frame = 0"))


def _bitmaps(planes: DataFrame, side: int) -> DataFrame:
    """Bitmaps of planes by the median of each level of each frame."""

    def counted(row):
        data = ti.samples(row, ti.rect_of(row, side), "u1")
        counts = np.bincount(data[..., 0][data[..., 1] > 0], minlength=1)
        return [(row["image_id"], row["frame"], row["level"], int(v), int(counts[v])) for v in np.flatnonzero(counts)]

    levels_ = ti.each(planes, counted, "image_id long, frame int, level int, v int, n long").groupBy("image_id", "frame", "level", "v").agg(F.sum("n").alias("n"))
    # at most 256 rows of a level of a frame: sorted in one array, the value that holds the middle is taken
    medians = levels_.groupBy("image_id", "frame", "level").agg(F.array_sort(F.collect_list(F.struct("v", "n"))).alias("all"), F.sum("n").alias("total"))
    middle = F.expr("aggregate(all, named_struct('left', (total - 1) div 2, 'v', -1), (s, x) -> named_struct('left', s.left - x.n, 'v', CASE WHEN s.v < 0 AND s.left - x.n < 0 THEN x.v ELSE s.v END)).v")
    rows = planes.join(medians.select("image_id", "frame", "level", middle.alias("median")), ["image_id", "frame", "level"], "left")

    def made(row):
        data = ti.samples(row, ti.rect_of(row, side), "u1")
        return [ti._tile(row, bitmap(data[..., 0], data[..., 1] > 0, row["median"] or 0))]

    return ti.each(rows, made, ti.TILE, 16)


@dataclass(frozen=True)
class _Near:
    """The candidate about a shift (dx, dy): what the shifts within ``margin`` need."""

    margin: int

    def need(self, row: dict, rect: Rect) -> Rect:
        return Rect(rect.y0 - row["dy"], rect.y1 - row["dy"], rect.x0 - row["dx"], rect.x1 - row["dx"]).grown(self.margin)

    def feeds(self, row: dict, rect: Rect) -> Rect:
        return Rect(rect.y0 + row["dy"], rect.y1 + row["dy"], rect.x0 + row["dx"], rect.x1 + row["dx"]).grown(self.margin)


def _against(planes: DataFrame, state: DataFrame, margin: int, work, schema: str, side: int) -> DataFrame:
    """Each tile of the first frame with the candidates about their shifts (image_id, frame, dx, dy) of its level."""
    pairs = state.select("image_id", "frame", F.col("dx").cast("int"), F.col("dy").cast("int"))
    candidates = planes.filter("frame > 0").join(pairs, ["image_id", "frame"])
    reference = planes.filter("frame = 0").drop("frame").join(pairs.select("image_id", "frame"), "image_id")
    return ti.windows(candidates, _Near(margin), work, schema, side, "u1", reference, "u1", "dx int, dy int")


def _step(bits: DataFrame, state: DataFrame, level: int, side: int) -> DataFrame:
    """The shifts of a level about twice those of the level above."""
    ready = state.filter(F.col("level") == level + 1).withColumns({"dx": F.col("dx") * 2, "dy": F.col("dy") * 2}).withColumn("level", F.lit(level))

    def work(row, window, rect, base):
        if not window.size:
            return []
        found = mismatches(base[..., 0], window[..., 0], rect, ti.rect_of(row, side), row["dy"], row["dx"])
        return [(row["image_id"], row["frame"], i, int(m), int(v)) for i, (m, v) in enumerate(zip(*found, strict=True))]

    sums = _against(bits.filter(F.col("level") == level), ready, RADIUS, work, "image_id long, frame int, i int, mismatch long, valid long", side).groupBy("image_id", "frame", "i").agg(F.sum("mismatch").alias("mismatch"), F.sum("valid").alias("valid"))
    best = sums.filter("valid > 0").groupBy("image_id", "frame").agg(F.min(F.struct((F.col("mismatch") / F.col("valid")).alias("score"), "i", "mismatch", "valid")).alias("best"))
    wide = 2 * RADIUS + 1
    chosen = ready.drop("mismatch", "valid").join(best, ["image_id", "frame"], "left").select("image_id", "frame", "level", "k", F.coalesce(F.col("dx") + F.col("best.i") % wide - RADIUS, "dx").cast("int").alias("dx"), F.coalesce(F.col("dy") + F.floor(F.col("best.i") / wide) - RADIUS, "dy").cast("int").alias("dy"), F.coalesce("best.mismatch", F.lit(0)).cast("long").alias("mismatch"), F.coalesce("best.valid", F.lit(1)).cast("long").alias("valid"))
    return chosen.unionByName(state.filter(F.col("level") != level + 1))


def _refined(planes: DataFrame, state: DataFrame, side: int) -> DataFrame:
    """image_id, frame and the shift in quarters of a pixel whose correlation with the reference is the greatest: at every eighth pixel, the
    candidate taken bilinearly and weighed by the share of it that is there."""
    moments = ("n", "a", "b", "aa", "bb", "ab")

    def work(row, window, rect, base):
        own = ti.rect_of(row, side)
        y, x = (np.arange(-(-low // STRIDE) * STRIDE, high, STRIDE) for low, high in ((own.y0, own.y1), (own.x0, own.x1)))
        y, x = y[(y >= STRIDE) & (y < row["h"] - STRIDE)], x[(x >= STRIDE) & (x < row["w"] - STRIDE)]
        if not window.size or not y.size or not x.size:
            return []
        rv, rm = (base[y - own.y0][:, x - own.x0][..., c].astype(float) for c in (0, 1))
        out = []
        for i, (oy, ox) in enumerate(_PARTS):
            sy, sx = y - (row["dy"] + oy), x - (row["dx"] + ox)
            inside = ((sy >= 0) & (sy < row["h"] - 1))[:, None] & ((sx >= 0) & (sx < row["w"] - 1))[None, :] & (rm > 0)
            iy, ix = np.floor(sy).astype(int), np.floor(sx).astype(int)
            fy, fx = (sy - iy)[:, None, None], (sx - ix)[None, :, None]
            at = lambda j, k: window[np.clip(iy + j - rect.y0, 0, len(window) - 1)][:, np.clip(ix + k - rect.x0, 0, window.shape[1] - 1)].astype(float)  # noqa: B023, E731
            c = (1 - fy) * ((1 - fx) * at(0, 0) + fx * at(0, 1)) + fy * ((1 - fx) * at(1, 0) + fx * at(1, 1))
            cv, cw = c[..., 0], c[..., 1]
            w, r, v = (z[inside & (cw > 0.001)] for z in (cw, rv, cv))
            out.append((row["image_id"], row["frame"], i, *(float(z.sum()) for z in (w, w * r, w * v, w * r * r, w * v * v, w * r * v))))
        return out

    rows = _against(planes.filter("level = 0"), state, 3, work, "image_id long, frame int, i int, " + ", ".join(f"{m} double" for m in moments), side)
    sums = rows.groupBy("image_id", "frame", "i").agg(*[F.sum(m).alias(m) for m in moments])
    parts = sums.withColumn("spread", F.expr("(aa - a * a / n) * (bb - b * b / n)")).filter("spread > 1.0e-18")
    best = parts.groupBy("image_id", "frame").agg(F.max(F.struct(F.expr("floor((ab - a * b / n) / sqrt(spread) * 1.0e9 + 0.5)").alias("corr"), (-F.col("i")).alias("i"))).alias("best"))
    wide, i = 2 * QUARTERS + 1, -F.col("best.i")
    return best.select("image_id", "frame", (i % wide / QUARTERS - 1).alias("ox"), (F.floor(i / wide) / QUARTERS - 1).alias("oy"), (F.col("best.corr") / 1e9).alias("corr"))


def side_for(most_levels: int, side: int = ti.SIDE) -> int:
    """Tiles in which so many levels nest."""
    return max(side, 1 << (most_levels - 1))


def transforms(frames: DataFrame, stage: Stage, side: int = ti.SIDE, subpixel: bool = False) -> DataFrame:
    """What each frame but the first is moved by: image_id, frame, dx, dy, angle, score (share of mismatches; with ``subpixel`` the correlation).

    ``frames``: tiles of bytes of level 0, which must be stored: they are read twice.  Frames of another size than the first of their
    image, and images without a first frame, have none.
    """
    pyramid = stage.put(ti.downsample(frames, levels, side, gray))
    sizes = frames.select("image_id", "frame", "h", "w").distinct()
    alike = sizes.filter("frame > 0").join(sizes.filter("frame = 0").select("image_id", "h", "w"), ["image_id", "h", "w"])
    state = stage.put(coarse_search(pyramid, side).join(alike.select("image_id", "frame"), ["image_id", "frame"], "left_semi"))
    most = state.agg(F.max("level")).first()[0] or 0
    planes = None
    if most or subpixel:
        planes = stage.put(_turned_levels(pyramid, state, side, subpixel))
    if most:
        bits = stage.put(_bitmaps(planes, side))
        for level in range(most - 1, -1, -1):
            state = stage.put(_step(bits, state, level, side))
    out = state.select("image_id", "frame", F.col("dx").cast("double").alias("dx"), F.col("dy").cast("double").alias("dy"), (F.col("k") / 10.0).alias("angle"), (F.col("mismatch") / F.col("valid")).alias("score"))
    if subpixel:
        better = _refined(planes, state, side)
        out = out.join(better, ["image_id", "frame"], "left").select("image_id", "frame", (F.col("dx") + F.coalesce("ox", F.lit(0.0))).alias("dx"), (F.col("dy") + F.coalesce("oy", F.lit(0.0))).alias("dy"), "angle", F.coalesce("corr", "score").alias("score"))
    return stage.put(out)


def turns(found: DataFrame) -> DataFrame:
    """The transforms as ``tiles.resampled`` takes them."""
    return _angles(found.withColumn("k", F.round(F.col("angle") * 10).cast("int"))).select("image_id", "frame", "dx", "dy", "c", "s")


def moved(frames: DataFrame, found: DataFrame, side: int = ti.SIDE, fill: bool = True) -> DataFrame:
    """All tiles: first frames, and frames that have no transform, as they are; the others moved, what comes from outside taken from
    the first frame (or black)."""
    table = turns(found)
    others = frames.join(table.select("image_id", "frame"), ["image_id", "frame"], "left_semi")
    kept = frames.join(table.select("image_id", "frame"), ["image_id", "frame"], "left_anti")
    first = frames.filter("frame = 0").drop("frame").join(table.select("image_id", "frame"), "image_id") if fill else None
    return kept.unionByName(ti.resampled(others, table, side, first))


def most_levels(sizes: DataFrame) -> int:
    """Levels of the largest image of rows with w and h; one number comes to the driver."""
    row = sizes.agg(F.max(F.least("w", "h")).alias("least")).first()
    return levels(row["least"], row["least"]) if row["least"] else 1


def align(bracket: DataFrame, subpixel: bool = False, fill: bool = True, side: int = ti.SIDE) -> tuple[DataFrame, DataFrame, Stage]:
    """Pixels (image_id, frame from 0, y, x, r, g, b) of bytes with frames 1 and on moved onto frame 0, the transforms, and the stage whose tables
    they are read from (``clear`` it behind the last use).  Frames are turned about the centre of their size: that of columns h and w, or
    where these lack, one beyond the last line and column."""
    stage = Stage(bracket.sparkSession, "aligned")
    size = (F.max("h"), F.max("w")) if {"h", "w"} <= set(bracket.columns) else (F.max("y") + 1, F.max("x") + 1)
    sizes = bracket.groupBy("image_id", "frame").agg(size[0].alias("h"), size[1].alias("w"))
    sizes = stage.put(sizes)
    side = side_for(most_levels(sizes), side)
    frames = stage.put(ti.tiled(bracket.select("image_id", "frame", "y", "x", *ti.RGB).join(sizes, ["image_id", "frame"]), side, "u1"))
    found = transforms(frames, stage, side, subpixel)
    return ti.untiled(moved(frames, found, side, fill), side, "u1", framed=True), found, stage
