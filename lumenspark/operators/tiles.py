"""Rasters as tiles, and operators that look beyond a pixel.

A row is a tile: image_id, frame, level, ty, tx, the image's height and width at that level, and the samples of all channels, line by
line.  The last channel tells which pixels there are (1) and which lack (0, as are their samples): an image may have gaps or end before its
height, and what lacks has no weight and comes out as nothing.  Tiles of level k have ``side >> k`` pixels a side, so the levels of a pyramid nest and are computed within a tile.  An operator on
neighbourhoods, moves or turns is one exchange: each tile sends the parts that other tiles need, a tile puts its window together from
what comes, and works on that window with numpy.  A task holds one window at a time, whatever the size of an image.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .steps import RGB

SIDE = 64
KEYS = ("image_id", "frame", "level", "ty", "tx")
TILE = "image_id long, frame int, level int, ty int, tx int, h int, w int, data binary"
_COLUMNS = (*KEYS, "h", "w", "data")


@dataclass
class Rect:
    """Lines and columns of an image, the ends not included."""

    y0: int
    y1: int
    x0: int
    x1: int

    def cut(self, other: Rect) -> Rect:
        return Rect(max(self.y0, other.y0), min(self.y1, other.y1), max(self.x0, other.x0), min(self.x1, other.x1))

    def grown(self, by: int) -> Rect:
        return Rect(self.y0 - by, self.y1 + by, self.x0 - by, self.x1 + by)

    def there(self) -> bool:
        return self.y0 < self.y1 and self.x0 < self.x1

    def of(self, array: np.ndarray, y0: int, x0: int) -> np.ndarray:
        """This part of an array that begins at (y0, x0)."""
        return array[self.y0 - y0 : self.y1 - y0, self.x0 - x0 : self.x1 - x0]


def whole(row: dict) -> Rect:
    return Rect(0, row["h"], 0, row["w"])


def rect_of(row: dict, side: int) -> Rect:
    s = side >> row["level"]
    return Rect(row["ty"] * s, (row["ty"] + 1) * s, row["tx"] * s, (row["tx"] + 1) * s).cut(whole(row))


def samples(row: dict, rect: Rect, kind: str) -> np.ndarray:
    """Lines, columns and channels of a tile, with the one that tells which pixels there are."""
    return np.frombuffer(row["data"], kind).reshape(rect.y1 - rect.y0, rect.x1 - rect.x0, -1)


def each(df: DataFrame, work: Callable[[dict], Iterable[tuple]], schema: str, rows: int = 64) -> DataFrame:
    """``work`` gives rows for each row; they are sent on in small batches."""
    arrow = _arrow(schema)

    def scan(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, rows):
                out = [x for row in batch.slice(low, rows).to_pylist() for x in work(row)]
                if out:
                    yield _batch(arrow, out)

    return df.mapInArrow(scan, schema)


def _arrow(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(StructType.fromDDL(schema))


def _batch(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


# Pixels -------------------------------------------------------------------------------------------------------------


def tiled(pixels: DataFrame, side: int = SIDE, kind: str = "f8", channels: tuple[str, ...] = RGB) -> DataFrame:
    """Tiles of level 0 of pixels (image_id, frame or none, y, x, channels), in one exchange.  The image's size is that of columns h and
    w, or where these lack, one beyond the last line and column."""
    keys = ["image_id", *(["frame"] if "frame" in pixels.columns else [])]
    if not {"h", "w"} <= set(pixels.columns):
        pixels = pixels.join(pixels.groupBy(keys).agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w")), keys)
    frame = F.col("frame").cast("int") if "frame" in pixels.columns else F.lit(0)
    at = [F.floor(F.col(c) / side).cast("int").alias(f"t{c}") for c in ("y", "x")]
    rows = pixels.select(F.col("image_id").cast("long").alias("image_id"), frame.alias("frame"), *at, F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), F.col("h").cast("int").alias("h"), F.col("w").cast("int").alias("w"), *[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(channels)])
    arrow = _arrow(TILE)

    def scan(batches):
        key, held, rect = None, None, None

        def closed():
            return _batch(arrow, [(key[0], key[1], 0, key[2], key[3], key[4], key[5], held.tobytes())])

        for batch in batches:
            names = ("image_id", "frame", "ty", "tx", "h", "w", "y", "x", *(f"c{i}" for i in range(len(channels))))
            c = {name: batch.column(name).to_numpy() for name in names}
            edges = np.flatnonzero(np.any([c[n][1:] != c[n][:-1] for n in ("image_id", "frame", "ty", "tx")], axis=0)) + 1
            for low, high in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows], strict=True):
                if low == high:
                    continue
                own = tuple(int(c[n][low]) for n in ("image_id", "frame", "ty", "tx", "h", "w"))
                if own != key:
                    if key:
                        yield closed()
                    key = own
                    rect = rect_of({"level": 0, "ty": own[2], "tx": own[3], "h": own[4], "w": own[5]}, side)
                    held = np.zeros((rect.y1 - rect.y0, rect.x1 - rect.x0, len(channels) + 1), kind)
                part = slice(low, high)
                held[c["y"][part] - rect.y0, c["x"][part] - rect.x0] = np.stack([*[c[f"c{i}"][part] for i in range(len(channels))], np.ones(high - low)], axis=1)
        if key:
            yield closed()

    return rows.repartition("image_id", "frame", "ty", "tx").sortWithinPartitions("image_id", "frame", "ty", "tx").mapInArrow(scan, TILE)


def untiled(tiles: DataFrame, side: int = SIDE, kind: str = "f8", channels: tuple[str, ...] = RGB, framed: bool = False) -> DataFrame:
    """The pixels that there are, of tiles of level 0, without an exchange: image_id, with ``framed`` frame, y, x, channels (int for bytes)."""
    number, keys = ("int" if kind == "u1" else "double"), ["image_id", *(["frame"] if framed else [])]

    def scan(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                rect = rect_of(row, side)
                data = samples(row, rect, kind)
                there = data[..., -1] > 0
                y, x = (v[there].astype(np.int32) for v in np.mgrid[rect.y0 : rect.y1, rect.x0 : rect.x1])
                ids = [pa.array(np.full(len(y), row[k], np.int64 if k == "image_id" else np.int32)) for k in keys]
                values = [pa.array(data[..., k][there].astype(np.int32 if number == "int" else np.float64)) for k in range(len(channels))]
                yield pa.RecordBatch.from_arrays([*ids, pa.array(y), pa.array(x), *values], names=[*keys, "y", "x", *channels])

    return tiles.mapInArrow(scan, f"image_id long, {'frame int, ' * framed}y int, x int, " + ", ".join(f"{c} {number}" for c in channels))


# Windows ------------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Halo:
    """Windows that reach ``radius`` pixels beyond a tile."""

    radius: int

    def need(self, row: dict, rect: Rect) -> Rect:
        return rect.grown(self.radius)

    feeds = need


@dataclass(frozen=True)
class Move:
    """Windows of images turned about their centre and moved: (x, y) is taken from the source at the place that the columns dx, dy, and c, s
    (cosine and sine) of a row tell, and ``margin`` pixels about it."""

    margin: int

    @staticmethod
    def source(row: dict, y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cy, cx = (row["h"] - 1) / 2, (row["w"] - 1) / 2
        y, x = y - row["dy"], x - row["dx"]
        sy, sx = row["c"] * (y - cy) - row["s"] * (x - cx) + cy, row["c"] * (x - cx) + row["s"] * (y - cy) + cx
        return np.floor(sy * 1e9 + 0.5) / 1e9, np.floor(sx * 1e9 + 0.5) / 1e9

    def _about(self, y: np.ndarray, x: np.ndarray) -> Rect:
        return Rect(math.floor(y.min()), math.ceil(y.max()) + 1, math.floor(x.min()), math.ceil(x.max()) + 1).grown(self.margin)

    def _corners(self, rect: Rect) -> tuple[np.ndarray, np.ndarray]:
        return np.array([rect.y0, rect.y0, rect.y1 - 1, rect.y1 - 1], float), np.array([rect.x0, rect.x1 - 1, rect.x0, rect.x1 - 1], float)

    def need(self, row: dict, rect: Rect) -> Rect:
        return self._about(*self.source(row, *self._corners(rect)))

    def feeds(self, row: dict, rect: Rect) -> Rect:
        cy, cx = (row["h"] - 1) / 2, (row["w"] - 1) / 2
        y, x = self._corners(rect)
        back = row["c"] * (y - cy) + row["s"] * (x - cx), row["c"] * (x - cx) - row["s"] * (y - cy)
        return self._about(back[0] + cy + row["dy"], back[1] + cx + row["dx"]).grown(1)


def windows(tiles: DataFrame, reach, work: Callable[[dict, np.ndarray, Rect, np.ndarray | None], Iterable[tuple]], schema: str, side: int = SIDE, kind: str = "f8", base: DataFrame | None = None, base_kind: str = "f8", more: str = "") -> DataFrame:
    """``work(row, window, rect, base)`` for each tile: the samples of ``rect``, all that ``reach`` needs and the image has, in one exchange.

    ``more`` names further columns of the tiles (as a schema) that ``reach`` and ``work`` find in a row.  ``base``, tiles of the same keys, gives
    the samples at the tile's own place; a tile that no part reaches has an empty window, one without base is left out.
    """
    names = [f.split(" ")[0] for f in more.split(", ") if f]
    sent = f"{TILE}, y0 int, x0 int, ph int, pw int" + (f", {more}" if more else "")

    def send(row: dict) -> Iterator[tuple]:
        rect, s = rect_of(row, side), side >> row["level"]
        data = samples(row, rect, kind)
        goal = reach.feeds(row, rect).cut(whole(row))
        if not goal.there():
            return
        for ty in range(goal.y0 // s, (goal.y1 - 1) // s + 1):
            for tx in range(goal.x0 // s, (goal.x1 - 1) // s + 1):
                part = reach.need(row, rect_of(row | {"ty": ty, "tx": tx}, side)).cut(rect)
                if part.there():
                    yield (row["image_id"], row["frame"], row["level"], ty, tx, row["h"], row["w"], np.ascontiguousarray(part.of(data, rect.y0, rect.x0)).tobytes(), part.y0, part.x0, part.y1 - part.y0, part.x1 - part.x0, *(row[n] for n in names))

    parts = each(tiles.select(*_COLUMNS, *names), send, sent, 16).withColumn("own", F.lit(False))
    if base is not None:
        parts = parts.unionByName(base.select(*_COLUMNS, *[n for n in names if n in base.columns]).withColumn("own", F.lit(True)), allowMissingColumns=True)
    arrow, based = _arrow(schema), base is not None

    def receive(batches):
        key, held = None, []

        def built() -> list[tuple]:
            own = next((r for r in held if r["own"]), None)
            row = next((r for r in held if not r["own"]), own)
            if based and own is None:
                return []
            rect = rect_of(row, side)
            given = samples(own, rect, base_kind) if own else None
            got = [r for r in held if not r["own"]]
            if not got:
                return list(work(row, np.zeros((0, 0, 1), kind), Rect(0, 0, 0, 0), given))
            need = reach.need(row, rect).cut(whole(row))
            first = np.frombuffer(got[0]["data"], kind).reshape(got[0]["ph"], got[0]["pw"], -1)
            window = np.zeros((need.y1 - need.y0, need.x1 - need.x0, first.shape[2]), kind)
            for r in got:
                y, x = r["y0"] - need.y0, r["x0"] - need.x0
                window[y : y + r["ph"], x : x + r["pw"]] = np.frombuffer(r["data"], kind).reshape(r["ph"], r["pw"], -1)
            return list(work(row, window, need, given))

        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                own = tuple(row[k] for k in KEYS)
                if own != key:
                    if held and (out := built()):
                        yield _batch(arrow, out)
                    key, held = own, []
                held.append(row)
        if held and (out := built()):
            yield _batch(arrow, out)

    return parts.repartition(*KEYS).sortWithinPartitions(*KEYS).mapInArrow(receive, schema)


def _tile(row: dict, data: np.ndarray, there: np.ndarray | None = None) -> tuple:
    """A row of samples, or of samples without and the pixels that there are."""
    if there is not None:
        there = there[..., None] > 0
        data = np.concatenate([np.where(there, data, 0), there], axis=2, dtype=data.dtype)
    return (*(row[k] for k in KEYS), row["h"], row["w"], np.ascontiguousarray(data).tobytes())


# Neighbourhoods -----------------------------------------------------------------------------------------------------


def _box(window: np.ndarray, rect: Rect, own: Rect, radius: int) -> np.ndarray:
    """Means of squares about each pixel of ``own`` over the pixels that exist, by sums from the window's corner: the cost has no radius in it."""
    sums = np.zeros((window.shape[0] + 1, window.shape[1] + 1, window.shape[2]))
    sums[1:, 1:] = np.cumsum(np.cumsum(window, axis=0), axis=1)
    y, x = np.arange(own.y0, own.y1), np.arange(own.x0, own.x1)
    y0, y1, x0, x1 = np.maximum(y - radius, rect.y0) - rect.y0, np.minimum(y + radius + 1, rect.y1) - rect.y0, np.maximum(x - radius, rect.x0) - rect.x0, np.minimum(x + radius + 1, rect.x1) - rect.x0
    total = sums[y1][:, x1] - sums[y0][:, x1] - sums[y1][:, x0] + sums[y0][:, x0]
    return total[..., :-1] / np.maximum(total[..., -1:], 1)


def box_mean(tiles: DataFrame, radius: int, side: int = SIDE) -> DataFrame:
    def work(row, window, rect, _):
        own = rect_of(row, side)
        return [_tile(row, _box(window, rect, own, radius), own.of(window, rect.y0, rect.x0)[..., -1])]

    return windows(tiles, Halo(radius), work, TILE, side)


def local_contrast(tiles: DataFrame, amount: float, radius: int, side: int = SIDE) -> DataFrame:
    """The distance to the local mean, enlarged by ``amount`` of 100, within 0 and 1."""
    share = max(-1.0, min(1.0, amount / 100))

    def work(row, window, rect, _):
        own = rect_of(row, side)
        here = own.of(window, rect.y0, rect.x0)
        here, there = here[..., :-1], here[..., -1]
        return [_tile(row, np.clip(here + (here - _box(window, rect, own, radius)) * share, 0, 1), there)]

    return windows(tiles, Halo(radius), work, TILE, side)


def gaussian_blur(tiles: DataFrame, sigma: float, side: int = SIDE) -> DataFrame:
    """Separable, three sigmas to each side; weights of pixels that lack are left out."""
    radius = max(1, math.ceil(3 * sigma))
    kernel = np.exp(-(np.arange(-radius, radius + 1) ** 2) / (2 * sigma * sigma))

    def blurred(a: np.ndarray, low: int, high: int, axis: int) -> np.ndarray:
        """Along one axis, for the places from low to high; the last channel as it is."""
        a = np.moveaxis(a, axis, 0)
        padded = np.concatenate([np.zeros((radius, *a.shape[1:])), a, np.zeros((radius, *a.shape[1:]))])
        sums = sum(k * padded[low + i : high + i] for i, k in enumerate(kernel))
        there = a[low:high, :, -1:]
        out = np.where(there > 0, sums[..., :-1] / np.where(there > 0, sums[..., -1:], 1), 0)
        return np.moveaxis(np.concatenate([out, there], axis=2), 0, axis)

    def work(row, window, rect, _):
        own = rect_of(row, side)
        lines = blurred(window, own.x0 - rect.x0, own.x1 - rect.x0, 1)
        return [_tile(row, blurred(lines, own.y0 - rect.y0, own.y1 - rect.y0, 0))]

    return windows(tiles, Halo(radius), work, TILE, side)


# Pyramids and moves -------------------------------------------------------------------------------------------------


def halved(a: np.ndarray) -> np.ndarray:
    """Means of the pixels that there are of each two by two, rounded down; an odd line or column at the end is dropped."""
    h, w = a.shape[0] // 2 * 2, a.shape[1] // 2 * 2
    a = a[:h, :w].astype(np.int32)
    sums = a[::2, ::2] + a[1::2, ::2] + a[::2, 1::2] + a[1::2, 1::2]
    return np.concatenate([sums[..., :-1] // np.maximum(sums[..., -1:], 1), sums[..., -1:] > 0], axis=2, dtype=np.uint8, casting="unsafe")


def downsample(tiles: DataFrame, levels: Callable[[int, int], int], side: int = SIDE, channel: Callable[[np.ndarray], np.ndarray] = lambda a: a) -> DataFrame:
    """All levels of bytes (``levels(w, h)`` of them), each from the one before within a tile, so without an exchange.  ``channel`` makes the samples
    of level 0 from those of a tile.  ``side`` must be a multiple of two to the number of levels less one."""

    def work(row: dict) -> Iterator[tuple]:
        data, h, w = samples(row, rect_of(row, side), "u1"), row["h"], row["w"]
        data = np.concatenate([channel(data[..., :-1]), data[..., -1:]], axis=2)
        for level in range(levels(row["w"], row["h"])):
            if (side >> level) << level != side:
                raise ValueError("tiles are too small for so many levels")
            if level:
                data, h, w = halved(data), h // 2, w // 2
            if not data.size:
                return
            yield (row["image_id"], row["frame"], level, row["ty"], row["tx"], h, w, data.tobytes())

    return each(tiles, work, TILE, 16)


def nearest(row: dict, window: np.ndarray, rect: Rect, own: Rect) -> tuple[np.ndarray, np.ndarray]:
    """Samples that a turned image takes for ``own``, halves of places to even, and where there are any; 0 elsewhere."""
    y, x = np.mgrid[own.y0 : own.y1, own.x0 : own.x1].astype(float)
    y, x = (np.rint(v).astype(np.int64) for v in Move.source(row, y, x))
    inside = (y >= 0) & (y < row["h"]) & (x >= 0) & (x < row["w"])
    values = np.zeros((*y.shape, window.shape[2]), window.dtype)
    values[inside] = window[y[inside] - rect.y0, x[inside] - rect.x0]
    return values[..., :-1], values[..., -1] > 0


def bilinear(row: dict, window: np.ndarray, rect: Rect, own: Rect) -> tuple[np.ndarray, np.ndarray]:
    """Samples taken bilinearly at the places of ``own``, and where all four of them exist."""
    y, x = np.mgrid[own.y0 : own.y1, own.x0 : own.x1].astype(float)
    y, x = Move.source(row, y, x)
    y0, x0 = np.floor(y).astype(np.int64), np.floor(x).astype(np.int64)
    there = (y0 >= 0) & (y0 + 1 < row["h"]) & (x0 >= 0) & (x0 + 1 < row["w"])
    taps = [(j, i) for j in (0, 1) for i in (0, 1)]
    there[there] = np.all([window[y0[there] - rect.y0 + j, x0[there] - rect.x0 + i, -1] > 0 for j, i in taps], axis=0)
    values = np.zeros((*y.shape, window.shape[2] - 1))
    if there.any():
        fy, fx = (y - y0)[there][:, None], (x - x0)[there][:, None]
        iy, ix = y0[there] - rect.y0, x0[there] - rect.x0
        at = lambda j, i: window[iy + j, ix + i, :-1].astype(float)
        values[there] = (1 - fy) * ((1 - fx) * at(0, 0) + fx * at(0, 1)) + fy * ((1 - fx) * at(1, 0) + fx * at(1, 1))
    return values, there


def resampled(tiles: DataFrame, transforms: DataFrame, side: int = SIDE, fill: DataFrame | None = None) -> DataFrame:
    """Tiles of bytes, moved and turned by (image_id, frame, dx, dy, c, s), bilinear, in one exchange behind the join.  What is not between four
    pixels is black, or that of the tiles ``fill`` of the same keys.  The pixels are those of ``fill``, or else of the tiles themselves.  An image
    that stays where it is is kept as it is."""
    filled = fill is not None

    def work(row, window, rect, base):
        own = rect_of(row, side)
        behind = base[..., :-1] if filled else np.zeros_like(base[..., :-1])
        if row["dx"] is None:  # nothing of the source comes here
            return [_tile(row, behind, base[..., -1])]
        if row["dx"] == row["dy"] == 0 and abs(row["s"]) < 1e-5:
            here = own.of(window, rect.y0, rect.x0)
            return [_tile(row, np.where(here[..., -1:] > 0, here[..., :-1], behind), base[..., -1])]
        values, there = bilinear(row, window, rect, own)
        out = np.rint(np.floor(values * 1e6 + 0.5) / 1e6).clip(0, 255).astype(np.uint8)
        return [_tile(row, np.where(there[..., None], out, behind), base[..., -1])]

    moved = tiles.join(transforms.select("image_id", "frame", *[F.col(c).cast("double").alias(c) for c in ("dx", "dy", "c", "s")]), ["image_id", "frame"])
    return windows(moved, Move(2), work, TILE, side, "u1", fill if filled else tiles, "u1", "dx double, dy double, c double, s double")
