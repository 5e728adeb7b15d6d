"""Tiles and the staged alignment against arrays and known moves; the SQL of the queries is checked with all others."""

import numpy as np
import pandas as pd
import pytest

from lumenspark import storage
from lumenspark.operators import alignment as al
from lumenspark.operators import registration, tiles
from lumenspark.plans import aligned, response
from lumenspark.sources import settings as st

SF = "/root/testdata/sf0.001"
INT = "cast({0} AS int) AS {0}"


def pixels(spark, frames, image_id=0):
    """Frames of bytes (h, w) or (h, w, 3)."""
    out = []
    for f, a in frames.items():
        a = a if a.ndim == 3 else np.repeat(a[..., None], 3, 2)
        y, x = np.mgrid[0 : a.shape[0], 0 : a.shape[1]]
        out.append(pd.DataFrame({"image_id": image_id, "frame": f, "y": y.ravel(), "x": x.ravel(), **{c: a[..., k].ravel() for k, c in enumerate("rgb")}}))
    return spark.createDataFrame(pd.concat(out)).selectExpr("cast(image_id AS long) AS image_id", *(INT.format(c) for c in ("frame", "y", "x", "r", "g", "b")))


def array(df, frame):
    rows = df.filter(f"frame = {frame}").toPandas()
    out = np.full((rows.y.max() + 1, rows.x.max() + 1, 3), -1)
    out[rows.y, rows.x] = rows[["r", "g", "b"]]
    return out


def scene(y, x):
    """A smooth image, at any places."""
    return 115 + 45 * np.sin(x / 7.0) * np.cos(y / 9.0) + 30 * np.sin((x + 2 * y) / 13.0) + 20 * np.cos((3 * x - y) / 17.0) + 18 * np.sin(x / 1.9 + y / 7.0) * np.cos(y / 2.3)


def seen(h, w, dx=0.0, dy=0.0, degrees=0.0):
    """What a camera sees that is moved and turned: aligned by (dx, dy) and the angle it is the scene."""
    y, x = np.mgrid[0:h, 0:w].astype(float)
    cy, cx, c, s = (h - 1) / 2, (w - 1) / 2, al.cos(degrees), al.sin(degrees)
    sy, sx = c * (y - cy) + s * (x - cx) + cy, c * (x - cx) - s * (y - cy) + cx  # the inverse turn
    return np.rint(scene(sy + dy, sx + dx)).astype(int)


def test_known_brackets(spark):
    for r in aligned.bracket_transforms(spark, SF).collect():
        expected = (3 - r.image_id % 7, r.image_id % 5 - 2, 0.0) if r.frame == 1 else (0, 0, 1.5)
        assert (r.dx, r.dy) == expected[:2] and abs(r.angle - expected[2]) <= 0.1


def test_large_shift_through_all_levels(spark, monkeypatch):
    plans = []
    put = storage.Stage.put

    def watched(self, df, codec="zstd"):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return put(self, df, codec)

    monkeypatch.setattr(storage.Stage, "put", watched)
    whole = np.random.default_rng(1).integers(16, 240, (544, 704))
    frames = {0: whole[32:512, 32:672], 1: whole[41:521, 19:659]}
    out, found, stage = registration.align(pixels(spark, frames))
    assert [tuple(r)[:6] for r in found.collect()] == [(0, 1, -13.0, 9.0, 0.0, 0.0)]
    assert (array(out, 1)[24:-24, 24:-24] == array(out, 0)[24:-24, 24:-24]).all() and (array(out, 1) >= 0).all()
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    tables = lambda p: p.count("FileScan parquet")
    exchanges = lambda p: sum("Exchange " in line and "Reused" not in line for line in p.split("== Initial Plan ==")[0].splitlines())
    assert max(map(tables, plans)) <= 8 and max(map(exchanges, plans)) <= 10  # of each job, whatever the number of levels
    stage.clear()


@pytest.mark.parametrize("subpixel", [False, True])
def test_moved_and_turned_frames(spark, subpixel):
    plain, off = seen(120, 160), {1: seen(120, 160, 5, -3), 2: seen(120, 160, 0, 0, -1.2), 3: seen(120, 160, 4, 2, 0.8)}
    out, found, _ = registration.align(pixels(spark, {0: plain, **off}), subpixel, side=32)
    moves = {r.frame: r for r in found.collect()}
    assert (moves[1].dx, moves[1].dy, moves[1].angle) == (5, -3, 0)
    assert abs(moves[2].angle + 1.2) <= 0.3 and abs(moves[3].angle - 0.8) <= 0.3
    for f in (1, 2, 3):
        assert np.abs(array(out, f) - plain[..., None])[12:-12, 12:-12].mean() <= 2 < np.abs(off[f] - plain)[12:-12, 12:-12].mean()
    if subpixel:
        half = seen(120, 160, 2.5, -1.25)
        (r,) = registration.align(pixels(spark, {0: plain, 1: half}), True, side=32)[1].collect()
        assert (r.dx, r.dy) == (2.5, -1.25) and r.score > 0.99


def test_merged_as_if_unmoved(spark):
    """A bracket whose frames are moved and turned gives what the one that was held still gives; all frames count, as nothing is taken for motion."""
    lit = lambda a, k: np.clip(a * k, 0, 255).astype(int)
    still = {f: lit(seen(120, 140), k) for f, k in enumerate((0.6, 0.4, 1.2))}
    shaken = {0: still[0], 1: lit(seen(120, 140, 3, 2), 0.4), 2: lit(seen(120, 140, -2, 1, 0.5), 1.2)}
    light = spark.createDataFrame([(f, float(np.log(k))) for f, k in enumerate((0.6, 0.4, 1.2))], "frame int, loge double")
    merged = lambda df: array(response.bracket_to_bytes(df.join(light, "frame"), 3, st.NaturalSettings(), 300, motion=0.0).selectExpr("*", "0 AS frame"), 0)
    expected, moved = merged(pixels(spark, still)), merged(registration.align(pixels(spark, shaken), side=32)[0])
    assert np.abs(moved - expected)[8:-8, 8:-8].mean() <= 2
    assert np.abs(merged(pixels(spark, shaken)) - expected)[8:-8, 8:-8].mean() > 2 * np.abs(moved - expected)[8:-8, 8:-8].mean()


def test_frames_that_cannot_be_aligned(spark):
    a = seen(70, 66)
    small = pixels(spark, {0: a, 1: seen(70, 65), 2: np.full((70, 66), 9)}).unionAll(pixels(spark, {1: a}, 7)).unionAll(pixels(spark, {0: a[:3, :2], 1: a[:3, :2]}, 8))
    out, found, _ = registration.align(small)
    moves = {(r.image_id, r.frame): (r.dx, r.dy) for r in found.collect()}
    assert set(moves) == {(0, 2), (8, 1)} and moves[0, 2] == (0, 0)
    assert out.count() == small.count() and (array(out.filter("image_id = 0"), 1) == array(small.filter("image_id = 0"), 1)).all()
    empty, none, _ = registration.align(small.filter("false"))
    assert empty.count() == none.count() == 0


@pytest.mark.parametrize("side", [8, 64])
def test_tiles_and_back(spark, side):
    r = np.random.default_rng(4)
    a = r.integers(0, 256, (37, 21, 3))
    held = tiles.tiled(pixels(spark, {0: a, 3: a[::-1]}), side, "u1")
    back = tiles.untiled(held, side, "u1", framed=True)
    assert (array(back, 0) == a).all() and (array(back, 3) == a[::-1]).all()
    assert held.count() == 2 * -(-37 // side) * -(-21 // side)


@pytest.mark.parametrize("radius", [1, 13, 100])
def test_box_mean_of_tiles(spark, radius):
    a = np.random.default_rng(6).uniform(0, 1, (30, 26, 3))
    df = pixels(spark, {0: np.arange(780).reshape(30, 26)})
    rows = df.toPandas()
    unit = spark.createDataFrame(rows.assign(**{c: a[rows.y, rows.x, k] for k, c in enumerate("rgb")})).selectExpr("image_id", INT.format("y"), INT.format("x"), "r", "g", "b")
    out = tiles.untiled(tiles.box_mean(tiles.tiled(unit, 8), radius, 8), 8).toPandas()
    means = np.array([a[max(0, y - radius) : y + radius + 1, max(0, x - radius) : x + radius + 1].mean((0, 1)) for y, x in zip(out.y, out.x, strict=True)])
    assert len(out) == 780 and np.abs(out[["r", "g", "b"]].to_numpy() - means).max() < 1e-9


@pytest.mark.parametrize("move", [(0.0, 0.0, 0.0), (3.0, -2.0, 0.0), (0.5, 0.25, 2.0), (-7.0, 4.5, -3.0), (500.0, 0.0, 0.0)])
@pytest.mark.parametrize("fill", [True, False])
def test_resampled_tiles(spark, move, fill):
    a, other = np.random.default_rng(7).integers(0, 256, (2, 29, 35, 3))
    held = tiles.tiled(pixels(spark, {1: a}), 8, "u1")
    dx, dy, angle = move
    moves = spark.createDataFrame([(0, 1, dx, dy, al.cos(angle), al.sin(angle))], "image_id long, frame int, dx double, dy double, c double, s double")
    out = array(tiles.untiled(tiles.resampled(held, moves, 8, tiles.tiled(pixels(spark, {1: other}), 8, "u1") if fill else None), 8, "u1", framed=True), 1)
    y, x = np.mgrid[0:29, 0:35].astype(float)
    sx = al.cos(angle) * (x - dx - 17) + al.sin(angle) * (y - dy - 14) + 17
    sy = al.cos(angle) * (y - dy - 14) - al.sin(angle) * (x - dx - 17) + 14
    if move == (0.0, 0.0, 0.0):
        expected = a
    else:
        sx, sy = np.round(sx, 9), np.round(sy, 9)
        x0, y0 = np.floor(sx).astype(int), np.floor(sy).astype(int)
        there = (x0 >= 0) & (y0 >= 0) & (x0 < 34) & (y0 < 28)
        x0, y0, fx, fy = np.clip(x0, 0, 33), np.clip(y0, 0, 27), (sx - x0)[..., None], (sy - y0)[..., None]
        value = (1 - fy) * ((1 - fx) * a[y0, x0] + fx * a[y0, x0 + 1]) + fy * ((1 - fx) * a[y0 + 1, x0] + fx * a[y0 + 1, x0 + 1])
        expected = np.where(there[..., None], np.rint(value), other if fill else 0)
    assert (out == expected).all()
