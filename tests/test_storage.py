"""Least squares by factors, and stored rasters."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lumenspark.operators.least_squares import least_squares
from lumenspark.sources import raster_store


def test_least_squares_of_a_hard_design(spark):
    """Columns so alike that their products lose half the digits; groups of any size, one that all tasks have a part of."""
    r = np.random.default_rng(5)
    parts = []
    for key, n in ((1, 20_000), (2, 300), (None, 50), (3, 2)):
        t = r.uniform(0, 1, n)
        parts.append(pd.DataFrame({"g": [key] * n, "a": t, "b": t + 1e-5 * r.uniform(0, 1, n), "y": 3 * t - 7e4 * (t * 1e-5) + r.normal(0, 0.1, n)}))
    rows = pd.concat(parts)
    df = spark.createDataFrame([(None if pd.isna(g) else int(g), float(a), float(b), float(y)) for g, a, b, y in rows.itertuples(index=False)] + [(1, None, 1.0, 1.0)], "g long, a double, b double, y double").repartition(7)
    found = {x.g: x for x in least_squares(df, "g", ["1", "a", "b"], "y").collect()}
    assert set(found) == {1, 2, 3, None} and sum(x.n for x in found.values()) == len(rows)
    for key, x in found.items():
        own = rows[rows.g.isna()] if key is None else rows[rows.g == key]
        design = np.column_stack([np.ones(len(own)), own.a, own.b])
        expected, rss, _, _ = np.linalg.lstsq(design, own.y, rcond=None)
        if key != 3:
            assert np.abs(np.array(x.coefficients) - expected).max() <= 1e-9 * np.abs(expected).max() and x.rss == pytest.approx(float(rss[0]), rel=1e-9)
        else:  # fewer rows than columns: the fit is exact
            assert np.abs(design @ x.coefficients - own.y).max() < 1e-8
    assert least_squares(df.filter("false"), "g", ["1"], "y").count() == 0


def test_rows_of_a_store(spark, tmp_path):
    grid = spark.range(40).select(F.col("id").alias("image_id"), F.explode(F.sequence(F.lit(0), F.lit(599), F.lit(3))).alias("y")).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(3))))
    pixels = grid.select("*", *[(F.col("image_id") + F.col("y") * k + F.col("x")).cast("int").alias(c) for k, c in enumerate("rgb")])
    path = f"file://{tmp_path}/store"
    raster_store.write(pixels, path)
    key = lambda df: sorted(map(tuple, df.select("image_id", "y", "x", "r", "g", "b").collect()))
    assert key(raster_store.read(spark, path)) == key(pixels)
    row = raster_store.read(spark, path, 17, (300, 301))
    assert key(row) == key(pixels.filter("image_id = 17 AND y = 300")) and row.count() == 4
    # one folder of nine is read, whatever the number of images
    plan = row._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(image_block" in plan and "line_block" in plan.split("PartitionFilters")[1]
    times = {f: f.stat().st_mtime_ns for f in (tmp_path / "store").rglob("*.parquet")}
    fresh = pixels.filter("image_id IN (17, 18) AND y = 300").withColumn("r", F.lit(-1))
    raster_store.replace_rows(fresh, path)
    expected = pixels.withColumn("r", F.when(F.col("image_id").isin(17, 18) & (F.col("y") == 300), -1).otherwise(F.col("r")))
    assert key(raster_store.read(spark, path)) == key(expected)
    kept = {f for f in (tmp_path / "store").rglob("*.parquet") if times.get(f) == f.stat().st_mtime_ns}
    assert len(kept) == len(times) - 1 and not (tmp_path / "store_fresh").exists()
