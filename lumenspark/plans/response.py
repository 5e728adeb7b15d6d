"""Camera response: the dense solve of each (series, channel), the one place where rows of a group go to Python (256 x 256)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import pixel as px
from ..functions.dialect import chain, r6, spark_text
from ..operators import brackets, mapping
from ..sources.fixtures import closure, fixtures
from ..storage import Stage

#: Ridge on the diagonal, level whose response is fixed at 0, and its weight.
RIDGE, ANCHOR = 1e-8, 128


def hat(z: np.ndarray) -> np.ndarray:
    return np.exp(-(((z - 128) / 96.0) ** 2))


def solve(normal: np.ndarray, right: np.ndarray, smooth: float = 500.0) -> np.ndarray:
    """g(z) of the 256 levels from the normal equations, with anchor, smoothness by second differences, and ridge."""
    m = normal.copy()
    m[ANCHOR, ANCHOR] += 1.0
    for i in range(254):
        k = smooth * hat(np.array(i + 1.0))
        taps = np.array([k, -2 * k, k])
        m[i : i + 3, i : i + 3] += np.outer(taps, taps)
    m[np.diag_indices(256)] += RIDGE
    return np.linalg.solve(m, right)


def _solver(smooth: float):
    def solved(rows: pd.DataFrame) -> pd.DataFrame:
        normal, right = np.zeros((256, 256)), np.zeros(256)
        cells = rows[rows.zz >= 0]
        normal[cells.z, cells.zz] = cells.v
        sides = rows[rows.zz < 0]
        right[sides.z] = sides.v
        return pd.DataFrame({"image_id": rows.image_id.iloc[0], "channel": rows.channel.iloc[0], "z": np.arange(256), "g": np.round(solve(normal, right, smooth), 6) + 0.0})

    return solved


def curves_of(framed: DataFrame, count: int = 3, samples: int = 500, smooth: float = 500.0, motion: float = 50.0) -> DataFrame:
    """The curve of every series and channel (0 red, 1 green, 2 blue) of framed pixels: sums by level pairs (at most 256 x 257 rows of
    a group) and one solve.  A series without static pixels has none."""
    text = chain([("framed", "SELECT * FROM {src}"), brackets.masked(brackets.motion_alpha(motion), count), *brackets.sample(samples), *brackets.normal_equations(count), ("result", "SELECT image_id, channel, z, zz, sum(v) AS v FROM cells GROUP BY image_id, channel, z, zz")])
    cells = framed.sparkSession.sql(spark_text(text), src=framed)
    return cells.groupBy("image_id", "channel").applyInPandas(_solver(smooth), "image_id long, channel int, z int, g double")


def bracket_to_bytes(bracket: DataFrame, count: int, settings, samples: int = 500, smooth: float = 500.0, motion: float = 50.0) -> DataFrame:
    """Frames (image_id, frame, y, x, r, g, b, loge) to bytes: mask, sample, response of the three channels, merge by it, mapping
    about the average light of the frames.

    The curves of a series are one row of three arrays of 256, joined to its pixels by the series; series without a curve take
    the logarithm of the level.  A pixel that a frame lacks is left out.  The framed pixels and the radiance are stored once each in the
    shared folder: curves, light and statistics read them there.
    """
    spark = bracket.sparkSession
    stage = Stage(spark, "bracket")
    framed = stage.put(spark.sql(spark_text(chain([("bracket", "SELECT * FROM {src}"), brackets.framed("bracket", count), ("result", f"SELECT * FROM framed WHERE {' AND '.join(f'l{f} IS NOT NULL' for f in range(count))}")])), src=bracket))
    curves = curves_of(framed, count, samples, smooth, motion).groupBy("image_id", "channel").agg(F.transform(F.array_sort(F.collect_list(F.struct("z", "g"))), lambda x: x["g"]).alias("g"))
    curves = curves.groupBy("image_id").agg(*[F.max(F.when(F.col("channel") == k, F.col("g"))).alias(f"g_{c}") for k, c in enumerate(px.RGB)])
    lights = spark.sql(spark_text(chain([("framed", "SELECT * FROM {src}"), brackets.scene(count), ("result", "SELECT * FROM scene")])), src=framed)
    merge = brackets.merged(lambda c, z: f"coalesce(get(g_{c}, {z}), ln(({z} + 0.5e0) / 128.5e0))", count, "scene, ")
    text = chain([("framed", "SELECT * FROM {src}"), brackets.masked(brackets.motion_alpha(motion), count), *merge, ("result", "SELECT * FROM merged")])
    merged = stage.put(spark.sql(spark_text(text), src=framed.join(curves, "image_id", "left").join(lights, "image_id")))
    plan = mapping.plan(settings, "merged", hdr=True, scene="scene")
    return spark.sql(spark_text(chain([("merged", "SELECT * FROM {src}"), *plan, ("result", mapping.quantized(plan[-1][0]))])), src=merged)


def _bracket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(spark_text(chain([*closure(["bracket"], fixtures(True, sf_dir)), ("result", "SELECT * FROM bracket")])))


def response_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    framed = spark.sql(spark_text(chain([("bracket", "SELECT * FROM {src}"), brackets.framed(), ("result", "SELECT * FROM framed")])), src=_bracket(spark, sf_dir))
    return curves_of(framed)


def hdr_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brackets to bytes with the solved response."""
    from .registry import NATURAL

    return bracket_to_bytes(_bracket(spark, sf_dir), 3, NATURAL)


def lstsq_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least-squares plane of luminance over (x, y, 1) in each image."""
    return spark.sql(spark_text(chain([*closure(["unit"], fixtures(True, sf_dir)), *plane()])))


def plane() -> list[tuple[str, str]]:
    """The plane from covariances: two unknowns by the rule of Cramer, the third from the means."""
    lum = px.luma()
    means = ", ".join(f"avg({v}) AS {k}" for k, v in (("mx", "x"), ("my", "y"), ("ml", lum), ("mxx", "x * x"), ("mxy", "x * y"), ("myy", "y * y"), ("mxl", f"x * {lum}"), ("myl", f"y * {lum}")))
    return [
        ("means", f"SELECT image_id, {means} FROM unit GROUP BY image_id"),
        ("spreads", "SELECT image_id, mx, my, ml, mxx - mx * mx AS xx, mxy - mx * my AS xy, myy - my * my AS yy, mxl - mx * ml AS xl, myl - my * ml AS yl FROM means"),
        ("slopes", "SELECT *, (xl * yy - yl * xy) / (xx * yy - xy * xy) AS a, (yl * xx - xl * xy) / (xx * yy - xy * xy) AS b FROM spreads"),
        ("result", f"SELECT image_id, {r6('a')} AS a, {r6('b')} AS b, {r6('ml - a * mx - b * my')} AS c FROM slopes"),
    ]


QUERIES = {"response_curve": response_curves, "hdr_pipeline": hdr_pipeline, "lstsq_small": lstsq_small}
