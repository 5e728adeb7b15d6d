"""The batch: a folder of image files in, brackets merged to ``Hdr/`` and single images mapped to ``Single/`` of another folder.

All images are one job each for brackets of one size and for singles; nothing loops over files.
"""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import pixel as px
from .functions.dialect import chain, spark_text
from .operators import brackets, catalog, mapping, registration, steps
from .plans.response import bracket_to_bytes
from .sources import image_files, images
from .sources.settings import NaturalSettings, Settings, from_xml, load_presets
from .storage import Stage

log = logging.getLogger("lumenspark.batch")


def cataloged(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Pixels of the files, and their metadata with folder and name."""
    source = image_files.registered(spark).read.format("images")
    parts = F.regexp_extract("source", "^(.*)/([^/]*)$", 1), F.regexp_extract("source", "^(.*)/([^/]*)$", 2)
    return source.option("rows", "pixels").load(folder), spark.read.format("images").load(folder).withColumnRenamed("path", "source").withColumns({"folder": parts[0], "path": parts[1]})


def series_of(frames: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members of series (source, series, frame from 0, loge) with the size of each, and the sources of singles.

    A single that is named like a series joins it as its first frame.
    """
    spark = frames.sparkSession
    steps_ = [("catalog", "SELECT folder, path, bias, width, height FROM {frames}"), *catalog.series("catalog"), *catalog.named()]
    joined = "SELECT folder, first_path, path, 1 AS rank FROM members UNION ALL SELECT folder, first_path, path, 0 AS rank FROM merged_named"
    members = spark.sql(spark_text(chain([*steps_, ("result", f"SELECT folder, first_path, path, cast(row_number() OVER (PARTITION BY folder, first_path ORDER BY rank, path) - 1 AS int) AS frame, cast(count(*) OVER (PARTITION BY folder, first_path) AS int) AS size FROM ({joined}) j")])), frames=frames)
    light = F.when(F.col("iso").isNull() | F.col("f_number").isNull() | F.col("exposure_time").isNull(), F.lit(-1.0)).otherwise(F.ln("exposure_time") + F.ln(F.col("iso") / 100) - 2 * F.ln("f_number"))
    named = frames.select("folder", "path", "source", light.alias("loge"))
    members = members.join(named, ["folder", "path"]).withColumn("series", F.concat_ws("/", "folder", "first_path"))
    return members, named.join(members.select("folder", "path"), ["folder", "path"], "left_anti")


def process(spark: SparkSession, folder: str, out: str, settings: Settings | None = None, samples: int = 1000, smooth: float = 300.0, motion: float = 80.0, align: bool = True, subpixel: bool = False) -> None:
    """Files for brackets and for singles, in ``Hdr`` and ``Single`` of ``out``; metadata blocks are copied from the first or only file.

    Frames are moved onto the first one of their bracket before they are merged, unless ``align`` is false; ``subpixel`` refines the shifts.
    """
    settings = settings or NaturalSettings()
    pixels, frames = cataloged(spark, folder)
    stage = Stage(spark, "batch")  # files are listed and decoded once
    frames = stage.put(frames)
    members, singles = map(stage.put, series_of(frames))
    read = stage.put(pixels.withColumnRenamed("path", "source"))
    blocks = frames.select("source", "exif")
    for row in members.select("size").distinct().orderBy("size").collect():
        of_size = members.filter(F.col("size") == row["size"])
        bracket = read.join(of_size.select("source", "series", "frame", "loge"), "source").select(F.xxhash64("series").alias("image_id"), "frame", "y", "x", "r", "g", "b", "loge")
        if align:
            lights = of_size.select(F.xxhash64("series").alias("image_id"), "frame", "loge")
            moved, _, aligned = registration.align(bracket, subpixel)
            bracket = stage.put(moved.join(lights, ["image_id", "frame"]))
            aligned.clear()
        heads = of_size.filter("frame = 0").select(F.xxhash64("series").alias("image_id"), "source", "path")
        done = images.encode(bracket_to_bytes(bracket, row["size"], settings, samples, smooth, motion), exif=heads.join(blocks, "source"))
        _written(done.join(heads, "image_id"), f"{out}/Hdr")
        log.info("brackets of %d frames written", row["size"])
    heads = singles.select(F.xxhash64("source").alias("image_id"), "source", "path")
    unit = read.join(heads.select("source", "image_id"), "source").select("image_id", "y", "x", *[(F.col(c) / 255.0).alias(c) for c in px.RGB])
    mapped = steps.apply(mapping.tone_map(unit, settings), [("result", mapping.quantized("pixels"))])
    _written(images.encode(mapped, exif=heads.join(blocks, "source")).join(heads, "image_id"), f"{out}/Single")
    log.info("single images written")
    stage.clear()


def _written(done: DataFrame, folder: str) -> None:
    done.select(_name().alias("name"), "content").write.format("images").mode("append").save(folder)


def _name():
    """The name of the file with another ending; files of equal names in two folders are told apart by the key."""
    return F.concat(F.regexp_replace("path", "[.][^.]*$", ""), F.lit("-"), F.substring(F.hex("image_id"), -6, 6), F.lit(".png"))


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("folder")
    parser.add_argument("out")
    parser.add_argument("--settings", help="settings file (XML)")
    parser.add_argument("--presets", help="folder of saturation filters")
    parser.add_argument("--log", help="file for the log")
    parser.add_argument("--no-align", action="store_true", help="merge frames as they are")
    parser.add_argument("--subpixel", action="store_true", help="shifts in quarters of a pixel")
    given = parser.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(levelname)s %(message)s", filename=given.log)
    settings = NaturalSettings()
    if given.settings:
        with open(given.settings) as f:
            settings = from_xml(f.read())
    settings = mapping.with_presets(settings, load_presets(given.presets or settings.saturation_filter_presets_directory))
    spark = SparkSession.builder.appName("lumenspark batch").getOrCreate()
    process(spark, given.folder, given.out, settings, align=not given.no_align, subpixel=given.subpixel)
    spark.stop()


if __name__ == "__main__":
    main()
