"""Stored rasters of which single rows are read and replaced.

Pixels lie in Parquet folders by block of images and block of lines, sorted by image, line and column within a file.  A row's read looks
into one folder, and there into the row groups whose images and lines match; a row's write replaces that folder alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Images and lines of a block: some 16 million pixels of images 4096 wide.
IMAGES, LINES = 16, 256
ROW_GROUP = 1 << 20
_BLOCKS = ("image_block", "line_block")


def _blocked(pixels: DataFrame) -> DataFrame:
    return pixels.withColumns({"image_block": F.floor(F.col("image_id") / IMAGES).cast("long"), "line_block": F.floor(F.col("y") / LINES).cast("int")})


def _laid(pixels: DataFrame):
    rows = _blocked(pixels).repartition(*_BLOCKS).sortWithinPartitions(*_BLOCKS, "image_id", "y", "x")
    return rows.write.partitionBy(*_BLOCKS).option("parquet.block.size", ROW_GROUP)


def write(pixels: DataFrame, path: str) -> None:
    """All pixels (image_id, y, x and any channels) as a new store; an old one is replaced."""
    _laid(pixels).mode("overwrite").option("partitionOverwriteMode", "static").parquet(path)


def read(spark: SparkSession, path: str, image_id: int | None = None, rows: tuple[int, int] | None = None) -> DataFrame:
    """Pixels of an image, or of all, and of the lines from rows[0] to rows[1] (not included), or of all."""
    df = spark.read.parquet(path)
    if image_id is not None:
        df = df.filter((F.col("image_block") == image_id // IMAGES) & (F.col("image_id") == image_id))
    if rows is not None:
        df = df.filter(F.col("line_block").between(rows[0] // LINES, (rows[1] - 1) // LINES) & (F.col("y") >= rows[0]) & (F.col("y") < rows[1]))
    return df.drop(*_BLOCKS)


def replace_rows(fresh: DataFrame, path: str) -> None:
    """Put the pixels of ``fresh`` (the columns of the store, each place once) in the place of those stored: blocks without fresh pixels are not read
    and not written.  Two writers of one block must not run at a time."""
    spark = fresh.sparkSession
    fresh = _blocked(fresh)
    blocks = fresh.select(*_BLOCKS).distinct()
    # joined by the blocks' folders, so only these are read; their number is that of the row writes
    held = spark.read.parquet(path).join(F.broadcast(blocks), list(_BLOCKS)) if blocks.count() <= 100_000 else spark.read.parquet(path).join(blocks, list(_BLOCKS))
    places = ["image_id", "y", "x"]
    kept = held.join(fresh.select(*places), places, "left_anti")
    out = kept.select(fresh.columns).unionByName(fresh)
    # the result is stored beside first, since a table that is read can't be written
    work = f"{path.rstrip('/')}_fresh"
    out.write.mode("overwrite").parquet(work)
    _laid(spark.read.parquet(work).drop(*_BLOCKS)).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(work)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
