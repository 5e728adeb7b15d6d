"""The folder batch as a stream: rasters that arrive as Parquet files are tone-mapped, one micro-batch at a time."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.mapping import tone_map
from ..sources.settings import Settings

SCHEMA = "image_id long, y int, x int, r double, g double, b double"


def watch(spark: SparkSession, folder: str, out: str, checkpoint: str, settings: Settings) -> StreamingQuery:
    """An image must arrive in one file or batch: its statistics are taken within the batch.  Batches are written under
    their number, so a repeated one replaces its first try."""

    def write(batch, number):
        tone_map(batch, settings).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return spark.readStream.schema(SCHEMA).parquet(folder).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
