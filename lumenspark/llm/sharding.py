"""Sharding by proportional stratified interleaving, in DataFrame operations.

Rows are shuffled within their source by a seeded hash and ranked; row number r of n has the fractional rank (r + u) / n,
with u a seeded fraction for the source.  Sorted by fractional rank, any stretch holds every source in proportion, so the
sorted rows are cut into shards whose row counts differ by one at most: law ``rows``.

No rank needs a whole source, or all rows, in one task: rows fall into buckets by their hash, then by their fractional rank.
Both are uniform, so buckets stay small however rows spread over sources; ranks are counts of the buckets before plus the
number within the bucket.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Overhead of a row in bytes, and rows that a bucket should have.
ROW_BYTES, BUCKET_ROWS = 16, 20_000
#: Bounds of the number of buckets; with the upper one the table of bucket counts is still small enough to broadcast.
LEAST_BITS, MOST_BITS = 8, 16


def shards(docs: DataFrame, n_shards: int = 40, seed: int = 17, key: str = "doc_id", text: str = "text", stratum: str = "source") -> DataFrame:
    """key, size, text_crc32, law, shard, slot and grown_shard of every row.

    A null text has no bytes and the checksum of none; a null source is a source of its own; equal rows are told apart by
    place only, so that any order of them gives the same result; an empty table gives no rows; other columns aren't read.
    """
    total = docs.count()
    bits = min(MOST_BITS, max(LEAST_BITS, (total // BUCKET_ROWS).bit_length()))
    raw = F.encode(F.coalesce(docs[text], F.lit("")), "UTF-8")

    def hashed(*parts):
        """60 bits of a digest."""
        return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])), 1, 15), 16, 10).cast("long")

    rows = docs.select(docs[key].alias("k"), (F.length(raw) + ROW_BYTES).cast("long").alias("size"), F.crc32(raw).alias("crc"), F.coalesce(F.concat(F.lit("s"), docs[stratum]), F.lit("n")).alias("s"))
    rows = rows.select("*", hashed(F.col("k"), F.col("crc"), F.col("s")).alias("h"))
    rows = rows.withColumn("b", F.shiftright("h", 60 - bits).cast("int"))
    within = Window.partitionBy("s").orderBy("b")
    counts = rows.groupBy("s", "b").count().select("s", "b", (F.sum("count").over(within) - F.col("count")).alias("before"), F.sum("count").over(Window.partitionBy("s")).alias("n"))
    numbered = rows.withColumn("r", F.row_number().over(Window.partitionBy("s", "b").orderBy("h", "k", "crc", "size")))
    offset = hashed(F.col("s"), F.lit("offset")) / F.lit(float(1 << 60))
    ranked = numbered.join(counts, ["s", "b"]).select("k", "size", "crc", "s", "h", ((F.col("before") + F.col("r") - 1 + offset) / F.col("n")).alias("f"))
    ranked = ranked.withColumn("g", F.least(F.floor(F.col("f") * (1 << bits)), F.lit((1 << bits) - 1)).cast("int"))

    # one row for each of at most 2 ** MOST_BITS buckets
    cells = ranked.groupBy("g").count()
    cells = cells.select(F.col("g").alias("cell"), (F.sum("count").over(Window.orderBy("g")) - F.col("count")).alias("start"))
    place = F.col("start") + F.row_number().over(Window.partitionBy("g").orderBy("f", "s", "h", "k", "crc", "size")) - 1
    cut = ranked.join(F.broadcast(cells), F.col("g") == F.col("cell")).withColumn("p", place)
    cut = cut.withColumn("shard", F.expr(f"cast(p * {n_shards}L div {max(total, 1)}L as int)"))
    first = F.expr(f"(shard * {max(total, 1)}L + {n_shards - 1}L) div {n_shards}L")
    return cut.select(F.col("k").alias(key), "size", F.col("crc").alias("text_crc32"), F.lit("rows").alias("law"), "shard", (F.col("p") - first).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
