"""Connected components of a table of links, by alternating large-star and small-star rounds on the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def connected(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``root`` (the least node it is linked with, itself left out as a node) from pairs of any order.

    Loops and repeated links have no effect, nulls are left out, an empty table gives none.  No neighbourhood is gathered:
    each round takes minima by group and joins them back, and is written to the shared folder.
    """
    pairs = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    pairs, before = common.staged(pairs, "links"), None
    while True:
        print_of = pairs.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if print_of == before or not print_of[0]:
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = print_of
        # large star: every larger neighbour is linked to the least of node and neighbours
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # small star: node and its smaller neighbours are linked to the least of these
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        pairs = common.staged(small.distinct(), "links")
