"""Connected components of a link table, by alternating large-star and small-star steps on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemask.llm.common import drop_dir, shared_dir


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Links every neighbour (large: the greater ones; small: the smaller ones and the node itself) to the least of node and neighbours."""
    both = links.union(links.select("v", "u")).toDF("u", "v")
    if not large:
        both = both.filter("v < u")
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    least = least.select(F.col("u").alias("_u"), F.least("u", "m").alias("m"))
    joined = both.join(least, F.col("u") == F.col("_u"))
    if large:
        out = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("_u", "m"))
    return out.filter("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """node and root (the least node of its component) for every node that has a link.

    links: u and v of one orderable type. Each round is written to the shared folder, so a lost executor costs one round;
    only a count and a checksum of the links come to the driver. The number of rounds grows with the logarithm of the size.
    """
    spark = links.sparkSession
    path = shared_dir(spark, "links")
    links.select("u", "v").filter("u <> v").distinct().write.parquet(path)
    seen = None
    while True:
        now = spark.read.parquet(path)
        mark = tuple(now.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first())
        if mark == seen or not mark[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen, before, path = mark, path, shared_dir(spark, "links")
        _star(_star(now, True), False).write.parquet(path)
        drop_dir(spark, before)
