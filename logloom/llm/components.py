"""Connected components by alternating large and small stars, without gathering any component in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, packed, work_dir


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node of an edge, its component named by the smallest node in it.

    Each round links every node's larger neighbours to its smallest one, and then all its smaller ones; the
    number of rounds grows with the logarithm of the longest path. Rounds are written to the shared folder, and
    older ones removed. Nulls, loops and repeated edges don't matter.
    """
    spark = edges.sparkSession
    root = work_dir(spark, "components")
    start = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    start.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct().write.parquet(f"{root}/0")
    schema = spark.read.parquet(f"{root}/0").schema
    now = spark.read.schema(schema).parquet(f"{root}/0")
    state, k = _state(now), 0
    n = 2 * state[0]  # no round has more edges, taken in both directions
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # least neighbours are tables of their own, so that adaptive execution can split the edges of a node that has many
        packed(both.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("m")), n).write.parquet(f"{root}/{k}-least")
        least = spark.read.parquet(f"{root}/{k}-least")
        large = both.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        packed(large, n).write.parquet(f"{root}/{k}-large")
        large = spark.read.parquet(f"{root}/{k}-large")
        packed(large.groupBy("a").agg(F.min("b").alias("m")), n).write.parquet(f"{root}/{k}-least-large")
        least = spark.read.parquet(f"{root}/{k}-least-large")
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b")))).alias("e"))
        k += 1
        packed(small.select("e.a", "e.b").where(F.col("a") != F.col("b")).distinct(), 2 * n).write.parquet(f"{root}/{k}")
        now = spark.read.schema(schema).parquet(f"{root}/{k}")
        for name in ("", "-least", "-large", "-least-large"):
            dropped(spark, f"{root}/{k - 1}{name}")
        if (after := _state(now)) == state:
            break
        state = after
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return packed(now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots), n)
