"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import fresh_path, remove_path


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable from each node that has an edge.

    Every step joins the edges with the smallest neighbour of each node, which is
    aggregated on the map side, so a node with very many edges never meets in one group.
    Loops and null ends are ignored; without edges the result is empty. Each round is
    written to the shared folder, so lost executors cost one round at most.
    """
    now = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    spark = edges.sparkSession
    now = now.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    path = fresh_path(spark, "edges")
    now.write.parquet(path)
    now = spark.read.schema(now.schema).parquet(path)
    before = None
    while True:
        # u > v throughout. Large star: every larger neighbour of a node moves to its smallest.
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        large = now.select(F.col("u").alias("w"), F.col("v").alias("u")).join(least, "u").select("w", "m")
        large = large.distinct()
        # Small star: a node's smaller neighbours, and the node, move to the smallest of them.
        low = large.groupBy("w").agg(F.min("m").alias("m"))
        moved = large.withColumnRenamed("m", "v").join(low, "w")
        small = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(moved.select(F.col("w").alias("u"), F.col("m").alias("v")))
        last, path = path, fresh_path(spark, "edges")
        small.where("u <> v").distinct().write.parquet(path)
        now = spark.read.schema(now.schema).parquet(path)
        remove_path(spark, last)
        state = tuple(now.agg(F.count("*"), F.sum(F.hash("u", "v").cast("decimal(38,0)")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before:
            break
        before = state
    ends = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    # the last round's table stays: the result reads it
    return ends.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
