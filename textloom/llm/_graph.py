"""Connected components by alternating large-star and small-star steps, all on executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm import _scratch

#: Steps until the links must be stars; their number grows with the logarithm of the longest chain.
STEPS = 64


def components(edges: DataFrame) -> DataFrame:
    """(node, component): component is the smallest node that links reach. Nodes without an edge don't appear.

    edges: (src, dst) longs, in any direction, with repeats and loops allowed. Every step takes the minimum of a
    node's neighbours with a map-side combine and sends it back by an equi-join whose edge side AQE can split, so a
    hub with very many neighbours is never gathered in one task. Each step's edges are written to the shared folder, and
    those of the step before go.
    """
    spark = edges.sparkSession
    e = edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct()
    (path, now), seen = _scratch.written_at(e, "cc"), None
    for _ in range(STEPS):
        both = now.select("u", "v").unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("x")).select("x.u", F.col("x.m").alias("v")).where("u <> v").distinct()
        old, (path, now) = path, _scratch.written_at(small, "cc")
        _scratch.drop(spark, old)
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError(f"components are not complete after {STEPS} steps")
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
