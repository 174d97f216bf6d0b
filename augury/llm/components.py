"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from augury.session import materialise


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root`` for every node of an edge that joins two different nodes; root is the component's smallest node.

    Each step moves edges towards smaller nodes and writes them, so no lineage builds up; a step that changes
    nothing ends it. Edges with a NULL end are ignored. Nothing but counts comes to the driver.
    """
    big, small = F.greatest(a, b).alias("a"), F.least(a, b).alias("b")
    now = materialise(edges.where(F.col(a) != F.col(b)).select(big, small).distinct(), "edges")
    before = None
    while (state := _state(now)) != before and state[0]:
        before = state
        both = now.union(now.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        star = both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        lowest = star.groupBy("a").agg(F.min("b").alias("m"))
        moved = star.join(lowest, "a").select(F.explode(F.array(F.struct("a", "m"), F.struct(F.col("b").alias("a"), "m"))).alias("e"))
        now = materialise(moved.select("e.a", F.col("e.m").alias("b")).where("a != b").distinct(), "edges")
    roots = now.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("root"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
    return row[0], int(row[1])
