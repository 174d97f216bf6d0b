"""Isotonic regression by ranges: adjacent violators are pooled run by run, then between the runs.

Rows with equal x are one weighted row. The rows of a group are cut into sorted ranges; each is pooled on its own, which
leaves one row for each level of its step function. Pooling what is pooled already changes nothing, so pooling the
levels of neighbouring ranges together gives the fit of all rows. Ranges are merged in rounds, a fixed number at a time,
until each group has one; only levels move between rounds, never rows.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from augury.session import materialise, rows_per_task

LEVELS = "`group` int, run bigint, low double, high double, level double, weight double"
MERGED = 16  # ranges pooled together in one round


def pool(low: np.ndarray, high: np.ndarray, level: np.ndarray, weight: np.ndarray) -> list[tuple[float, float, float, float]]:
    """Levels of the rising step function nearest to rows in order of x: (first x, last x, level, weight)."""
    out: list[list[float]] = []
    for a, b, y, w in zip(low.tolist(), high.tolist(), level.tolist(), weight.tolist()):
        total = y * w
        while out and out[-1][2] * w >= total * out[-1][3]:  # the level before is not lower
            first = out.pop()
            a, total, w = first[0], total + first[2], w + first[3]
        out.append([a, b, total, w])
    return [(a, b, t / w, w) for a, b, t, w in out]


def _pooled(table: pa.Table) -> pa.Table:
    table = table.sort_by("low")
    columns = [table.column(c).to_numpy() for c in ("low", "high", "level", "weight")]
    rows = pool(*columns)
    group, run = table.column("group")[0].as_py(), table.column("run")[0].as_py()
    low, high, level, weight = (pa.array([r[k] for r in rows], pa.float64()) for k in range(4))
    return pa.table({"group": pa.array([group] * len(rows), pa.int32()), "run": pa.array([run] * len(rows), pa.int64()), "low": low, "high": high, "level": level, "weight": weight})


def levels(rows: DataFrame, x: str, y: str, group: str | None = None, weight: str | None = None, limit: int | None = None) -> DataFrame:
    """``group, low, high, level, weight``: the step function of each group.

    Rows with a NULL or NaN x or y are left out; NULL groups aren't expected. ``limit``: rows of one range.
    """
    spark = rows.sparkSession
    limit = limit or rows_per_task(spark)
    number = F.lit(0) if group is None else F.col(group).cast("int")
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    value = rows.select(number.alias("group"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), w.alias("w"))
    value = value.where(F.col("x").isNotNull() & ~F.isnan("x") & F.col("y").isNotNull() & ~F.isnan("y") & (F.col("w") > 0))
    single = value.groupBy("group", "x").agg((F.sum(F.col("y") * F.col("w")) / F.sum("w")).alias("level"), F.sum("w").alias("weight"))
    single = materialise(single, "scores")
    pieces = max(1, ceil(single.count() / limit))
    # Each partition is one range of (group, x); a group's rows in it are one run.
    ranged = single.repartitionByRange(pieces, "group", "x").withColumn("run", F.spark_partition_id().cast("bigint"))
    now = materialise(ranged.select("group", "run", F.col("x").alias("low"), F.col("x").alias("high"), "level", "weight"), "runs")
    while True:
        now = materialise(now.groupBy("group", "run").applyInArrow(_pooled, LEVELS), "levels")
        most = now.groupBy("group").agg(F.count_distinct("run").alias("n")).agg(F.max("n")).first()[0]
        if not most or most == 1:
            return now.drop("run")
        now = now.withColumn("run", F.floor(F.col("run") / MERGED))


@dataclass(frozen=True)
class Isotonic:
    """A fitted step function, straight between its levels and flat beyond them."""

    x: list[float]
    y: list[float]

    def predict(self, column: Column) -> Column:
        xs, ys = np.array(self.x), np.array(self.y)

        @F.pandas_udf("double")
        def at(values: pd.Series) -> pd.Series:
            return pd.Series(np.interp(values.to_numpy(float), xs, ys))

        return at(column)

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame([(json.dumps([self.x, self.y]),)], "value string").coalesce(1).write.mode("overwrite").text(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> "Isotonic":
        return Isotonic(*json.loads(spark.read.text(path).first()[0]))


def fit(rows: DataFrame, x: str, y: str, group: str | None = None, weight: str | None = None, limit: int | None = None) -> dict[int, Isotonic]:
    """The step function of each group. As with Spark's own model, its levels are kept on the driver."""
    found: dict[int, list] = {}
    for r in levels(rows, x, y, group, weight, limit).collect():
        found.setdefault(r["group"], []).append((r["low"], r["high"], r["level"]))
    out = {}
    for g, steps in found.items():
        points = [(p, v) for low, high, v in sorted(steps) for p in ((low,) if low == high else (low, high))]
        out[g] = Isotonic([p for p, _ in points], [v for _, v in points])
    return out
