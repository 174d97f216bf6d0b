"""Running values over ordered groups of any size.

A window puts each group on one task. That is right for most groups, and wrong for the wallet, the market or the
whole table that holds a large part of all rows. ``ordered`` counts the groups first. Those under the limit get the
plain window. The others are range-partitioned by (group, order) into sorted runs of about equal size; each run is
scanned on its own, and the value that the earlier runs of the group pass on comes from a table with one row per run.
The length of a run follows the limit; the number of tasks follows the rows, so a low limit cuts finer but asks for no
more tasks.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce
from math import ceil

from pyspark.sql import Column, DataFrame, Window, functions as F

from augury.session import materialise, rows_per_task

_STEP = {
    "sum": F.sum,
    "max": F.max,
    "min": F.min,
    "last": lambda c: F.last(c, ignorenulls=True),
}


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Equi-join on ``keys`` in which NULL equals NULL; the right keys are dropped."""
    if not keys:
        return left.crossJoin(right)
    renamed = right.select(*[F.col(k).alias(f"_r_{k}") if k in keys else F.col(k) for k in right.columns])
    condition = reduce(lambda a, b: a & b, [left[k].eqNullSafe(renamed[f"_r_{k}"]) for k in keys])
    return left.join(renamed, condition, how).drop(*[f"_r_{k}" for k in keys])


# Most rows of a table of groups or runs that is sent to every task.
BROADCAST_ROWS = 10_000


def group_sizes_over(df: DataFrame, by: list[str], limit: int) -> DataFrame:
    """The groups with more than ``limit`` rows, and their sizes in ``count``."""
    counts = df.groupBy(*by).count() if by else df.agg(F.count("*").alias("count"))
    return counts.where(F.col("count") > limit)


def totals_over(df: DataFrame, by: list[str], limit: int) -> tuple[int, int]:
    """How many groups have more than ``limit`` rows, and the rows of these."""
    found = group_sizes_over(df, by, limit).agg(F.count("*").alias("n"), F.coalesce(F.sum("count"), F.lit(0)).alias("rows")).first()
    return found["n"], found["rows"]


def small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` of at most ``rows`` rows, marked to be sent to every task if these are few."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


@dataclass(frozen=True)
class OrderedRows:
    by: list[str]
    order: list[str]
    whole: DataFrame | None  # groups that fit a task
    runs: DataFrame | None  # larger groups, cut into runs numbered by _run
    n_runs: int = 0  # most (group, run) pairs

    def _window(self, *extra: str):
        return Window.partitionBy(*self.by, *extra).orderBy(*self.order)

    def _carry(self, how: str, value: Column) -> DataFrame:
        """Per run, the value that the earlier runs of its group end with."""
        if how == "last":
            position = F.struct(*[F.col(c) for c in self.order])
            total = F.max_by(value, F.when(value.isNotNull(), position))
        else:
            total = _STEP[how](value)
        ends = self.runs.groupBy(*self.by, "_run").agg(total.alias("_end"))
        earlier = Window.partitionBy(*self.by).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
        return ends.select(*self.by, "_run", _STEP[how](F.col("_end")).over(earlier).alias("_carry"))

    def _with_carry(self, how: str, value: Column) -> DataFrame:
        return null_safe_join(self.runs, small(self._carry(how, value), self.n_runs), [*self.by, "_run"], "left")

    def running(self, how: str, value: Column, out: str) -> "OrderedRows":
        """Add the running ``sum``, ``max``, ``min`` or last non-null value up to and including the row."""
        rows = (Window.unboundedPreceding, Window.currentRow)
        whole, runs = self.whole, self.runs
        if whole is not None:
            whole = whole.withColumn(out, _STEP[how](value).over(self._window().rowsBetween(*rows)))
        if runs is not None:
            here = _STEP[how](value).over(self._window("_run").rowsBetween(*rows))
            scanned = self._with_carry(how, value).withColumn(out, here)
            here, carry = F.col(out), F.col("_carry")
            merged = {
                "sum": lambda: F.coalesce(here + carry, here, carry),
                "max": lambda: F.greatest(here, carry),
                "min": lambda: F.least(here, carry),
                "last": lambda: F.coalesce(here, carry),
            }[how]()
            runs = scanned.withColumn(out, merged).drop("_carry")
        return replace(self, whole=whole, runs=runs)

    def previous(self, value: Column, out: str) -> "OrderedRows":
        """Add the value of the row before, NULL included; the first row of a group gets NULL."""
        whole, runs = self.whole, self.runs
        if whole is not None:
            whole = whole.withColumn(out, F.lag(value).over(self._window()))
        if runs is not None:
            # In a struct a NULL value differs from no row before: only the first row of a run takes the carry.
            boxed = F.struct(value.alias("v"))
            scanned = self._with_carry("last", boxed).withColumn(out, F.lag(boxed).over(self._window("_run")))
            runs = scanned.withColumn(out, F.coalesce(F.col(out), F.col("_carry"))["v"]).drop("_carry")
        return replace(self, whole=whole, runs=runs)

    @property
    def df(self) -> DataFrame:
        parts = [p for p in (self.whole, self.runs.drop("_run") if self.runs is not None else None) if p is not None]
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def ordered(
    df: DataFrame,
    by: list[str],
    order: list[str],
    limit: int | None = None,
    sizes_from: DataFrame | None = None,
    all_fit: bool = False,
) -> OrderedRows:
    """Prepare ``df`` for running values within ``by`` along ``order``.

    ``order`` must end with a unique key: it makes the result repeatable and lets any group be cut.
    ``sizes_from`` is a cheaper table with the same groups to count instead of ``df``; ``all_fit`` skips the count
    where the caller has shown that no group is over the limit.
    """
    spark = df.sparkSession
    limit, counted = limit or rows_per_task(spark), df if sizes_from is None else sizes_from
    groups, rows = (0, 0) if all_fit else totals_over(counted, by, limit)
    if not groups:
        return OrderedRows(by, order, df, None)
    whole, cut = None, df
    if by:
        keys = small(materialise(group_sizes_over(counted, by, limit).select(*by), "large"), groups)
        whole = null_safe_join(df, keys, by, "left_anti")
        cut = null_safe_join(df, keys, by, "left_semi")
    wide = max(int(spark.conf.get("spark.sql.shuffle.partitions")), ceil(rows / rows_per_task(spark)))
    pieces = min(ceil(rows / limit), wide) + 1
    ranged = cut.repartitionByRange(pieces, *by, *order).sortWithinPartitions(*by, *order)
    # These ids count the rows of a partition from a start that is far above the partition before: a run of ``limit`` ids
    # holds neighbours of one partition.
    ranged = ranged.withColumn("_run", F.expr(f"monotonically_increasing_id() div {limit}"))
    # Written once, because the run numbers must be the same for the scan and for the table of carried values.
    return OrderedRows(by, order, whole, materialise(ranged, "runs"), groups + ceil(rows / limit) + pieces)
