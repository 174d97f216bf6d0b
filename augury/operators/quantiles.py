"""Exact quantiles and ranks, for groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from augury.operators.ordered import null_safe_join, ordered, totals_over
from augury.operators.sketches import approximate_percentiles
from augury.session import materialise, rows_per_task

# Most rows per group for the built-in exact percentile, which keeps all values of a group in one task's memory, and for
# rank windows, which keep the rows of a group there.
IN_MEMORY_ROWS = 250_000


def value_ranks(df: DataFrame, cols: list[str], by: list[str], limit: int | None = None) -> DataFrame:
    """One row per distinct value: (by, name, value, count, upto, n), with ``upto`` the number of rows at or below it.

    Equal values are merged before anything is ordered; the ordering then runs over runs of bounded size.
    """
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in cols]))
    long = df.select(*by, cells.alias("cell")).select(*by, "cell.name", "cell.value").where("value is not null")
    counts = materialise(long.groupBy(*by, "name", "value").count(), "values")
    ranked = ordered(counts, [*by, "name"], ["value"], limit).running("sum", F.col("count"), "upto").df
    totals = counts.groupBy(*by, "name").agg(F.sum("count").alias("n"))
    return null_safe_join(ranked, totals, [*by, "name"], "inner")


def percentiles(
    df: DataFrame, cols: list[str], probs: list[float], by: list[str] | None = None, limit: int | None = None,
    approx: bool = False,
) -> DataFrame:
    """Linearly interpolated quantiles; NULLs are ignored. One row per group, one array per column.

    Groups that fit a task use the built-in exact aggregate. Larger ones are ranked by distributed counts. ``approx``
    takes them from sketches instead, with a bounded error in rank.
    """
    by = list(by or [])
    if approx:
        return approximate_percentiles(df, cols, probs, by)
    limit = limit or rows_per_task(df.sparkSession)
    if not totals_over(df, by, min(limit, IN_MEMORY_ROWS))[0]:
        return df.groupBy(*by).agg(*[F.percentile(c, probs).alias(c) for c in cols])
    ranked = value_ranks(df, cols, by, limit)
    picked = ranked.groupBy(*by, "name").agg(
        *[
            F.max(F.when((F.col("upto") - F.col("count") <= at) & (at < F.col("upto")), F.col("value"))).alias(out)
            for i, p in enumerate(probs)
            for out, at in (
                (f"lo{i}", F.floor((F.col("n") - 1) * F.lit(p))),
                (f"hi{i}", F.ceil((F.col("n") - 1) * F.lit(p))),
            )
        ],
        F.first("n").alias("n"),
    )
    between = [
        F.col(f"lo{i}") + (F.col(f"hi{i}") - F.col(f"lo{i}")) * ((F.col("n") - 1) * F.lit(p) - F.floor((F.col("n") - 1) * F.lit(p)))
        for i, p in enumerate(probs)
    ]
    values = picked.select(*by, "name", F.array(*between).alias("q"))
    found = values.groupBy(*by).agg(*[F.first(F.when(F.col("name") == c, F.col("q")), True).alias(c) for c in cols])
    # Groups without any value keep their row, as in the built-in aggregate.
    return null_safe_join(df.select(*by).distinct(), found, by, "left") if by else found


def percent_ranks(
    df: DataFrame, cols: dict[str, str], by: list[str] | None = None, limit: int | None = None
) -> DataFrame:
    """Add, per entry ``column: out``, the average rank of ties divided by the number of values of the group.

    NULLs have no rank and don't count; rows with a NULL key form a group.
    """
    by = list(by or [])
    limit = limit or rows_per_task(df.sparkSession)
    if not totals_over(df, by, min(limit, IN_MEMORY_ROWS))[0]:
        group = Window.partitionBy(*by)
        ranks = [
            F.when(
                F.col(c).isNotNull(),
                (F.rank().over(group.orderBy(F.col(c).asc_nulls_last())) + (F.count("*").over(Window.partitionBy(*by, c)) - 1) / 2.0)
                / F.count(c).over(group),
            ).alias(out)
            for c, out in cols.items()
        ]
        return df.select("*", *ranks)
    ranked = value_ranks(df, list(cols), by, limit)
    share = (F.col("upto") - F.col("count") + (F.col("count") + 1) / 2.0) / F.col("n")
    for c, out in cols.items():
        one = ranked.where(F.col("name") == c).select(*by, F.col("value").alias(c), share.alias(out))
        df = null_safe_join(df, one, [*by, c], "left")
    return df
