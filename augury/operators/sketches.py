"""Mergeable summaries: distinct counts and quantiles that are stored per load and combined without rereading rows.

Distinct counts use theta sketches, which also say how many values of one set are not in another. Their size is bounded
by ``2 ** LOG_ENTRIES`` entries; up to that many distinct values are counted exactly, beyond it the relative standard
error is one over the square root of the entries. Quantiles use KLL sketches of parameter ``K``; the rank of a returned
value is within ``RANK_ERROR`` of the asked one with 99% confidence. All of it is made and merged in Spark's built-in
aggregates, map side first, so neither a hot key nor many loads bring much to one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

LOG_ENTRIES = 14
K = 400
RANK_ERROR = 0.0067


def count_error(deviations: float = 3.0) -> float:
    """Relative error of a distinct count that is passed over in one case of several hundred."""
    return deviations / 2 ** (LOG_ENTRIES / 2)


def load_sketch(trades: DataFrame) -> DataFrame:
    """One row for a load: its trades, latest time, and sketches of wallets and markets. NULLs and empty market ids count
    as none, as in the exact counts of a load."""
    return trades.agg(
        F.count("*").alias("total_trades"),
        F.max("timestamp").alias("latest_timestamp"),
        F.theta_sketch_agg("address", LOG_ENTRIES).alias("wallets"),
        F.theta_sketch_agg(F.nullif("market_id", F.lit("")), LOG_ENTRIES).alias("markets"),
    )


def merged_loads(loads: DataFrame) -> DataFrame:
    """The loads as one: one row of the same shape."""
    return loads.agg(
        F.coalesce(F.sum("total_trades"), F.lit(0)).alias("total_trades"),
        F.max("latest_timestamp").alias("latest_timestamp"),
        F.theta_union_agg("wallets", LOG_ENTRIES).alias("wallets"),
        F.theta_union_agg("markets", LOG_ENTRIES).alias("markets"),
    )


def distinct(sketch: str) -> Column:
    return F.coalesce(F.theta_sketch_estimate(sketch), F.lit(0).cast("long"))


def sketched_stats(loads: DataFrame) -> DataFrame:
    """Totals of all loads, with estimated distinct counts, from their sketches alone."""
    return merged_loads(loads).select(
        "total_trades", distinct("markets").alias("unique_markets"), distinct("wallets").alias("unique_wallets"), "latest_timestamp"
    )


def new_in_load(before: DataFrame, load: DataFrame) -> DataFrame:
    """Estimated wallets and markets of a load that no earlier load has."""
    both = load.select(F.col("wallets").alias("w"), F.col("markets").alias("m")).crossJoin(F.broadcast(merged_loads(before)))
    fresh = lambda new, old: F.theta_sketch_estimate(F.when(F.col(old).isNull(), F.col(new)).otherwise(F.theta_difference(new, old)))
    return both.select(fresh("w", "wallets").alias("new_wallets"), fresh("m", "markets").alias("new_markets"))


def approximate_percentiles(df: DataFrame, cols: list[str], probs: list[float], by: list[str] | None = None) -> DataFrame:
    """As ``quantiles.percentiles``, in one aggregate of bounded memory; each value is one of the column's own."""
    by = list(by or [])
    sketches = df.groupBy(*by).agg(*[F.kll_sketch_agg_double(F.col(c).cast("double"), K).alias(c) for c in cols])
    asked = F.array(*[F.lit(float(p)) for p in probs])
    value = lambda c: F.when(F.kll_sketch_get_n_double(c) > 0, F.kll_sketch_get_quantile_double(c, asked))
    return sketches.select(*by, *[value(c).alias(c) for c in cols])
