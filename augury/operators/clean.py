"""Cleaning rules and data quality reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from augury.operators.joins import cross_scalar, keep_members
from augury.operators.quantiles import percentiles
from augury.sources.tables import normalize_timestamp

# Columns a trade must have, and those where a missing number counts as zero.
REQUIRED = ["address", "market_id", "timestamp"]
ZERO_FILLED = ["amount", "price"]


def format_timestamps(trades: DataFrame) -> DataFrame:
    return normalize_timestamp(trades).where(F.col("timestamp").isNotNull())


def handle_missing(trades: DataFrame) -> DataFrame:
    """Drop rows without a wallet, market or time; missing (or NaN) amounts and prices become 0."""
    return trades.na.drop(subset=REQUIRED).na.fill(0.0, ZERO_FILLED)


def _in_range():
    # NaN is larger than any number here, so it passes ``>=`` unless it is named.
    return F.col("price").between(0.0, 1.0) & (F.col("amount") >= 0.0) & ~F.isnan("amount")


def remove_anomalies(trades: DataFrame) -> DataFrame:
    """Keep prices from 0 to 1 and amounts from 0."""
    return trades.where(_in_range())


def with_volume(trades: DataFrame) -> DataFrame:
    return trades.withColumn("volume", F.col("amount") * F.col("price"))


def trader_totals(trades: DataFrame) -> DataFrame:
    return trades.groupBy("address").agg(
        F.count("transaction_id").alias("trade_count"), F.sum("volume").alias("total_volume")
    )


def active_traders(
    trades: DataFrame, min_trades: int = 10, min_volume: float = 1000.0, top_percentile: float | None = None,
    approx: bool = False,
) -> DataFrame:
    """Totals of the traders with enough trades and volume; optionally only the top share of them by volume (``approx``:
    the bar from a sketch)."""
    active = trader_totals(trades).where((F.col("trade_count") >= min_trades) & (F.col("total_volume") >= min_volume))
    if not top_percentile:
        return active
    bar = percentiles(active, ["total_volume"], [1.0 - top_percentile], approx=approx)
    bar = bar.select(F.col("total_volume")[0].alias("_bar"))
    return cross_scalar(active, bar).where(F.col("total_volume") >= F.col("_bar")).drop("_bar")


def basic_clean(trades: DataFrame) -> DataFrame:
    """The row rules alone. All of them are narrow: no shuffle."""
    return with_volume(remove_anomalies(handle_missing(format_timestamps(trades))))


def filter_active_traders(
    trades: DataFrame, min_trades: int = 10, min_volume: float = 1000.0, top_percentile: float | None = None
) -> DataFrame:
    return keep_members(trades, active_traders(trades, min_trades, min_volume, top_percentile), "address")


def clean(
    trades: DataFrame, min_trades: int = 3, min_volume: float = 50.0, top_percentile: float | None = None
) -> DataFrame:
    """Row rules, then the traders worth keeping. No global sort: users order inside their windows."""
    return filter_active_traders(basic_clean(trades), min_trades, min_volume, top_percentile)


def drop_report(trades: DataFrame) -> DataFrame:
    """Rows each rule drops, in one pass: a row counts for the first rule it breaks."""
    kind = trades.schema["timestamp"].dataType.typeName()
    raw_time = F.col("timestamp")
    timed = normalize_timestamp(trades.withColumn("_raw", raw_time)).na.fill(0.0, ZERO_FILLED)
    bad_time = F.col("timestamp").isNull()
    unparsed = bad_time & F.col("_raw").isNotNull() if kind == "string" else F.lit(False)
    missing = F.col("address").isNull() | F.col("market_id").isNull() | bad_time
    return timed.agg(
        F.count("*").alias("rows"),
        F.count_if(unparsed).alias("dropped_unparsed_time"),
        F.count_if(missing & ~unparsed).alias("dropped_missing"),
        F.count_if(~missing & ~_in_range()).alias("dropped_out_of_range"),
        F.count_if(~missing & _in_range()).alias("kept"),
    )


def validation_report(trades: DataFrame) -> DataFrame:
    """Missing values per column, repeated transactions and value ranges, as one row."""
    missing = [F.count_if(F.col(c).isNull()).alias(f"missing_{c}") for c in trades.columns]
    return trades.agg(
        F.count("*").alias("rows"),
        *missing,
        (F.count("transaction_id") - F.countDistinct("transaction_id")).alias("duplicate_transactions"),
        F.min("amount").alias("min_amount"),
        F.max("amount").alias("max_amount"),
        F.min("price").alias("min_price"),
        F.max("price").alias("max_price"),
        F.min("timestamp").alias("first_time"),
        F.max("timestamp").alias("last_time"),
    )


def side_counts(trades: DataFrame) -> DataFrame:
    return trades.groupBy("side").agg(F.count("*").alias("trades"))


def describe(df: DataFrame, cols: list[str], approx: bool = False) -> DataFrame:
    """Count, mean, standard deviation, minimum, quartiles and maximum per column; quartiles are exact unless ``approx``."""
    stats = df.agg(
        *[
            F.struct(
                F.count(c).alias("count"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"),
                F.min(c).cast("double").alias("min"), F.max(c).cast("double").alias("max"),
            ).alias(c)
            for c in cols
        ]
    )
    quartiles = percentiles(df, cols, [0.25, 0.5, 0.75], approx=approx).select(*[F.col(c).alias(f"q_{c}") for c in cols])
    row = lambda c: F.struct(F.lit(c).alias("feature"), F.col(c).alias("s"), F.col(f"q_{c}").alias("q"))
    both = stats.crossJoin(quartiles).select(F.inline(F.array(*[row(c) for c in cols])))
    return both.select(
        "feature", "s.count", "s.mean", "s.std", "s.min",
        F.col("q")[0].alias("p25"), F.col("q")[1].alias("p50"), F.col("q")[2].alias("p75"), "s.max",
    )
