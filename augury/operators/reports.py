"""Volume reports by wallet, market and period."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from augury.functions.numbers import round_money
from augury.functions.trades import period_label, truncate_period


def _ranked(trades: DataFrame, key: str, other: str, distinct_name: str, limit: int | None) -> DataFrame:
    totals = trades.groupBy(key).agg(
        F.count("*").alias("trade_count"),
        round_money(F.sum(F.col("amount") * F.col("price"))).alias("total_volume"),
        F.countDistinct(other).alias(distinct_name),
        F.min("timestamp").alias("first_trade"),
        F.max("timestamp").alias("last_trade"),
    )
    return totals if limit is None else totals.orderBy(F.desc("total_volume"), key).limit(limit)


def wallet_stats(trades: DataFrame, limit: int | None = 20) -> DataFrame:
    """The wallets with the most volume; ``limit=None`` gives all."""
    return _ranked(trades, "address", "market_id", "markets_traded", limit)


def market_overview(trades: DataFrame, limit: int | None = 20) -> DataFrame:
    return _ranked(trades, "market_id", "address", "unique_traders", limit)


def trade_timeline(trades: DataFrame, interval: str = "day") -> DataFrame:
    """Trades, volume and wallets per hour, day or month."""
    bucket = truncate_period(F.col("timestamp"), interval)
    totals = trades.where(F.col("timestamp").isNotNull()).groupBy(bucket.alias("bucket")).agg(
        F.count("*").alias("trade_count"),
        round_money(F.sum(F.col("amount") * F.col("price"))).alias("volume"),
        F.countDistinct("address").alias("unique_wallets"),
    )
    label = period_label(F.col("bucket"), interval).alias("period")
    return totals.orderBy("bucket").select(label, "trade_count", "volume", "unique_wallets")


def dataset_stats(trades: DataFrame, approximate: bool = False) -> DataFrame:
    """Totals of the whole table; ``approximate`` trades exact distinct counts for sketches."""
    distinct = F.approx_count_distinct if approximate else F.countDistinct
    return trades.agg(
        F.count("*").alias("total_trades"),
        distinct("market_id").alias("unique_markets"),
        distinct("address").alias("unique_wallets"),
        F.max("timestamp").alias("latest_timestamp"),
    )


def trader_concentration(trades: DataFrame) -> DataFrame:
    """Sum of squared shares of each trader's volume by market."""
    by_market = trades.groupBy("address", "market_id").agg(F.sum(F.col("amount") * F.col("price")).alias("v"))
    return by_market.groupBy("address").agg(
        F.coalesce(F.try_divide(F.sum(F.col("v") * F.col("v")), F.sum("v") * F.sum("v")), F.lit(0.0)).alias(
            "concentration_index"
        )
    )
