"""The join shapes the analyses use. Sides are not forced to broadcast: Spark decides by size."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from augury.functions.outcomes import is_buy


def market_stats(trades: DataFrame) -> DataFrame:
    """First and last trade time, trade count and share of purchases per market."""
    return trades.groupBy("market_id").agg(
        F.min("timestamp").alias("market_start"),
        F.max("timestamp").alias("market_end"),
        F.count("*").alias("market_trades"),
        F.avg(is_buy(F.col("side")).cast("double")).alias("mkt_buy_ratio"),
    )


def with_market_stats(trades: DataFrame) -> DataFrame:
    return trades.join(market_stats(trades), "market_id")


def first_trades(trades: DataFrame) -> DataFrame:
    return trades.groupBy("address").agg(F.min("timestamp").alias("first_trade_date"))


def with_first_trade(df: DataFrame, trades: DataFrame) -> DataFrame:
    return df.join(first_trades(trades), "address", "left")


def outer_blocks(blocks: list[DataFrame], key: str = "address") -> DataFrame:
    """Full outer join of feature blocks on one key."""
    return reduce(lambda a, b: a.join(b, key, "outer"), blocks)


def keep_members(df: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """Rows whose key is in ``members``."""
    return df.join(members.select(key).distinct(), key, "left_semi")


def drop_members(df: DataFrame, members: DataFrame, key: str) -> DataFrame:
    return df.join(members.select(key), key, "left_anti")


def lookup(df: DataFrame, table: DataFrame, key: str, value: str, default: str | None = None) -> DataFrame:
    """Left lookup of one column; keys without an entry get ``default``."""
    joined = df.join(table.select(key, value), key, "left")
    return joined if default is None else joined.withColumn(value, F.coalesce(value, F.lit(default)))


def cross_scalar(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach a table of one row, such as global totals or thresholds."""
    return df.crossJoin(F.broadcast(one_row))
