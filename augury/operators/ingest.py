"""Dedup, append, upsert and the counts that describe a load."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from augury.functions.numbers import volume_tier
from augury.functions.outcomes import OPEN_MARK


def _pick(df: DataFrame, key: str, position: Column, pick) -> DataFrame:
    """One row per key by the smallest or largest position. An aggregate merges copies before the shuffle, so a
    key that makes up much of the input costs no more than any other."""
    row = F.struct(*df.columns)
    return df.groupBy(F.col(key).alias("_key")).agg(pick(row, position).alias("_row")).select("_row.*")


def dedup_first(df: DataFrame, key: str = "transaction_id", arrival: str = "arrival") -> DataFrame:
    """The first arrival per key; rows without an arrival come after those with one."""
    return _pick(df, key, F.struct(F.col(arrival).isNull(), F.col(arrival)), F.min_by)


def merge_keep_last(old: DataFrame, new: DataFrame, key: str = "transaction_id", arrival: str = "arrival") -> DataFrame:
    """Both tables together, the last arrival per key; rows of ``new`` come after all of ``old``."""
    both = old.withColumn("_batch", F.lit(0)).unionByName(new.withColumn("_batch", F.lit(1)), allowMissingColumns=True)
    return _pick(both, key, F.struct("_batch", arrival), F.max_by).drop("_batch")


def append_new(batch: DataFrame, existing: DataFrame, key: str = "transaction_id") -> DataFrame:
    """The rows of the batch whose key is not stored yet.

    The store is first cut to the keys of the batch. With a batch small enough to broadcast, the store is only
    scanned, never shuffled.
    """
    stored = existing.select(key).join(batch.select(key).distinct(), key, "left_semi")
    return batch.join(stored, key, "left_anti")


def append_counts(batch: DataFrame, existing: DataFrame, key: str = "transaction_id") -> DataFrame:
    """How many records of the batch are inserted and how many are skipped as stored or repeated."""
    fresh = append_new(batch, existing, key)
    inserted = fresh.agg(F.countDistinct(key).alias("inserted"))
    return batch.agg(F.count("*").alias("records")).crossJoin(inserted).select(
        "inserted", (F.col("records") - F.col("inserted")).alias("skipped")
    )


def upsert_resolutions(old: DataFrame, new: DataFrame, order: str | None = None) -> DataFrame:
    """New resolutions replace old ones per market; question and slug stay where the new row has none.

    Of several new rows for one market the last by ``order`` counts, or without it the largest by resolution text.
    """
    columns = ["market_id", "question", "resolution", "slug"]
    place = F.struct(F.lit(1), F.col(order).cast("string") if order else F.lit(None).cast("string"), F.col("resolution"))
    first = F.struct(F.lit(0), F.lit(None).cast("string"), F.col("resolution"))
    both = old.select(*columns, first.alias("_batch")).union(new.select(*columns, place.alias("_batch")))
    text = lambda name: F.nullif(F.col(name), F.lit(""))
    latest = lambda name, c: F.max_by(c, F.when(c.isNotNull(), F.col("_batch"))).alias(name)
    return both.groupBy("market_id").agg(
        latest("question", text("question")),
        F.max_by("resolution", "_batch").alias("resolution"),
        latest("slug", text("slug")),
    )


def describe_markets(resolved: DataFrame, trades: DataFrame, arrival: str = "arrival") -> DataFrame:
    """Question and slug per resolved market from the first trade of the batch in that market."""
    firsts = trades.groupBy("market_id").agg(
        F.min_by("title", arrival).alias("question"), F.min_by("slug", arrival).alias("slug")
    )
    return resolved.select("market_id", "resolution").join(firsts, "market_id", "left").select(
        "market_id", "question", "resolution", "slug"
    )


def enrich_with_resolution(trades: DataFrame, resolutions: DataFrame) -> DataFrame:
    table = resolutions.select("market_id", F.col("resolution").alias("market_resolution"))
    return trades.join(table, "market_id", "left")


def ingest_summary(trades: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Trades, wallets, markets, resolved markets and the size class, as one row."""
    resolved = resolutions.agg(
        F.count_if(F.col("resolution").isNotNull() & (F.col("resolution") != OPEN_MARK)).alias("resolved_markets")
    )
    totals = trades.agg(
        F.count("*").alias("trades"),
        F.countDistinct("address").alias("unique_wallets"),
        F.countDistinct("market_id").alias("unique_markets"),
    )
    return totals.crossJoin(resolved).withColumn("tier", volume_tier(F.col("trades")))


def load_counts(before: DataFrame, inserted: DataFrame) -> DataFrame:
    """Rows before and after a load, and the wallets and markets among the inserted rows."""
    old = before.agg(F.count("*").alias("total_before"))
    new = inserted.agg(
        F.count("*").alias("new_trades"),
        F.countDistinct("address").alias("new_wallets"),
        F.countDistinct(F.nullif("market_id", F.lit(""))).alias("new_markets"),
    )
    return old.crossJoin(new).withColumn("total_after", F.col("total_before") + F.col("new_trades"))
