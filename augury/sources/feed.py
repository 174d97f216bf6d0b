"""Landed feed objects (trades, markets, fills) to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from augury import schemas
from augury.functions.outcomes import OPEN_MARK


def read_feed_pages(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Raw trade objects from JSON files: one array per file, or one object per line (which Spark can split)."""
    return spark.read.schema(schemas.FEED_TRADE).option("multiLine", not lines).json(path)


def parse_feed_text(df: DataFrame, text: str) -> DataFrame:
    """Raw trade objects from a column of JSON text; other columns stay."""
    parsed = df.withColumn("_o", F.from_json(F.col(text), schemas.FEED_TRADE)).drop(text)
    return parsed.select(*[c for c in parsed.columns if c != "_o"], "_o.*")


def normalize_feed(raw: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Feed objects to trade rows. Missing numbers count as 0, a bad time becomes NULL, objects without a hash go. The
    outcome may be in ``_outcome`` instead.

    ``keep`` names further columns of ``raw`` to carry along, such as an arrival number.
    """
    number = lambda name: F.coalesce(F.col(name).try_cast("double"), F.lit(0.0))
    text = lambda name: F.coalesce(F.col(name), F.lit(""))
    return raw.where(F.coalesce(F.col("transactionHash"), F.lit("")) != "").select(
        F.col("transactionHash").alias("transaction_id"),
        text("proxyWallet").alias("address"),
        text("conditionId").alias("market_id"),
        text("side").alias("side"),
        coalesce_outcome(F.col("outcome"), F.col("_outcome")).alias("outcome"),
        number("size").alias("amount"),
        number("price").alias("price"),
        F.timestamp_seconds(F.col("timestamp").try_cast("bigint")).alias("timestamp"),
        F.col("title"),
        F.col("slug"),
        F.col("eventSlug").alias("event_slug"),
        *keep,
    )


def coalesce_outcome(outcome: Column, fallback: Column) -> Column:
    """The outcome, or else the fallback; an empty text counts as missing."""
    return F.coalesce(F.nullif(outcome, F.lit("")), F.nullif(fallback, F.lit("")))


def parse_resolution(markets: DataFrame) -> DataFrame:
    """The winning outcome per market object: the first one with the highest price, or the open mark.

    Markets without arrays, with a price that is no number, or whose winner lies beyond the outcomes give no row.
    """
    names = F.from_json("outcomes", "array<string>")
    prices = F.transform(F.from_json("outcomePrices", "array<string>"), lambda p: p.try_cast("double"))
    parsed = markets.select("conditionId", "question", "slug", "closed", names.alias("n"), prices.alias("p"))
    usable = parsed.where((F.size("n") > 0) & (F.size("p") > 0) & F.forall("p", lambda p: p.isNotNull()))
    winner = F.try_element_at("n", F.array_position("p", F.array_max("p")).cast("int"))
    return (
        usable.withColumn("winner", winner)
        .where(F.coalesce(F.col("winner"), F.lit("")) != "")
        .select(
            F.col("conditionId").alias("market_id"),
            "question",
            F.when(F.coalesce("closed", F.lit(False)), F.col("winner")).otherwise(OPEN_MARK).alias("resolution"),
            "slug",
        )
    )


def parse_token_ids(markets: DataFrame) -> DataFrame:
    """One row per token of each market's JSON list; lists that do not parse are left out."""
    return markets.select(
        F.col("conditionId").alias("market_id"),
        F.explode(F.from_json("clobTokenIds", "array<string>")).alias("token_id"),
    )


def top_markets_by_volume(markets: DataFrame, limit: int = 50, closed: bool = True) -> DataFrame:
    """The markets with the most volume among the closed (or the open) ones. Take their tokens with
    :func:`parse_token_ids`."""
    wanted = F.coalesce("closed", F.lit(False)) == F.lit(closed)
    return markets.where(wanted).orderBy(F.desc("volume"), "conditionId").limit(limit)


def market_resolution_view(markets: DataFrame) -> DataFrame:
    return markets.select("market_id", "resolved", F.col("resolution_outcome").alias("resolution"))


def market_snapshot(markets: DataFrame, market_id: str) -> DataFrame:
    return markets.where(F.col("market_id") == market_id)


def active_wallets(fills: DataFrame, target: int | None = None) -> DataFrame:
    """Every wallet seen as maker or taker; ``target`` keeps the first so many in address order."""
    sides = F.explode(F.array("maker_address", "taker_address"))
    wallets = fills.select(sides.alias("address")).where(F.coalesce("address", F.lit("")) != "").distinct()
    return wallets if target is None else wallets.orderBy("address").limit(target)


def top_market_wallets(markets: DataFrame, fills: DataFrame, n_markets: int = 50, target: int | None = None) -> DataFrame:
    """Wallets seen in the fills of the open markets with the most volume."""
    top = top_markets_by_volume(markets, n_markets, closed=False).select(F.col("conditionId").alias("market"))
    return active_wallets(fills.join(top, "market", "left_semi"), target)
