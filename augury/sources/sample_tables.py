"""Trade-shaped views of the generated sample tables (events, orders, lineitem, documents, labels)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from augury.session import configure


# The columns read from each sample table.
SCHEMAS = {
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_returnflag string",
    "part": "p_partkey bigint, p_name string, p_retailprice double",
    "documents": "doc_id bigint, n_chars bigint",
    "labels": "doc_id bigint, quality int, toxic int",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A sample table with a fixed schema, so that opening it runs no job."""
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def trades(spark: SparkSession, sf_dir: str, with_outcome: bool = False) -> DataFrame:
    """Trades from ``events``: users are traders, ``props.k`` is the market."""
    configure(spark)
    outcome = F.lit(None).cast("string")
    if with_outcome:
        outcome = F.when(F.col("event_id") % 3 == 0, "Yes").when(F.col("event_id") % 3 == 1, "No")
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("t"), F.col("event_id")).alias("transaction_id"),
        F.concat(F.lit("w"), F.col("user_id")).alias("address"),
        F.concat(F.lit("m"), F.get_json_object("props", "$.k")).alias("market_id"),
        F.when(F.col("event_type").isin("purchase", "signup", "click"), "BUY").otherwise("SELL").alias("side"),
        outcome.alias("outcome"),
        F.col("value").alias("amount"),
        ((F.rint(F.col("value") * 100).cast("bigint") % 100) / F.lit(100.0)).cast("double").alias("price"),
        F.col("ts").cast("timestamp").alias("timestamp"),
    )


def resolutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per market of ``events``; six kinds of resolution text by the market's number."""
    configure(spark)
    # Few different texts: they are merged before any is parsed.
    k = F.get_json_object("props", "$.k")
    texts = table(spark, sf_dir, "events").select("props").distinct()
    markets = texts.select(k.alias("k")).where("k is not null").distinct()
    kind = F.col("k").cast("int") % 6
    text = F.when(kind == 0, "Yes").when(kind == 1, "No").when(kind == 2, " UP ").when(kind == 3, "0.7")
    return markets.select(
        F.concat(F.lit("m"), "k").alias("market_id"),
        F.concat(F.lit("Market "), "k").alias("question"),
        text.when(kind == 4, "__OPEN__").alias("resolution"),
        F.concat(F.lit("market-"), "k").alias("slug"),
    )


def sparse_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades from ``orders``: many traders whose first trades spread over years."""
    configure(spark)
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("o"), F.col("o_orderkey")).alias("transaction_id"),
        F.concat_ws("-", F.col("o_custkey"), F.col("o_orderpriority")).alias("address"),
        F.concat(F.lit("m"), F.col("o_orderkey") % 100).alias("market_id"),
        F.when(F.col("o_orderstatus") == "F", "BUY").otherwise("SELL").alias("side"),
        F.lit(None).cast("string").alias("outcome"),
        F.col("o_totalprice").alias("amount"),
        ((F.col("o_orderkey") % 100) / F.lit(100.0)).cast("double").alias("price"),
        F.col("o_orderdate").cast("timestamp").alias("timestamp"),
    )


def feed_text(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """Feed objects as JSON text, one per event, with an arrival number; every seventh repeats a hash with another
    size, every eleventh has none. ``events``: the rows to use instead of the whole table."""
    configure(spark)
    rows = (table(spark, sf_dir, "events") if events is None else events).select(
        "event_id", "user_id", "event_type", "value", F.unix_seconds(F.col("ts").cast("timestamp")).alias("sec"),
        F.get_json_object("props", "$.k").alias("k"),
    )
    e = F.col("event_id")
    hash_of = F.when(e % 11 == 0, "").otherwise(F.concat(F.lit("t"), F.when(e % 7 == 0, e + 1).otherwise(e)))
    return rows.select(
        F.col("event_id").alias("arrival"),
        F.to_json(
            F.struct(
                hash_of.alias("transactionHash"),
                F.concat(F.lit("w"), "user_id").alias("proxyWallet"),
                F.concat(F.lit("m"), "k").alias("conditionId"),
                F.when(F.col("event_type") == "purchase", "BUY").otherwise("SELL").alias("side"),
                F.col("value").alias("size"),
                ((F.rint(F.col("value") * 100).cast("bigint") % 100) / F.lit(100.0)).alias("price"),
                F.when(e % 13 == 0, "soon").otherwise(F.col("sec").cast("string")).alias("timestamp"),
                F.when(e % 2 == 0, "Yes").otherwise("").alias("outcome"),
                F.concat(F.lit("Market "), "k").alias("title"),
                F.concat(F.lit("market-"), "k").alias("slug"),
                F.concat(F.lit("event-"), "k").alias("eventSlug"),
            )
        ).alias("body"),
    )


def market_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Market objects from ``part``: prices tie, are short, or are no numbers in some of them."""
    configure(spark)
    p = F.col("p_partkey")
    first = F.round((p % 5) / F.lit(4.0), 2)
    prices = (
        F.when(p % 17 == 0, '["0.5", "oops"]')
        .when(p % 19 == 0, '["0.1", "0.2", "0.7"]')
        .otherwise(F.concat(F.lit('["'), first.cast("string"), F.lit('", "'), (1.0 - first).cast("string"), F.lit('"]')))
    )
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("p"), p).alias("conditionId"),
        F.col("p_name").alias("question"),
        F.concat(F.lit("part-"), p).alias("slug"),
        F.when(p % 23 == 0, "broken").otherwise('["Yes", "No"]').alias("outcomes"),
        prices.alias("outcomePrices"),
        (p % 3 != 0).alias("closed"),
        (p % 3 == 0).alias("active"),
        F.when(p % 29 != 0, F.concat(F.lit('["'), p, F.lit('a", "'), p, F.lit('b"]'))).alias("clobTokenIds"),
        F.col("p_retailprice").alias("volume"),
    )


def fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order fills from ``lineitem``: suppliers make, orders take; the maker is missing in some rows."""
    configure(spark)
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("p"), F.col("l_partkey")).alias("market"),
        F.when(F.col("l_returnflag") != "R", F.concat(F.lit("s"), F.col("l_suppkey"))).alias("maker_address"),
        F.concat(F.lit("c"), F.col("l_orderkey")).alias("taker_address"),
    )


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of scored items from ``labels`` and ``documents``, in the shape of model predictions."""
    configure(spark)
    probability = ((F.col("n_chars") % 101) / F.lit(100.0)).cast("double")
    joined = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    return joined.select(
        F.concat(F.lit("d"), "doc_id").alias("address"),
        F.col("quality").cast("int").alias("actual_label"),
        probability.alias("predicted_probability"),
        (probability >= 0.5).cast("int").alias("predicted_label"),
        F.col("toxic").cast("int").alias("other_label"),
    )
