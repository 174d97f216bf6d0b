"""Sketches of loads, approximate quantiles, functions over a trader's rows, and variances of nearly equal steps."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from augury.operators import clean, features, quantiles, sketches

TRADE = "transaction_id string, address string, market_id string, side string, amount double, price double, timestamp timestamp"


def trades(spark, n=3000):
    return spark.range(n).select(
        F.concat(F.lit("t"), F.col("id")).alias("transaction_id"), F.concat(F.lit("w"), F.col("id") % 700).alias("address"),
        F.concat(F.lit("m"), F.col("id") % 11).alias("market_id"), F.lit("BUY").alias("side"),
        (F.col("id") % 97).cast("double").alias("amount"), F.lit(0.5).alias("price"), F.timestamp_seconds(F.col("id") + 10**9).alias("timestamp"),
    )


def test_loads_merge_to_the_whole(spark):
    rows = trades(spark)
    parts = [sketches.load_sketch(rows.where(F.col("amount") % 3 == k)) for k in range(3)]
    got = sketches.sketched_stats(parts[0].union(parts[1]).union(parts[2])).first()
    assert tuple(got)[:3] == (3000, 11, 700)  # below the entries of a sketch counts are exact
    first, later = rows.where("transaction_id < 't2'"), rows.where("transaction_id >= 't2'")
    extra = later.withColumn("address", F.when(F.col("amount") < 5, F.concat(F.lit("new"), F.col("amount"))).otherwise(F.col("address")))
    known = {r[0] for r in first.select("address").distinct().collect()}
    expected = len({r[0] for r in extra.select("address").distinct().collect()} - known)
    assert sketches.new_in_load(sketches.load_sketch(first), sketches.load_sketch(extra)).first()["new_wallets"] == expected


def test_sketches_of_nothing_and_nulls(spark):
    none = spark.createDataFrame([], TRADE)
    assert tuple(sketches.sketched_stats(sketches.load_sketch(none)).first()) == (0, 0, 0, None)
    odd = spark.createDataFrame([("t", None, "", None, None, None, None)], TRADE)
    assert tuple(sketches.sketched_stats(sketches.load_sketch(odd)).first())[:3] == (1, 0, 0)
    assert sketches.new_in_load(sketches.load_sketch(none), sketches.load_sketch(trades(spark, 20))).first()["new_wallets"] == 20


def test_large_distinct_counts_within_the_error(spark):
    ids = spark.range(200_000).select(F.col("id").cast("string").alias("address"), F.lit("m").alias("market_id"), F.lit(None).cast("timestamp").alias("timestamp"))
    loads = sketches.load_sketch(ids.where("address < '5'")).union(sketches.load_sketch(ids))
    found = sketches.sketched_stats(loads).first()["unique_wallets"]
    assert abs(found - 200_000) <= sketches.count_error() * 200_000


def test_approximate_quantiles(spark):
    draw = np.random.default_rng(3)
    values = draw.exponential(size=20_000)
    df = spark.createDataFrame([(int(i % 2), float(v)) for i, v in enumerate(values)] + [(0, None), (2, None)], "g int, x double")
    probs = [0.0, 0.01, 0.5, 0.99, 1.0]
    got = {r["g"]: r["x"] for r in quantiles.percentiles(df, ["x"], probs, ["g"], approx=True).collect()}
    for g in (0, 1):
        own = np.sort(values[g::2])
        for p, v in zip(probs, got[g]):
            assert abs(np.searchsorted(own, v, side="right") / len(own) - p) <= sketches.RANK_ERROR + 1e-3
    assert got[2] is None
    top = clean.active_traders(clean.with_volume(trades(spark)), 1, 0.0, 0.1, approx=True).count()
    assert 40 <= top <= 100


@pytest.mark.parametrize("size", [10_000, 3])
def test_function_over_a_traders_rows(spark, size):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)  # 3: a trader's rows come in many batches
    try:
        rows = trades(spark, 60).withColumn("address", F.concat(F.lit("w"), F.col("amount") % 4)).withColumn("batches", F.lit("clash"))
        rows = rows.union(rows.limit(1).withColumn("address", F.lit(None).cast("string")))
        matrix = rows.where("address is not null").groupBy("address").agg(F.count("*").alias("n"))

        def falls(batches) -> dict:
            amounts = [a for b in batches for a in b.column("amount").to_pylist()]
            return {"falls": sum(b < a for a, b in zip(amounts, amounts[1:])), "last": amounts[-1]}

        got = features.with_trader_function(matrix, rows, ["amount"], "falls int, last double", falls, ["amount", "transaction_id"]).collect()
        assert sorted((r["address"], r["n"], r["falls"], r["last"]) for r in got) == [(f"w{k}.0", 15, 0, 56.0 + k) for k in range(4)]
        early = features.with_trader_function(matrix, rows, ["amount"], "first double", lambda batches: {"first": next(batches).column("amount")[0].as_py()})
        assert {r["address"]: r["first"] for r in early.collect()} == {f"w{k}.0": float(k) for k in range(4)}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_nearly_equal_steps_keep_their_digits(spark):
    """Steps of about 1e-9 around a large step mean: sums of squares minus the squared mean would leave nothing."""
    draw = np.random.default_rng(8)
    prices, p = [], 1e-30
    for k in range(60):
        prices.append(p)
        p *= 2.0 + 1e-9 * draw.standard_normal()
    data = [(f"t{k:02d}", "a", f"m{k % 4}", "BUY", 1.0, q, k) for k, q in enumerate(prices)]
    df = spark.createDataFrame(data, "transaction_id string, address string, market_id string, side string, amount double, price double, s int")
    df = df.withColumn("timestamp", F.timestamp_seconds(F.col("s") + 10**9)).withColumn("volume", F.col("amount") * F.col("price"))
    steps = np.array(prices[1:]) / np.array(prices[:-1]) - 1
    got = features.behaviour_features(features.pair_table(df)).first()["information_ratio"]
    assert abs(got / (steps.mean() / steps.std(ddof=1)) - 1) < 1e-5
