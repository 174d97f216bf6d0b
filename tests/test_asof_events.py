from __future__ import annotations

import os
import random

import pytest
from pyspark.sql import functions as F

from augury import session
from augury.operators import clean, equity, events
from augury.operators.asof import asof_join
from augury.sources import sample_tables as D

from conftest import rows_of, same_rows


@pytest.mark.parametrize("limit", [30, None])
def test_asof_matches_brute_force(spark, limit):
    rng = random.Random(3)
    ticks = [("big" if i % 3 else f"m{i % 7}", rng.randrange(100), f"t{i:04d}", rng.random()) for i in range(400)]
    probes = [("big" if i % 2 else f"m{i % 9}", rng.randrange(-5, 110), f"p{i:04d}", -1.0) for i in range(200)]
    t = spark.createDataFrame(ticks, "market_id string, timestamp int, transaction_id string, price double")
    p = spark.createDataFrame(probes, "market_id string, at int, transaction_id string, entry double")
    got = {r["transaction_id"]: r["asof_price"] for r in asof_join(p, t, default="entry", limit=limit).collect()}
    assert len(got) == len(probes)
    for market, at, key, entry in probes:
        past = [x for x in ticks if x[0] == market and x[1] <= at]
        assert got[key] == (max(past, key=lambda x: (x[1], x[2]))[3] if past else entry)


@pytest.fixture
def two_markets(make_trades):
    return make_trades(
        [
            ("t1", "a", "m1", "BUY", 100.0, 0.6, "2024-01-01 00:00:00"),
            ("t2", "b", "m1", "SELL", 5.0, 0.7, "2024-01-01 00:05:00"),
            ("t3", "b", "m1", "BUY", 5.0, 0.5, "2024-01-01 00:05:00"),
            ("t4", "a", "m1", "sell", 9.0, 0.8, "2024-01-01 01:00:00"),
            ("t5", "b", "m2", "BUY", 1.0, 0.2, "2024-01-01 00:00:00"),
        ]
    ).withColumn("volume", F.col("amount") * F.col("price"))


def test_event_study(spark, two_markets):
    informed = spark.createDataFrame([("a", 1), ("b", 0)], "address string, predicted_label int")
    study = events.event_study(two_markets, events.informed_set(informed), [5, 60])
    got = {r["transaction_id"]: r for r in study.collect()}
    assert set(got) == {"t1", "t4"}
    # Two trades at one time: the last by id counts.
    assert got["t1"]["price_5m"] == 0.5 and got["t1"]["delta_5m"] == pytest.approx(-0.1)
    assert got["t1"]["price_60m"] == 0.8
    # Past the last trade the last price stays; a sale turns the sign.
    assert got["t4"]["price_60m"] == 0.8 and got["t4"]["delta_60m"] == 0.0 and got["t4"]["side"] == "SELL"
    summary = {r["horizon"]: r for r in events.event_study_summary(study).collect()}
    assert summary[5]["events"] == 2 and summary[5]["mean_delta"] == pytest.approx(-0.05)
    assert events.whale_impact(study, 50.0).where("horizon = 60").first()["mean_delta"] == pytest.approx(0.2)


def test_all_addresses_without_a_prediction_column(spark):
    assert rows_of(events.informed_set(spark.createDataFrame([("x",), ("x",)], "address string"))) == [("x",)]


def test_copy_trades(spark, two_markets, make_resolutions):
    informed = spark.createDataFrame([("a",), ("b",)], "address string")
    copies = events.copy_trades(two_markets, informed, make_resolutions({"m1": "Yes", "m2": "Yes"}))
    got = {r["transaction_id"]: r for r in copies.collect()}
    assert set(got) == {"t1", "t3", "t5"}
    assert got["t1"]["exec_price"] == 0.5 and got["t1"]["net_profit"] == pytest.approx(0.5 * 100 / 0.5 - 0.1)
    assert got["t1"]["slippage"] == pytest.approx(-0.1)
    assert got["t5"]["net_profit"] == pytest.approx(-100.1)  # bets NO in a market resolved YES
    curve = equity.equity_curve(copies)
    last = curve.orderBy(F.desc("timestamp"), F.desc("transaction_id")).first()
    assert last["balance"] == pytest.approx(10_000 + sum(r["net_profit"] for r in got.values()))
    # All copies fall on one date.
    assert events.daily_sharpe(copies).first()["sharpe_ratio"] == 0.0


def test_win_at_price_zero_is_flagged(make_trades, make_resolutions, spark):
    trades = make_trades(
        [
            ("t1", "a", "m", "BUY", 1.0, 0.6, "2024-01-01 00:00:00"),
            ("t2", "b", "m", "BUY", 1.0, 0.0, "2024-01-01 00:01:00"),
        ]
    )
    informed = spark.createDataFrame([("a",)], "address string")
    row = events.copy_trades(trades, informed, make_resolutions({"m": "Yes"})).first()
    assert row["undefined_profit"] and row["net_profit"] is None


def test_equity_curve_in_runs(spark):
    rng = random.Random(1)
    rows = [(f"x{i:03d}", f"m{i % 4}", i // 3, float(rng.randrange(-900, 900))) for i in range(200)]
    copies = spark.createDataFrame(rows, "transaction_id string, market_id string, s long, net_profit double")
    copies = copies.withColumn("timestamp", F.timestamp_seconds("s"))
    for order in ("time", "market"):
        same_rows(equity.equity_curve(copies, order=order, limit=17), equity.equity_curve(copies, order=order), 6)
    curve = equity.equity_curve(copies).orderBy("timestamp", "transaction_id").toPandas()
    balance = 10_000 + curve["net_profit"].cumsum()
    peak = balance.cummax().clip(lower=10_000)
    assert curve["drawdown"].tolist() == pytest.approx(((peak - balance) / peak).tolist())


def test_equity_metrics(spark):
    rows = [(1, 10_000.0), (2, 12_000.0), (3, 9_000.0), (4, 11_000.0)]
    table = spark.createDataFrame(rows, "s long, total_equity double").withColumn("timestamp", F.timestamp_seconds("s"))
    got = equity.equity_metrics(table).first()
    assert got["final_equity"] == 11_000 and got["total_return_pct"] == pytest.approx(10)
    assert got["max_drawdown_pct"] == pytest.approx(-25)
    flat = table.withColumn("total_equity", F.lit(1.0))
    assert equity.equity_metrics(flat).first()["sharpe_ratio"] == 0.0
    base = equity.equity_metrics(table.withColumn("total_equity", F.lit(10_500.0)))
    assert equity.alpha(equity.equity_metrics(table), base).first()[0] == pytest.approx(5)


def test_orders(spark, make_trades):
    trades = make_trades(
        [
            ("t1", "a", "m", "buy", 100.0, 0.5, "2024-01-01"),
            ("t2", "a", "m", "BUY", 10.0, 0.5, "2024-01-01"),
            ("t3", "a", "m", "BUY", 99_999.0, 0.5, "2024-01-01"),
            ("t4", "a", "m", "BUY", 100.0, 1.0, "2024-01-01"),
            ("t5", "b", "m", "BUY", 100.0, 0.5, "2024-01-01"),
            ("t6", "a", "m", "SELL", 100.0, 0.5, "2024-01-01"),
        ],
        {"t3": "No"},
    )
    orders = events.copy_orders(trades, spark.createDataFrame([("a",)], "address string"))
    assert rows_of(orders.select("transaction_id", "outcome", "amount"), "transaction_id") == [
        ("t1", "Yes", 5.0), ("t3", "No", 500.0),
    ]
    everything = events.random_orders(trades, probability=1.0)
    assert {r["transaction_id"] for r in everything.collect()} == {"t1", "t2", "t3", "t5"}
    assert events.random_orders(trades, probability=0.0).count() == 0
    own = events.signal_orders(trades, lambda t: (F.col("price") == 1.0, F.lit(7.0)))
    assert rows_of(own.select("transaction_id", "amount")) == [("t4", 7.0)]


def test_random_draws_are_uniform_and_repeatable(spark):
    ids = spark.range(20_000).select(F.concat(F.lit("t"), "id").alias("transaction_id"))
    flips = events.coin_flips(ids.withColumn("timestamp", F.current_timestamp()))
    share = flips.agg(F.avg((F.col("net_profit") > 0).cast("int"))).first()[0]
    assert abs(share - 0.5) < 0.02
    same_rows(flips.select("transaction_id", "net_profit"), flips.repartition(5).select("transaction_id", "net_profit"))


def test_positions_and_histogram(make_trades, spark):
    trades = make_trades(
        [
            ("t1", "a", "m", "BUY", 10.0, 0.4, "2024-01-01"),
            ("t2", "a", "m", "BUY", 30.0, 0.8, "2024-01-02"),
            ("t3", "a", "m", "SELL", 5.0, 0.9, "2024-01-03"),
            ("t4", "b", "m", "SELL", 5.0, 0.9, "2024-01-03"),
        ]
    )
    got = {r["address"]: r for r in events.positions(trades).collect()}
    assert got["a"]["token_balance"] == 35 and got["a"]["avg_price"] == pytest.approx(0.7)
    assert got["b"]["token_balance"] == -5 and got["b"]["avg_price"] is None
    values = spark.createDataFrame([(float(v),) for v in (0, 1, 2, 10)], "x double")
    bins = rows_of(events.histogram(values, "x", 5).select("bin", "n"), "bin")
    assert bins == [(0, 2), (1, 1), (2, 0), (3, 0), (4, 1)]
    flat = spark.createDataFrame([(3.0,), (3.0,)], "x double")
    assert rows_of(events.histogram(flat, "x", 2).select("bin", "n"), "bin") == [(0, 2), (1, 0)]


def test_events_of_large_markets(spark, small):
    """One market holds most rows and is scanned in runs; prices and profits stay the same."""
    trades = clean.clean(D.trades(spark, small), 1, 0.0)
    hot = trades.withColumn("market_id", F.when(F.crc32("transaction_id") % 3 > 0, "m0").otherwise(F.col("market_id")))
    informed = hot.select("address").distinct()
    same_rows(events.event_study(hot, informed, [5, 60], limit=400), events.event_study(hot, informed, [5, 60]))
    res = D.resolutions(spark, small)
    same_rows(events.copy_trades(hot, informed, res, limit=400), events.copy_trades(hot, informed, res), 6)


def test_release_deletes_intermediate_tables(spark):
    table = session.materialise(spark.range(3), "gone")
    folder = table.inputFiles()[0].removeprefix("file:").rsplit("/", 1)[0]
    assert table.count() == 3 and os.path.isdir(folder)
    kept = session._paths.pop(spark.sparkContext.applicationId)
    session._paths[spark.sparkContext.applicationId] = kept[-1:]  # other tests still read theirs
    assert session.release(spark) == 1 and not os.path.exists(folder)
    session._paths[spark.sparkContext.applicationId] = kept[:-1]
