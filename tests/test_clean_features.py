from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from augury import schemas
from augury.functions import outcomes as O, trades as X
from augury.functions.numbers import clip, round_even, round_money, safe_div, significance_stars, volume_tier
from augury.operators import clean, features, joins, labels, reports
from augury.sources import sample_tables as D

from conftest import rows_of, same_rows


@pytest.mark.parametrize(
    "text, expected",
    [
        (None, "OPEN"), ("", "OPEN"), ("__OPEN__", "OPEN"), ("nan", "OPEN"), (" Yes ", "YES"), ("UP", "YES"),
        ("win", "YES"), ("under", "NO"), ("0", "NO"), ("1", "YES"), ("0.5", "NO"), ("0.51", "YES"), ("1e3", "YES"),
        ("-2", "NO"), ("1.0d", "UNKNOWN"), ("Trump", "UNKNOWN"), ("inf", "YES"), ("-inf", "NO"), (" nan", "NO"), ("1_0", "YES"),
    ],
)
def test_normalise_outcome(spark, text, expected):
    df = spark.createDataFrame([(text,)], "s string")
    assert df.select(O.normalise_outcome(F.col("s"))).first()[0] == expected


def test_strict_reading_and_raw_reading(spark):
    df = spark.createDataFrame([("Yes",), (" yes",), ("0",), ("0.7",), ("__OPEN__",), (None,), ("",)], "s string")
    got = [tuple(r) for r in df.select(O.normalise_resolution_strict(F.col("s")), O.is_resolved_raw(F.col("s"))).collect()]
    assert got == [
        ("YES", True), ("OPEN", True), ("NO", True), ("OPEN", True), ("OPEN", False), ("OPEN", False), ("OPEN", False),
    ]


def test_predicted_outcome(spark):
    rows = [
        ("BUY", None, 0.5), ("BUY", None, 0.49), ("SELL", None, 0.5), (None, None, 0.4),
        ("SELL", "Yes", 0.9), ("BUY", "Trump", 0.9), ("BUY", "", 0.9),
    ]
    df = spark.createDataFrame(rows, "side string, outcome string, price double")
    args = (F.col("side"), F.col("outcome"), F.col("price"))
    assert [r[0] for r in df.select(O.predicted_outcome(*args)).collect()] == [
        "YES", "NO", "NO", "YES", "YES", "UNKNOWN", "OPEN",
    ]
    assert df.select(O.predicted_outcome(*args, side_aware=True)).collect()[4][0] == "NO"


def test_numbers(spark):
    one = spark.range(1)
    value = lambda c: one.select(c).first()[0]
    assert value(round_money(F.lit(0.125))) == 0.13 and value(round_even(F.lit(0.125), 2)) == 0.12
    assert value(safe_div(F.lit(1.0), F.lit(0.0))) == 0.0 and value(safe_div(F.lit(1), F.lit(4))) == 0.25
    assert value(clip(F.lit(None).cast("double"), F.lit(0.0), F.lit(1.0))) is None
    assert value(clip(F.lit(5.0), F.lit(0.0), F.lit(1.0))) == 1.0
    assert [value(significance_stars(F.lit(p))) for p in (0.0001, 0.005, 0.04, 0.05)] == ["***", "**", "*", "ns"]
    assert [value(volume_tier(F.lit(n))) for n in (10_000, 100, 99)] == ["full", "partial", "insufficient"]
    with pytest.raises(ValueError):
        X.truncate_period(F.lit("2024-01-01").cast("timestamp"), "week")


def _raw(spark):
    rows = [
        ("k1", "a", "m", "BUY", None, 1.0, 0.0, "2024-01-01"),
        ("k2", "a", "m", "BUY", None, 1.0, 1.0, "2024-01-01T10:00:00Z"),
        ("k3", "a", "m", "BUY", None, None, 0.5, "2024-01-01"),
        ("k4", "a", "m", "BUY", None, float("nan"), None, "2024-01-01"),
        ("d1", None, "m", "BUY", None, 1.0, 0.5, "2024-01-01"),
        ("d2", "a", None, "BUY", None, 1.0, 0.5, "2024-01-01"),
        ("d3", "a", "m", "BUY", None, 1.0, 0.5, "soon"),
        ("d4", "a", "m", "BUY", None, 1.0, 1.01, "2024-01-01"),
        ("d5", "a", "m", "BUY", None, 1.0, -0.01, "2024-01-01"),
        ("d6", "a", "m", "BUY", None, -1.0, 0.5, "2024-01-01"),
    ]
    return spark.createDataFrame(rows, schemas.TRADES_CSV)


def test_row_rules(spark):
    kept = clean.basic_clean(_raw(spark))
    assert [r["transaction_id"] for r in kept.orderBy("transaction_id").collect()] == ["k1", "k2", "k3", "k4"]
    assert kept.where("transaction_id = 'k4'").first()["amount"] == 0.0
    report = clean.drop_report(_raw(spark)).first().asDict()
    assert report == {
        "rows": 10, "dropped_unparsed_time": 1, "dropped_missing": 2, "dropped_out_of_range": 3, "kept": 4,
    }


def test_active_traders(make_trades):
    rows = [(f"t{i}", "big", "m", "BUY", 100.0, 0.5, "2024-01-01") for i in range(3)]
    rows += [(f"u{i}", "poor", "m", "BUY", 1.0, 0.5, "2024-01-01") for i in range(9)]
    rows += [("v", "rare", "m", "BUY", 9_999.0, 0.5, "2024-01-01")]
    trades = make_trades(rows)
    assert {r["address"] for r in clean.clean(trades, 3, 50.0).collect()} == {"big"}
    everyone = clean.clean(trades, 1, 0.0)
    assert everyone.count() == 13
    top = clean.clean(trades, 1, 0.0, top_percentile=0.5)
    assert {r["address"] for r in top.collect()} == {"big", "rare"}


def _hand(make_trades, extra=()):
    return clean.with_volume(
        make_trades(
            [
                ("t1", "a", "m1", "BUY", 100.0, 0.60, "2024-01-01 00:00:00"),
                ("t2", "a", "m1", "BUY", 50.0, 0.40, "2024-01-01 01:00:00"),
                ("t3", "a", "m1", "SELL", 10.0, 0.70, "2024-01-01 02:00:00"),
                ("t4", "a", "m2", "BUY", 999.0, 0.90, "2024-01-01 03:00:00"),
                *extra,
            ]
        )
    )


def test_hand_worked_features(make_trades, make_resolutions):
    trades, res = _hand(make_trades), make_resolutions({"m1": "Yes", "m2": "__OPEN__"})
    row = features.build_features(trades, res).first()
    assert row["total_roi"] == pytest.approx(27 / 83)
    assert row["win_rate"] == pytest.approx(2 / 3)
    assert row["max_drawdown"] == pytest.approx(-20 / 83)
    assert row["profit_loss_ratio"] == pytest.approx(23.5 / 20.000001)
    assert row["avg_holding_period"] == pytest.approx(1 / 24)
    assert row["trading_frequency"] == pytest.approx(32)
    assert row["cross_market_diversification"] == pytest.approx(0.5)
    assert row["capital_flow_centrality"] == pytest.approx(1)
    assert row["Risk_Adjusted_Return"] == pytest.approx(27 / 20)
    label = labels.resolution_labels(trades, res).first()
    assert (label["n_resolved"], label["n_correct"], label[schemas.LABEL]) == (3, 1, 0)
    assert label["accuracy"] == 0.3333


def test_feature_edges(make_trades, make_resolutions):
    one = lambda *rows: features.raw_features(
        features.pair_table(clean.with_volume(make_trades(list(rows)))), make_resolutions({"m": "Yes"})
    ).first()
    single = one(("t1", "a", "m", "BUY", 10.0, 1.0, "2024-01-01"))
    assert single["win_rate"] == 1.0 and single["profit_loss_ratio"] == 0.0 and single["total_roi"] == 0.0
    assert single["avg_holding_period"] == single["trading_frequency"] == single["information_ratio"] == 0.0
    assert single["early_entry_score"] == 1.0
    no_loss = one(("t1", "a", "m", "BUY", 10.0, 0.6, "2024-01-01"))
    assert no_loss["profit_loss_ratio"] == 10.0 and no_loss["max_drawdown"] == 0.0
    skipped = one(("t1", "a", "m", "BUY", 0.0, 0.6, "2024-01-01"), ("t2", "a", "m", None, 5.0, 0.0, "2024-01-02"))
    assert skipped["total_roi"] == 0.0 and skipped["trading_frequency"] == pytest.approx(2)
    jump = one(("t1", "a", "m", "BUY", 1.0, 0.0, "2024-01-01"), ("t2", "a", "m", "BUY", 1.0, 0.5, "2024-01-02"),
               ("t3", "a", "m", "BUY", 1.0, 0.6, "2024-01-03"), ("t4", "a", "m", "BUY", 1.0, 0.5, "2024-01-04"))
    assert jump["information_ratio"] is None
    level = one(*[(f"t{i}", "a", "m", "BUY", 1.0, 0.5, f"2024-01-0{i}") for i in (1, 2, 3)])
    assert level["information_ratio"] == 0.0


def test_features_of_large_groups(spark, small):
    """With a limit far below the group sizes every trader and pair is scanned in runs; nothing may change."""
    trades = clean.clean(D.trades(spark, small), 1, 0.0)
    # A third of all rows in one trader and one market.
    hot = trades.withColumn("address", F.when(F.crc32("transaction_id") % 3 == 0, "w0").otherwise(F.col("address")))
    hot = hot.withColumn("market_id", F.when(F.col("address") == "w0", "m0").otherwise(F.col("market_id")))
    res = D.resolutions(spark, small)
    same_rows(features.build_features(hot, res, limit=60), features.build_features(hot, res), 8)
    same_rows(features.drawdown_by_time(hot, res, limit=60), features.drawdown_by_time(hot, res), 8)
    same_rows(features.early_entry_pct(hot, limit=60), features.early_entry_pct(hot), 8)


def test_feature_invariants(spark, small):
    rows = features.raw_features(
        features.pair_table(clean.clean(D.trades(spark, small), 1, 0.0)), D.resolutions(spark, small)
    ).toPandas()
    assert rows["capital_flow_centrality"].sum() == pytest.approx(1)
    assert rows["win_rate"].between(0, 1).all() and rows["max_drawdown"].between(-1, 0).all()
    assert (rows["profit_loss_ratio"] <= 10).all()


def test_drawdown_orders_differ(make_trades, make_resolutions):
    extra = [("t0", "a", "m0", "BUY", 100.0, 0.10, "2024-01-05")]
    trades, res = _hand(make_trades, extra), make_resolutions({"m1": "Yes", "m0": "Yes"})
    by_market = features.raw_features(features.pair_table(trades), res).first()["max_drawdown"]
    by_time = features.drawdown_by_time(trades, res).first()["max_drawdown"]
    assert by_market == pytest.approx(-20 / 93) and by_time == pytest.approx(-23 / 93)


def test_as_of_and_blocks(make_trades, make_resolutions):
    trades, res = _hand(make_trades), make_resolutions({"m1": "Yes"})
    early = features.build_features(trades, res, as_of="2024-01-01 00:30:00").first()
    assert early["trading_frequency"] == 0.0
    extra = features.build_features(trades, res, blocks=[lambda t: t.groupBy("address").agg(F.max("price").alias("top"))])
    assert extra.first()["top"] == 0.9


def test_outer_blocks(spark):
    a = spark.createDataFrame([("x", 1)], "address string, p int")
    b = spark.createDataFrame([("y", 2)], "address string, q int")
    assert rows_of(joins.outer_blocks([a, b]), "address") == [("x", 1, None), ("y", None, 2)]


def test_labels_at_the_thresholds(make_trades, make_resolutions):
    rows = [(f"t{i}", "a", "m", "BUY", 1.0, 0.9 if i < 3 else 0.1, "2024-01-01") for i in range(5)]
    rows += [("u1", "b", "m", "BUY", 1.0, 0.9, "2024-01-01"), ("v1", "c", "open", "BUY", 1.0, 0.9, "2024-01-01")]
    trades, res = make_trades(rows, {"u1": "Trump"}), make_resolutions({"m": "Yes", "open": "__OPEN__"})
    got = {r["address"]: (r[schemas.LABEL], r["label_source"]) for r in labels.resolution_labels(trades, res).collect()}
    assert got == {"a": (1, "resolution"), "b": (-1, "resolution_insufficient"), "c": (0, "no_resolved_data")}
    kept = labels.apply_resolution_labels(
        trades.select("address").distinct().unionByName(trades.sparkSession.createDataFrame([("z",)], "address string")),
        labels.resolution_labels(trades, res),
    )
    assert {r["address"] for r in kept.collect()} == {"a", "c", "z"}


def test_first_trade_at_a_cutoff_is_later(make_trades):
    rows = [("t1", "a", "m", "BUY", 1.0, 0.5, "2024-01-01 00:00:00"), ("t2", "b", "m", "BUY", 1.0, 0.5, "2024-01-01 00:07:00"),
            ("t3", "c", "m", "BUY", 1.0, 0.5, "2024-01-01 00:08:30"), ("t4", "d", "m", "BUY", 1.0, 0.5, "2024-01-01 00:10:00")]
    trades = make_trades(rows)
    split = labels.temporal_split(trades.select("address").distinct(), trades)
    assert rows_of(split.select("address", "split"), "address") == [("a", "train"), ("b", "val"), ("c", "test"), ("d", "test")]


def test_label_modes(spark, small):
    trades, res = clean.clean(D.trades(spark, small), 1, 0.0), D.resolutions(spark, small)
    split = labels.temporal_split(features.build_features(trades, res), trades)
    auto = labels.label_traders(split, trades, res)
    assert {r[0] for r in auto.select("label_source").distinct().collect()} <= {"resolution", "no_resolved_data"}
    none = res.withColumn("resolution", F.lit(None).cast("string"))
    fallback = labels.label_traders(split, trades, none)
    assert "composite_score" in fallback.columns
    with pytest.raises(ValueError):
        labels.label_traders(split, trades, res, mode="guess")
    same_rows(labels.composite_labels(split, limit=4), labels.composite_labels(split), 8)


def test_legacy_split_and_rar(spark):
    rows = [(f"a{i}", i < 10, float(i), i) for i in range(14)]
    df = spark.createDataFrame(rows, "address string, is_train boolean, Risk_Adjusted_Return double, s long").withColumn(
        "first_trade_date", F.timestamp_seconds("s")
    )
    for limit in (None, 3):
        got = {r["address"]: r["split"] for r in labels.legacy_split(df, limit=limit).collect()}
        assert [got[f"a{i}"] for i in range(14)] == ["train"] * 8 + ["val"] * 2 + ["test"] * 4
    positive = labels.rar_labels(df).where(F.col(schemas.LABEL) == 1)
    assert {r["address"] for r in positive.collect()} == {f"a{i}" for i in (8, 9, 10, 11, 12, 13)}


def test_reports_on_empty_and_null_times(make_trades):
    trades = make_trades([("t1", "a", "m", "BUY", 1.0, 0.5, None), ("t2", "a", "m", "BUY", 1.0, 0.5, "2024-03-05 07:08:09")])
    assert rows_of(reports.trade_timeline(trades, "month")) == [("2024-03", 1, 0.5, 1)]
    assert rows_of(reports.trade_timeline(trades, "hour"))[0][0] == "2024-03-05 07:00:00"
    empty = trades.where("false")
    assert reports.dataset_stats(empty).first()["total_trades"] == 0
    assert reports.wallet_stats(empty).count() == 0
