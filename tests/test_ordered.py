from __future__ import annotations

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from augury.operators.ordered import ordered
from augury.operators.quantiles import percent_ranks, percentiles

from conftest import same_rows


@pytest.fixture(scope="module")
def frame():
    rng = random.Random(7)
    keys = ["hot"] * 300 + ["warm"] * 60 + [f"c{i % 40}" for i in range(200)] + [None] * 80
    return pd.DataFrame(
        {
            "k": keys,
            "t": [rng.randrange(50) for _ in keys],
            "id": range(len(keys)),
            "v": [round(rng.uniform(-5, 5), 2) for _ in keys],
        }
    )


@pytest.mark.parametrize("limit", [50, 100_000])
@pytest.mark.parametrize("by", [["k"], []])
def test_running_values(spark, frame, limit, by):
    df = spark.createDataFrame(frame, "k string, t int, id long, v double")
    maybe = F.when(F.col("v") > 3, F.col("v"))
    rows = ordered(df, by, ["t", "id"], limit)
    rows = rows.running("sum", F.col("v"), "total").running("max", F.col("total"), "top").running("min", F.col("v"), "low")
    rows = rows.running("last", maybe, "seen").previous(F.col("v"), "before")
    ours = rows.df.toPandas().sort_values("id").reset_index(drop=True)

    p = frame.sort_values(["t", "id"]).copy()
    p["k"] = p["k"].fillna("null") if by else "all"
    g = p.groupby("k", sort=False)
    p["total"] = g["v"].cumsum()
    p["top"] = p.groupby("k", sort=False)["total"].cummax()
    p["low"] = g["v"].cummin()
    p["maybe"] = p["v"].where(p["v"] > 3)
    p["seen"] = p.groupby("k", sort=False)["maybe"].ffill()
    p["before"] = g["v"].shift(1)
    p = p.sort_values("id").reset_index(drop=True)
    for c in ("total", "top", "low", "seen", "before"):
        pd.testing.assert_series_equal(ours[c], p[c], check_names=False, atol=1e-9)


def test_large_groups_are_cut(spark, frame):
    df = spark.createDataFrame(frame, "k string, t int, id long, v double")
    rows = ordered(df, ["k"], ["t", "id"], 50)
    sizes = {r["_run"]: r["count"] for r in rows.runs.groupBy("_run").count().collect()}
    assert len(sizes) > 5 and max(sizes.values()) < 150
    assert rows.whole.where("k = 'hot' or k is null").count() == 0


@pytest.mark.parametrize("by", [None, ["k"]])
def test_percentiles_of_large_groups_are_exact(spark, frame, by):
    df = spark.createDataFrame(frame, "k string, t int, id long, v double").withColumn("v", F.when(F.col("v") < 4, F.col("v")))
    df = df.withColumn("v", F.when(~F.col("k").eqNullSafe("c3"), F.col("v")))  # a group without any value
    probs = [0.01, 0.25, 0.5, 0.9, 0.99, 1.0]
    flat = lambda q: q.select(*(by or []), F.posexplode(F.arrays_zip("v", "t"))).select(*(by or []), "pos", "col.v", "col.t")
    same_rows(flat(percentiles(df, ["v", "t"], probs, by, limit=20)), flat(percentiles(df, ["v", "t"], probs, by)))


def test_percentiles_match_pandas(spark, frame):
    df = spark.createDataFrame(frame, "k string, t int, id long, v double")
    for limit in (20, 10_000):
        got = percentiles(df, ["v"], [0.01, 0.37, 0.99], limit=limit).first()["v"]
        assert got == pytest.approx(frame["v"].quantile([0.01, 0.37, 0.99]).tolist())


def test_percent_ranks(spark, frame):
    df = spark.createDataFrame(frame, "k string, t int, id long, v double").withColumn("v", F.when(F.col("v") < 4, F.col("v")))
    wide = percent_ranks(df, {"t": "rt", "v": "rv"}, ["k"])
    same_rows(wide, percent_ranks(df, {"t": "rt", "v": "rv"}, ["k"], limit=20))
    p = frame.copy()
    p["v"] = p["v"].where(p["v"] < 4)
    got = wide.toPandas().sort_values("id")
    for c in ("t", "v"):
        expected = p.groupby("k", dropna=False)[c].rank(pct=True)
        pd.testing.assert_series_equal(got[f"r{c}"].reset_index(drop=True), expected, check_names=False)


def test_previous_carries_null(spark):
    rows = [("a", i, None if i % 3 == 0 else float(i)) for i in range(40)]
    df = spark.createDataFrame(rows, "k string, t int, v double")
    for limit in (5, 1000):
        got = ordered(df, ["k"], ["t"], limit).previous(F.col("v"), "p").df.orderBy("t").collect()
        assert [r["p"] for r in got] == [None, *(v for _, _, v in rows[:-1])]


@pytest.mark.parametrize("by", [["k"], []])
def test_a_low_limit_asks_for_no_more_tasks(spark, frame, by, monkeypatch):
    from augury.operators import ordered as O

    monkeypatch.setattr(O, "BROADCAST_ROWS", 3)  # tables of groups and runs that are not sent to every task
    df = spark.createDataFrame(frame, "k string, t int, id long, v double")
    rows = ordered(df, by, ["t", "id"], 2)
    assert rows.runs.groupBy("_run").count().agg(F.max("count")).first()[0] <= 2
    assert rows.runs.select(F.input_file_name()).distinct().count() <= 9  # 8 shuffle partitions
    for limit in (2, 7):
        cut, plain = (ordered(df, by, ["t", "id"], n).running("last", F.when(F.col("v") > 3, F.col("v")), "seen").previous(F.col("v"), "before").df for n in (limit, 10_000))
        same_rows(cut, plain)


def test_large_groups_are_not_ranked_in_one_task(spark, frame, monkeypatch):
    from augury.operators import quantiles

    df = spark.createDataFrame(frame, "k string, t int, id long, v double")
    wide = percent_ranks(df, {"t": "rt", "v": "rv"}, ["k"])
    monkeypatch.setattr(quantiles, "IN_MEMORY_ROWS", 50)
    cut = percent_ranks(df, {"t": "rt", "v": "rv"}, ["k"])
    assert "rank(" in wide._jdf.queryExecution().toString() and "rank(" not in cut._jdf.queryExecution().toString()
    same_rows(wide, cut)
