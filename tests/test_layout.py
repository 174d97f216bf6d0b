"""Trades in buckets by market: same results, and plans that leave the ticks where they lie."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from augury.operators import events
from augury.operators.asof import asof_join
from augury.session import release, scratch_table
from augury.sources.tables import write_by_market

from conftest import same_rows

BUCKETS = 5


@pytest.fixture
def trades(spark):
    rng = random.Random(11)
    rows = []
    for i in range(600):
        market = None if i % 97 == 0 else "hot" if i % 3 == 0 else f"m{rng.randrange(12)}"
        at = 1_700_000_000 + rng.randrange(40) * 60
        rows.append((f"t{i:04d}", f"a{rng.randrange(9)}", market, rng.choice(["BUY", "SELL"]), 10.0, rng.random(), at, 5.0))
    kind = "transaction_id string, address string, market_id string, side string, amount double, price double, at long, volume double"
    return spark.createDataFrame(rows, kind).withColumn("timestamp", F.timestamp_seconds("at")).drop("at")


def laid_out(spark, trades):
    name, path = scratch_table(spark, "layout")
    return name, write_by_market(trades, name, path, BUCKETS)


def exchanges(df):
    """The tables read below each exchange of the plan."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    lines = plan.split("\n")
    found = []
    for i, line in enumerate(lines):
        if re.search(r"(?<!Broadcast)Exchange ", line):
            depth = len(line) - len(line.lstrip(" :+-"))
            below = []
            for after in lines[i + 1 :]:
                if len(after) - len(after.lstrip(" :+-")) <= depth:
                    break
                below.append(after)
            found.append("\n".join(below))
    return found


def test_asof_moves_nothing(spark, trades):
    name, table = laid_out(spark, trades)
    probes = table.where("side = 'BUY'").select("transaction_id", "market_id", "price", (F.col("timestamp") + F.expr("interval 3 minutes")).alias("at"))
    ticks = table.select("market_id", "timestamp", "transaction_id", "price")
    got = asof_join(probes, ticks)
    assert exchanges(got) == []
    plain = asof_join(trades.where("side = 'BUY'").select("transaction_id", "market_id", "price", (F.col("timestamp") + F.expr("interval 3 minutes")).alias("at")), trades)
    same_rows(got, plain)


@pytest.mark.parametrize("limit", [None, 50])
def test_study_and_copies(spark, trades, make_resolutions, limit):
    name, table = laid_out(spark, trades)
    informed = spark.createDataFrame([(f"a{k}",) for k in range(4)], "address string")
    study = events.event_study(table, informed, [1, 5], limit=limit, buckets=BUCKETS)
    if limit is None:
        assert not any(name in below for below in exchanges(study))
    same_rows(study, events.event_study(trades, informed, [1, 5]))
    results = make_resolutions({"hot": "Yes", "m1": "No", "m2": "YES", "m3": None})
    copied = events.copy_trades(table, informed, results, latency_minutes=2, limit=limit, buckets=BUCKETS)
    if limit is None:
        assert not any(name in below for below in exchanges(copied))
    same_rows(copied, events.copy_trades(trades, informed, results, latency_minutes=2))


def test_release_drops_the_table(spark, trades):
    name, table = laid_out(spark, trades.limit(0))
    assert table.count() == 0 and spark.catalog.tableExists(name)
    release(spark)
    assert not spark.catalog.tableExists(name)
