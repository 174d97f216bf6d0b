from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from augury import schemas
from augury.operators import ingest
from augury.operators.reports import trade_timeline
from augury.plans import catalog
from augury.session import scratch_path
from augury.sources import feed, sample_tables, tables
from augury.streaming import feed as stream

from conftest import rows_of, same_rows


def _object(i, **changes):
    body = {
        "transactionHash": f"t{i}", "proxyWallet": f"w{i % 5}", "conditionId": f"m{i % 3}", "side": "BUY",
        "size": 2.0, "price": 0.5, "timestamp": 1_704_067_200 + 600 * i, "outcome": "Yes" if i % 2 else "",
        "title": f"Market {i % 3}", "slug": f"s{i % 3}", "eventSlug": "e",
    }
    return {**body, **changes}


def _page(folder, name, objects):
    folder.mkdir(exist_ok=True)
    (folder / f"{name}.json").write_text(json.dumps(objects))


def test_normalize_feed(spark, tmp_path):
    bad = _object(3, transactionHash="", size="7")
    odd = _object(4, size="7.5", price=None, timestamp="soon")
    short = {"transactionHash": "t5"}
    _page(tmp_path / "pages", "1", [_object(1), _object(2), bad, odd, short])
    rows = {r["transaction_id"]: r for r in feed.normalize_feed(feed.read_feed_pages(spark, str(tmp_path / "pages"))).collect()}
    assert set(rows) == {"t1", "t2", "t4", "t5"}
    assert rows["t1"]["outcome"] == "Yes" and rows["t2"]["outcome"] is None
    assert rows["t4"]["amount"] == 7.5 and rows["t4"]["price"] == 0.0 and rows["t4"]["timestamp"] is None
    assert rows["t5"]["address"] == "" and rows["t5"]["amount"] == 0.0
    assert str(rows["t1"]["timestamp"]).startswith("2024-01-01 00:10:00")


def test_parse_resolution(spark):
    rows = [
        ("tie", '["A", "B"]', '["0.5", "0.5"]', True), ("open", '["A", "B"]', '["1", "0"]', False),
        ("late", '["A", "B"]', '["0", "1"]', True), ("short", '["A"]', '["0", "1"]', True),
        ("bad", '["A", "B"]', '["x", "1"]', True), ("none", None, '["1"]', True), ("junk", "no", '["1"]', True),
        ("empty", "[]", "[]", True), ("unset", '["A", "B"]', '["1", "0"]', None),
    ]
    df = spark.createDataFrame(rows, "conditionId string, outcomes string, outcomePrices string, closed boolean")
    df = df.withColumns({"question": F.lit("q"), "slug": F.lit("s")})
    got = {r["market_id"]: r["resolution"] for r in feed.parse_resolution(df).collect()}
    assert got == {"tie": "A", "open": "__OPEN__", "late": "B", "unset": "__OPEN__"}


def test_tokens_top_markets_and_wallets(spark):
    rows = [("a", '["1", "2"]', 5.0, True), ("b", "junk", 9.0, True), ("c", '["3"]', 7.0, True), ("d", '["4"]', 99.0, False)]
    df = spark.createDataFrame(rows, "conditionId string, clobTokenIds string, volume double, closed boolean")
    top = feed.top_markets_by_volume(df, 2)
    assert [r["conditionId"] for r in top.collect()] == ["b", "c"]
    assert rows_of(feed.parse_token_ids(top)) == [("c", "3")]
    assert rows_of(feed.parse_token_ids(feed.top_markets_by_volume(df, closed=False))) == [("d", "4")]
    fills = spark.createDataFrame([("m", "x", None), ("m", "y", "x"), ("m", "", "z")], schemas.FILLS)
    assert rows_of(feed.active_wallets(fills, 2)) == [("x",), ("y",)]
    assert feed.active_wallets(fills).count() == 3
    one = spark.range(1).select(feed.coalesce_outcome(F.lit(""), F.lit("No")), feed.coalesce_outcome(F.lit(None), F.lit("")))
    assert tuple(one.first()) == ("No", None)


def test_dedup_and_merge(spark):
    kind = "transaction_id string, v int, arrival int"
    old = spark.createDataFrame([("a", 1, 1), ("a", 2, 2), ("b", 3, 3)], kind)
    new = spark.createDataFrame([("a", 9, 1), ("c", 4, 2)], kind)
    first = ingest.dedup_first(old)
    assert rows_of(first, "transaction_id") == [("a", 1, 1), ("b", 3, 3)]
    same_rows(ingest.dedup_first(first), first)
    assert rows_of(ingest.merge_keep_last(old, new), "transaction_id") == [("a", 9, 1), ("b", 3, 3), ("c", 4, 2)]
    assert rows_of(ingest.append_new(new, old)) == [("c", 4, 2)]
    assert tuple(ingest.append_counts(new, old).first()) == (1, 1)


def test_upsert_resolutions_keeps_texts(spark):
    old = spark.createDataFrame([("m1", "Q1", "__OPEN__", "s1"), ("m2", "Q2", "No", "s2")], schemas.RESOLUTIONS)
    new = spark.createDataFrame([("m1", "", "Yes", None), ("m3", "Q3", "No", "s3")], schemas.RESOLUTIONS)
    assert rows_of(ingest.upsert_resolutions(old, new), "market_id") == [
        ("m1", "Q1", "Yes", "s1"), ("m2", "Q2", "No", "s2"), ("m3", "Q3", "No", "s3"),
    ]


def test_csv_and_json_files(spark, tmp_path, make_trades):
    trades = make_trades([("t1", "a", "m", "BUY", 1.0, 0.5, "2024-01-01 10:00:00"), ("t2", "a", "m", "BUY", 1.0, 0.5, "soon")])
    text = trades.withColumn("timestamp", F.coalesce(F.col("timestamp").cast("string"), F.lit("soon")))
    tables.write_table(text, f"{tmp_path}/csv", format="csv")
    back = tables.read_trades_csv(spark, f"{tmp_path}/csv")
    assert [r["transaction_id"] for r in back.collect()] == ["t1"]
    tables.write_table(trades, f"{tmp_path}/parquet", partition_by=["side"])
    assert tables.read_trades(spark, f"{tmp_path}/parquet").count() == 2
    tables.replace_all(trades.limit(1), f"{tmp_path}/parquet2")
    tables.replace_all(trades, f"{tmp_path}/parquet2")
    assert tables.read_trades(spark, f"{tmp_path}/parquet2").count() == 2
    tables.write_metrics_json(trades.agg(F.count("*").alias("n")), f"{tmp_path}/json")
    assert spark.read.schema("n int").json(f"{tmp_path}/json").first()[0] == 2
    assert tables.sample_export(trades, 1).count() == 1


def _landing(tmp_path):
    pages = tmp_path / "pages"
    objects = [_object(i) for i in range(300)]
    _page(pages, "p1", objects[:100])
    _page(pages, "p2", objects[100:200] + [_object(7, transactionHash="")])
    _page(pages, "p2copy", objects[100:200])
    return pages, objects


def test_incremental_ingest(spark, tmp_path):
    pages, objects = _landing(tmp_path)
    store, check, res, counts = (f"{tmp_path}/{n}" for n in ("store", "check", "res", "counts"))
    outcome = {"value": "Yes"}
    fetch = lambda markets: markets.withColumn("resolution", F.lit(outcome["value"]))
    run = lambda: stream.incremental_ingest(
        spark, str(pages), store, check, fetch, res, counts, max_files=2
    ).awaitTermination()
    run()
    assert stream.read_store(spark, store).count() == 200
    run()  # nothing new
    assert stream.read_store(spark, store).count() == 200
    outcome["value"] = "No"
    _page(pages, "p3", objects[150:] + [_object(0)])
    run()
    stored = stream.read_store(spark, store)
    assert stored.count() == 300 and stored.select("transaction_id").distinct().count() == 300
    batch = feed.normalize_feed(feed.read_feed_pages(spark, str(pages)))
    columns = ["transaction_id", "address", "market_id", "amount", "timestamp", "outcome"]
    same_rows(stored.select(*columns), batch.select(*columns).distinct())
    table = rows_of(stream.read_resolution_table(spark, res).select("market_id", "question", "resolution"), "market_id")
    assert table == [("m0", "Market 0", "No"), ("m1", "Market 1", "No"), ("m2", "Market 2", "No")]
    told = spark.read.schema("total_before long, new_trades long, total_after long").json(f"{counts}/*")
    assert told.agg(F.sum("new_trades"), F.max("total_after")).first()[:] == (300, 300)
    stream.refresh_timeline(spark, store, f"{tmp_path}/months")
    assert spark.read.parquet(f"{tmp_path}/months").first()["trade_count"] == 300


def test_replayed_batch_counts_once(spark, tmp_path):
    pages, _ = _landing(tmp_path)
    raw = feed.read_feed_pages(spark, str(pages)).withColumn("_file", F.lit("f"))
    for _ in range(2):
        stream.append_batch(raw, 0, f"{tmp_path}/store")
    assert stream.read_store(spark, f"{tmp_path}/store").count() == 200


def _drain(rows, tmp_path):
    rows.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start(
        f"{tmp_path}/out"
    ).awaitTermination()
    return rows.sparkSession.read.schema(rows.schema).parquet(f"{tmp_path}/out")


def test_stream_dedup_equals_batch(spark, tmp_path):
    pages, _ = _landing(tmp_path)
    out = _drain(stream.stream_dedup(stream.stream_trades(spark, str(pages), 1)), tmp_path)
    assert out.count() == 200 and out.select("transaction_id").distinct().count() == 200


def test_stream_timeline_equals_batch_on_closed_periods(spark, tmp_path):
    pages, _ = _landing(tmp_path)
    trades = stream.stream_dedup(stream.stream_trades(spark, str(pages), 10), "2 hours")
    with pytest.raises(ValueError):
        stream.stream_timeline(trades, "month")
    out = _drain(stream.stream_timeline(stream.stream_trades(spark, str(pages), 10), "hour", "2 hours"), tmp_path)
    batch = feed.normalize_feed(feed.read_feed_pages(spark, str(pages)))
    whole = trade_timeline(batch, "hour").withColumn("bucket", F.to_timestamp("period")).drop("period")
    last = out.agg(F.max("bucket")).first()[0]
    assert out.count() > 20
    same_rows(out, whole.where(F.col("bucket") <= F.lit(last)))


def test_first_arrivals_by_state(spark, tmp_path):
    """Repeats within a batch, across batches and after a restart; a late trade of any age; state rows counted."""
    pages = tmp_path / "pages"
    store, check = f"{tmp_path}/store", f"{tmp_path}/check"
    run = lambda: stream.incremental_ingest(spark, str(pages), store, check, max_files=1, by_state=True, sketches=f"{tmp_path}/sketches").awaitTermination()
    objects = [_object(i) for i in range(60)]
    _page(pages, "p10", [*objects[:20], {**objects[3], "size": "999"}])
    run()
    _page(pages, "p2", [{**o, "size": "777"} for o in objects[10:20]] + objects[20:40])
    run()
    _page(pages, "p1", objects[40:] + [{**objects[0], "size": "555"}, _object(5000, timestamp="1000")])
    run()
    run()
    stored = stream.read_store(spark, store)
    assert stored.count() == 61 and stored.agg(F.max("amount")).first()[0] < 555
    assert {r["batch"]: r["count"] for r in stored.groupBy("batch").count().collect() if r["count"]} == {0: 20, 1: 20, 2: 21}
    assert stream.stored_state(spark, check).count() == 61
    stats = stream.store_stats(spark, f"{tmp_path}/sketches").first()
    exact = stored.agg(F.count("*"), F.countDistinct("market_id"), F.countDistinct("address"), F.max("timestamp")).first()
    assert tuple(stats) == tuple(exact)


def test_old_versions_of_resolutions_go(spark, tmp_path):
    path = f"{tmp_path}/res"
    for k in range(4):
        new = spark.createDataFrame([("m", "q", f"r{k}", "s")], "market_id string, question string, resolution string, slug string")
        stream.upsert_resolution_table(spark, new, path, k)
    stream.upsert_resolution_table(spark, new.withColumn("resolution", F.lit("again")), path, 3)  # a replay
    assert stream.read_resolution_table(spark, path).first()["resolution"] == "again"
    assert {r["version"] for r in spark.read.parquet(path).select("version").distinct().collect()} == {2, 3}


def test_pages_land_in_many_files_in_order_of_arrival(spark, small, monkeypatch):
    """A page is not one task; the files' times and names follow the objects' order, over pages and within one."""
    monkeypatch.setattr(catalog, "FILE_ROWS", 30)
    folder = scratch_path(spark, "landed")
    files = [catalog._land(spark, small, folder, k) for k in range(catalog.PAGES)]
    feed_rows = sample_tables.feed_text(spark, small)
    assert files[0] > 3 and len(set(files)) == 1
    landed = spark.read.text(folder).select("value", "_metadata.file_modification_time", "_metadata.file_name")
    met = landed.join(feed_rows.select("arrival", F.col("body").alias("value")), "value").groupBy("file_modification_time", "file_name")
    spans = sorted(tuple(r) for r in met.agg(F.min("arrival"), F.max("arrival"), F.count("*")).collect())
    assert len(spans) == catalog.PAGES * files[0] and sum(s[4] for s in spans) == feed_rows.count() == landed.count()
    assert len({s[0] for s in spans}) == len(spans) and max(s[4] for s in spans) <= 31
    assert all(a[3] < b[2] for a, b in zip(spans, spans[1:]))


@pytest.mark.parametrize("name", ["stream_first_arrivals", "stream_ingest_batches"])
def test_first_arrivals_over_many_files(spark, small, monkeypatch, name):
    whole = catalog.QUERIES[name](spark, small)
    monkeypatch.setattr(catalog, "FILE_ROWS", 60)
    same_rows(catalog.QUERIES[name](spark, small), whole)
