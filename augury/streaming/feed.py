"""Landed feed pages as a stream: normalise, dedup, keep reports current, append to the store.

The store is a folder of Parquet partitions, one per micro-batch. A batch that is replayed after a failure overwrites
its own partition, so its rows never count twice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from augury import schemas
from augury.functions.numbers import round_money
from augury.operators import ingest
from augury.operators.reports import trade_timeline
from augury.operators.sketches import load_sketch, sketched_stats
from augury.session import remove, scratch_path
from augury.sources.feed import normalize_feed
from augury.sources.tables import write_metrics_json

_STORED = T.StructType(
    [*schemas.TRADES.fields]
    + [T.StructField(c, T.StringType()) for c in ("title", "slug", "event_slug")]
    + [T.StructField("batch", T.LongType())]
)


def stream_pages(spark: SparkSession, path: str, max_files: int = 1000, lines: bool = False) -> DataFrame:
    """Pages as they land: one JSON array per file, or one object per line."""
    reader = spark.readStream.schema(schemas.FEED_TRADE).option("maxFilesPerTrigger", max_files)
    return reader.option("multiLine", not lines).json(path)


def stream_trades(spark: SparkSession, path: str, max_files: int = 1000, lines: bool = False) -> DataFrame:
    """New pages as normalised trades."""
    return normalize_feed(stream_pages(spark, path, max_files, lines))


def stream_dedup(trades: DataFrame, delay: str = "1 day") -> DataFrame:
    """Drop hashes seen within ``delay`` of event time. State stays bounded; later rows and rows without a time are
    dropped. For the exact, unbounded rule use :func:`incremental_ingest`."""
    timed = trades.where(F.col("timestamp").isNotNull()).withWatermark("timestamp", delay)
    return timed.dropDuplicatesWithinWatermark(["transaction_id"])


def keep_state_on_disk(spark: SparkSession) -> None:
    """State of streams started from now on lives in RocksDB on the executors' disks, with changes logged to the checkpoint."""
    state = "spark.sql.streaming.stateStore"
    spark.conf.set(f"{state}.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set(f"{state}.rocksdb.changelogCheckpointing.enabled", "true")


def stream_first(raw: DataFrame) -> DataFrame:
    """The first arrival of each hash, from landed objects with their place ``_file``; for output mode ``update``.

    Every hash ever seen has a row of state, so a repeat of any age is found, and a late trade accepted, by looking up the
    hashes of the batch alone: the work of a batch doesn't grow with the store. All rows of one batch carry the batch's
    time, which a replay repeats: a hash whose earliest and latest times are equal has come for the first time.
    """
    schema = T.StructType([*raw.schema.fields, T.StructField("_row", T.LongType())])

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A stream has no row numbers of its own: rows are counted as a task reads them."""
        done = 0
        for batch in batches:
            rows = pa.array(range(done, done + batch.num_rows), pa.int64())
            done += batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, rows], names=[*batch.schema.names, "_row"])

    placed = raw.mapInArrow(numbered, schema).withColumn("arrival", F.struct("_file", "_row"))
    trades = normalize_feed(placed, keep=("arrival",)).withColumn("_seen", F.current_timestamp())
    columns = [c for c in trades.columns if c not in ("transaction_id", "arrival", "_seen")]
    kept = trades.groupBy("transaction_id").agg(
        F.min_by(F.struct(*columns), "arrival").alias("_row"), F.min("_seen").alias("_first"), F.max("_seen").alias("_last")
    )
    return kept.where(F.col("_first") == F.col("_last")).select("transaction_id", "_row.*")


def stored_state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The hashes that a stream with the checkpoint has in its state."""
    return spark.read.format("statestore").load(checkpoint).select(F.col("key.transaction_id").alias("transaction_id"))


def stream_timeline(trades: DataFrame, interval: str = "hour", delay: str = "1 day") -> DataFrame:
    """Trades, volume and wallets per hour or day; a period is emitted once it can no longer change.

    Two stateful steps: a row for each period and wallet, then the period. So wallets are counted exactly, and a period's
    wallets are spread over the tasks. Rows later than ``delay``, and rows without a time, are dropped.
    """
    if interval not in ("hour", "day"):
        raise ValueError("a stream groups by hour or day; months have no fixed length, use refresh_timeline")
    timed = trades.where(F.col("timestamp").isNotNull()).withWatermark("timestamp", delay)
    each = timed.groupBy(F.window("timestamp", f"1 {interval}").alias("period"), "address").agg(
        F.count("*").alias("n"), F.sum(F.col("amount") * F.col("price")).alias("v")
    )
    return each.groupBy(F.window("period", f"1 {interval}")).agg(
        F.sum("n").alias("trade_count"), round_money(F.sum("v")).alias("volume"), F.count("address").alias("unique_wallets")
    ).select(F.col("window.start").alias("bucket"), "trade_count", "volume", "unique_wallets")


def read_store(spark: SparkSession, store: str) -> DataFrame:
    """All stored trades. The columns are fixed, so an empty store reads as an empty table."""
    try:
        return spark.read.schema(_STORED).parquet(store)
    except Exception as error:  # the folder appears with the first batch
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], _STORED)


def append_batch(raw: DataFrame, batch_id: int, store: str) -> DataFrame:
    """Append the unseen trades of one micro-batch and return them. A trade of any age is accepted: only its hash
    decides."""
    spark = raw.sparkSession
    seen = read_store(spark, store).where(F.col("batch") != batch_id).select("transaction_id")
    # Order of arrival: when a file landed, its name, the place of the split in it, and the row's place in the split.
    placed = raw.withColumn("arrival", F.struct(F.col("_file"), F.monotonically_increasing_id().alias("_row")))
    numbered = normalize_feed(placed, keep=("arrival",))
    scratch = scratch_path(spark, "batch")
    kept = ingest.dedup_first(numbered).drop("arrival")
    kept.write.parquet(scratch)
    fresh = ingest.append_new(spark.read.schema(kept.schema).parquet(scratch), seen)
    fresh.select(*[c.name for c in _STORED.fields[:-1]]).write.mode("overwrite").parquet(f"{store}/batch={batch_id}")
    remove(spark, scratch)
    return read_store(spark, store).where(F.col("batch") == batch_id)


def upsert_resolution_table(spark: SparkSession, new: DataFrame, path: str, batch_id: int) -> None:
    """Merge new resolutions into the table of the last version below ``path`` and write the next version.

    Versions are folders named by batch: a replayed batch reads the version before it and writes the same again.
    """
    old = read_resolution_table(spark, path, before=batch_id)
    merged = ingest.upsert_resolutions(old, new)
    merged.write.mode("overwrite").parquet(f"{path}/version={batch_id}")
    # A replay needs the version before this one, and none older.
    versions = spark.read.schema("version bigint").parquet(path).select("version").distinct().collect()
    for version in sorted(r["version"] for r in versions if r["version"] < batch_id)[:-1]:
        remove(spark, f"{path}/version={version}")


def read_resolution_table(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    kind = T.StructType([*schemas.RESOLUTIONS.fields, T.StructField("version", T.LongType())])
    try:
        table = spark.read.schema(kind).parquet(path)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schemas.RESOLUTIONS)
    if before is not None:
        table = table.where(F.col("version") < before)
    latest = table.agg(F.max("version")).first()[0]
    return table.where(F.col("version") == F.lit(latest)).drop("version")


def incremental_ingest(
    spark: SparkSession,
    pages: str,
    store: str,
    checkpoint: str,
    fetch_resolutions: Callable[[DataFrame], DataFrame] | None = None,
    resolutions: str | None = None,
    counts: str | None = None,
    max_files: int = 1000,
    lines: bool = False,
    sketches: str | None = None,
    by_state: bool = False,
) -> StreamingQuery:
    """Process all pages that have landed since the last run, then stop. Nothing new means nothing written.

    ``by_state`` finds repeats by the stream's own state on disk (see :func:`stream_first`) instead of the store's hashes;
    a store is then written by one checkpoint from its start.

    ``fetch_resolutions`` maps a table of market ids to their resolutions (market_id, resolution); they are merged
    into ``resolutions``. ``counts`` receives one JSON object per batch, ``sketches`` one row (see :func:`store_stats`).
    """

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        before = read_store(spark, store).where(F.col("batch") != batch_id)
        if by_state:
            columns = [c.name for c in _STORED.fields[:-1]]
            batch.select(*columns).write.mode("overwrite").parquet(f"{store}/batch={batch_id}")
            added = read_store(spark, store).where(F.col("batch") == batch_id)
        else:
            added = append_batch(batch, batch_id, store)
        if fetch_resolutions is not None and resolutions is not None:
            markets = added.where("market_id <> ''").select("market_id").distinct()
            described = ingest.describe_markets(
                fetch_resolutions(markets), added.withColumn("arrival", F.col("transaction_id"))
            )
            upsert_resolution_table(spark, described, resolutions, batch_id)
        if sketches is not None:
            load_sketch(added).write.mode("overwrite").parquet(f"{sketches}/batch={batch_id}")
        if counts is not None:
            write_metrics_json(ingest.load_counts(before, added), f"{counts}/batch={batch_id}")

    place = F.struct("_metadata.file_modification_time", "_metadata.file_path", "_metadata.file_block_start")
    raw = stream_pages(spark, pages, max_files, lines).select("*", place.alias("_file"))
    if by_state:
        keep_state_on_disk(spark)
    return (
        (stream_first(raw).writeStream.outputMode("update") if by_state else raw.writeStream).foreachBatch(on_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_sketches(spark: SparkSession, sketches: str) -> DataFrame:
    """The sketches of all loads, one row each, with the number of the batch."""
    kind = "total_trades bigint, latest_timestamp timestamp, wallets binary, markets binary, batch bigint"
    return spark.read.schema(kind).parquet(sketches)


def store_stats(spark: SparkSession, sketches: str) -> DataFrame:
    """Totals of the store with estimated distinct counts, from one row per load: no stored trade is read."""
    return sketched_stats(read_sketches(spark, sketches))


def refresh_timeline(spark: SparkSession, store: str, target: str, interval: str = "month") -> None:
    """Rewrite the timeline report from the store; the way to months, and to exact wallet counts."""
    trade_timeline(read_store(spark, store), interval).write.mode("overwrite").parquet(target)
