"""Tables in and out: Parquet, CSV and JSON with fixed schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from augury import schemas


def to_utc(column: Column, kind: T.DataType) -> Column:
    """A timestamp from text, a zone-less timestamp or a timestamp. Text that does not parse becomes NULL."""
    if isinstance(kind, T.StringType):
        return F.try_to_timestamp(column)
    return column.cast("timestamp")


def normalize_timestamp(df: DataFrame, name: str = "timestamp") -> DataFrame:
    return df.withColumn(name, to_utc(F.col(name), df.schema[name].dataType))


def read_trades(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.TRADES).parquet(path)


def read_trades_csv(spark: SparkSession, path: str) -> DataFrame:
    """Trades from CSV with a header; rows whose time does not parse are left out.

    The rows come unsorted: users that need an order state it in their own window or report.
    """
    rows = spark.read.schema(schemas.TRADES_CSV).csv(path, header=True)
    return normalize_timestamp(rows).where(F.col("timestamp").isNotNull())


def read_resolutions(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    reader = spark.read.schema(schemas.RESOLUTIONS)
    return reader.csv(path, header=True) if format == "csv" else reader.parquet(path)


def read_predictions(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    reader = spark.read.schema(schemas.PREDICTIONS)
    return reader.csv(path, header=True) if format == "csv" else reader.parquet(path)


def write_table(
    df: DataFrame, path: str, format: str = "parquet", mode: str = "error", partition_by: list[str] | None = None
) -> None:
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if format == "csv":
        writer.csv(path, header=True)
    else:
        writer.format(format).save(path)


def write_by_market(trades: DataFrame, name: str, path: str | None = None, buckets: int = 200, mode: str = "error") -> DataFrame:
    """Trades as the catalog table ``name``, in ``buckets`` by market and sorted by market, time and id.

    Each bucket is one file, so the trades move once, here. Joins, groupings and windows by market then read their
    buckets where they lie; pass the same number of buckets to the event study and to copied trades, and only the
    rows looked up are moved. Choose the number so that a bucket fits a task (rows / ``spark.augury.rowsPerTask`` or
    more); a market above that limit is still cut into runs. ``path``: where the files go, else the warehouse.
    """
    laid = trades.repartition(buckets, "market_id").write.mode(mode)
    laid = laid.bucketBy(buckets, "market_id").sortBy("market_id", "timestamp", "transaction_id")
    (laid if path is None else laid.option("path", path)).saveAsTable(name)
    return trades.sparkSession.table(name)


def replace_all(df: DataFrame, path: str) -> None:
    """Empty the table and load ``df``. ``df`` must not read from ``path``."""
    write_table(df, path, mode="overwrite")


def write_metrics_json(metrics: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON object per row; metric tables have one row or one per model."""
    metrics.coalesce(1).write.mode(mode).json(path)


def sample_export(df: DataFrame, n: int = 1000) -> DataFrame:
    """The first ``n`` trades by time, ordered so that every run exports the same rows."""
    return df.orderBy("timestamp", "transaction_id").limit(n)
