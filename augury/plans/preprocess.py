"""Trades and resolutions to the labelled model input, with the exported tables in between."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from augury.operators import clean, features, labels
from augury.sources.tables import write_table


def preprocess(
    trades: DataFrame,
    resolutions: DataFrame,
    out: str,
    min_trades: int = 3,
    min_volume: float = 50.0,
    top_percentile: float | None = None,
    label_mode: str = "auto",
    train: float = 0.7,
    val: float = 0.15,
    as_of=None,
) -> DataFrame:
    """Clean, compute features, split and label; writes ``cleaned`` and ``model_input`` below ``out``.

    The cleaned trades are written because features, splits and labels all read them. With ``as_of`` (a timestamp)
    these three come from the trades before it alone, cleaned by themselves: later trades change nothing.
    """
    spark = trades.sparkSession
    cleaned = clean.clean(trades, min_trades, min_volume, top_percentile)
    schema = cleaned.schema
    write_table(cleaned, f"{out}/cleaned", mode="overwrite")
    seen = spark.read.schema(schema).parquet(f"{out}/cleaned")
    if as_of is not None:
        before = trades.where(F.col("timestamp") < F.lit(as_of).cast("timestamp"))
        write_table(clean.clean(before, min_trades, min_volume, top_percentile), f"{out}/seen", mode="overwrite")
        seen = spark.read.schema(schema).parquet(f"{out}/seen")
    matrix = features.build_features(seen, resolutions)
    split = labels.temporal_split(matrix, seen, train, val)
    labeled = labels.label_traders(split, seen, resolutions, mode=label_mode)
    write_table(labeled, f"{out}/model_input", mode="overwrite", partition_by=["split"])
    return spark.read.schema(labeled.schema).parquet(f"{out}/model_input")


