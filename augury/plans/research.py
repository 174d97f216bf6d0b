"""Event study and copied trades of the traders a model calls informed."""

from __future__ import annotations

from pyspark.sql import DataFrame

from augury.operators import equity, events
from augury.sources.tables import write_metrics_json, write_table


def run_event_study(cleaned: DataFrame, predictions: DataFrame, out: str, windows: list[int] | None = None) -> DataFrame:
    """Write the event study rows, return the summary per horizon."""
    study = events.event_study(cleaned, events.informed_set(predictions), windows or events.LONG_WINDOWS)
    write_table(study, f"{out}/event_study", mode="overwrite")
    stored = cleaned.sparkSession.read.parquet(f"{out}/event_study")
    return events.event_study_summary(stored)


def run_copy_trades(
    cleaned: DataFrame,
    predictions: DataFrame,
    resolutions: DataFrame,
    out: str,
    latency_minutes: int = 5,
    trade_size: float = 100.0,
    fee: float = 0.001,
    order: str = "time",
) -> DataFrame:
    """Write the copied trades with their equity curve and the metrics, return the metrics."""
    informed = events.informed_set(predictions)
    copies = events.copy_trades(cleaned, informed, resolutions, latency_minutes, trade_size, fee)
    write_table(copies, f"{out}/fills", mode="overwrite")
    stored = cleaned.sparkSession.read.parquet(f"{out}/fills")
    write_table(equity.equity_curve(stored, order=order), f"{out}/copy_trades", mode="overwrite")
    curve = cleaned.sparkSession.read.parquet(f"{out}/copy_trades")
    metrics = events.copy_metrics(curve, trade_size).crossJoin(events.daily_sharpe(curve).select("sharpe_ratio"))
    write_metrics_json(metrics, f"{out}/copy_metrics")
    return metrics
