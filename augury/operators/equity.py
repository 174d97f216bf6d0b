"""Equity curves: running balance, peak and drawdown over a whole table in one order."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from augury.operators.ordered import ordered

# Row orders of an equity curve. Both end with the unique trade id.
ORDERS = {"time": ["timestamp", "transaction_id"], "market": ["market_id", "timestamp", "transaction_id"]}


def equity_curve(
    copies: DataFrame, initial: float = 10_000.0, order: str = "time", limit: int | None = None
) -> DataFrame:
    """Add the running balance, its peak (at least the start) and the drawdown from it.

    ``order='time'`` is the path in time; ``order='market'`` runs market by market.
    """
    net = F.coalesce("net_profit", F.lit(0.0))
    path = ordered(copies, [], ORDERS[order], limit).running("sum", net, "_sum")
    path = path.running("max", F.greatest(F.col("_sum"), F.lit(0.0)), "_top")
    balance, peak = F.lit(initial) + F.col("_sum"), F.lit(initial) + F.col("_top")
    drawdown = F.when(peak > 0, (peak - balance) / peak).otherwise(0.0)
    return path.df.withColumns({"balance": balance, "peak": peak, "drawdown": drawdown}).drop("_sum", "_top")


def equity_path(equity: DataFrame, order: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """Add peak, drawdown (at or below 0) and step returns to a table with ``total_equity``."""
    path = ordered(equity, [], order or ["timestamp"], limit)
    path = path.running("max", F.col("total_equity"), "peak").previous(F.col("total_equity"), "_before").df
    return path.withColumns(
        {
            "drawdown": (F.col("total_equity") - F.col("peak")) / F.col("peak"),
            "returns": F.coalesce(F.try_divide("total_equity", "_before") - 1.0, F.lit(0.0)),
        }
    ).drop("_before")


def equity_metrics(
    equity: DataFrame, initial: float = 10_000.0, order: list[str] | None = None, limit: int | None = None
) -> DataFrame:
    """Final equity, total return, deepest drawdown (both in percent) and the step Sharpe ratio, as one row."""
    order = order or ["timestamp"]
    stats = equity_path(equity, order, limit).agg(
        F.max_by("total_equity", F.struct(*order)).alias("final_equity"),
        (F.min("drawdown") * 100).alias("max_drawdown_pct"),
        F.avg("returns").alias("m"),
        F.stddev_samp("returns").alias("s"),
    )
    sharpe = F.when(F.col("s") > 0, F.col("m") / F.col("s") * F.sqrt(F.lit(365.0)))
    return stats.select(
        F.lit(initial).alias("initial_capital"),
        "final_equity",
        ((F.col("final_equity") - initial) / initial * 100).alias("total_return_pct"),
        "max_drawdown_pct",
        F.coalesce(sharpe, F.lit(0.0)).alias("sharpe_ratio"),
    )


def alpha(strategy: DataFrame, baseline: DataFrame) -> DataFrame:
    """Difference of two runs' total returns in percentage points."""
    base = baseline.select(F.col("total_return_pct").alias("_base"))
    return strategy.crossJoin(base).select((F.col("total_return_pct") - F.col("_base")).alias("alpha_pct"))
