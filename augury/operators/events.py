"""Event study, copied trades and positions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from augury.functions.numbers import hash_draw, safe_div
from augury.functions.outcomes import expert_bet, is_buy, normalise_resolution_strict
from augury.functions.trades import copy_order_size
from augury.operators.asof import asof_join
from augury.operators.joins import cross_scalar, keep_members
from augury.session import materialise

# Horizons in minutes of the short and the long event study.
WINDOWS = [5, 15, 60, 1440]
LONG_WINDOWS = [1, 5, 15, 30, 60, 240, 1440]


def informed_set(predictions: DataFrame) -> DataFrame:
    """Addresses predicted as informed; every address where there is no prediction column."""
    if "predicted_label" in predictions.columns:
        predictions = predictions.where(F.col("predicted_label") == 1)
    return predictions.select("address").distinct()


def _minutes(n: Column) -> Column:
    return F.make_dt_interval(mins=n.cast("int"))


def _dealt(probes: DataFrame, buckets: int | None) -> DataFrame:
    """Probes in the buckets of a table of trades that lies by market."""
    return probes if buckets is None else probes.repartition(buckets, "market_id")


def event_prices(
    trades: DataFrame, informed: DataFrame, windows: list[int] | None = None, limit: int | None = None, buckets: int | None = None
) -> DataFrame:
    """Long form: one row per informed trade and horizon with the price then and the move in the trade's favour.

    ``buckets``: of a table of trades written by ``write_by_market``; its trades then stay where they are.
    """
    windows = windows or WINDOWS
    chosen = keep_members(trades, informed, "address").select(
        "transaction_id", "address", "market_id", "timestamp",
        F.upper("side").alias("side"), F.col("price").alias("entry_price"), "volume",
    )
    # Written once: the chosen trades are the probes, name the markets to read, and are counted per market.
    chosen = materialise(chosen, "chosen")
    probes = chosen.select("*", F.explode(F.array(*[F.lit(w) for w in windows])).alias("horizon"))
    probes = _dealt(probes.withColumn("at", F.col("timestamp") + _minutes(F.col("horizon"))), buckets)
    # Only markets the informed traders touched need their ticks sorted.
    ticks = keep_members(trades, chosen, "market_id").select("market_id", "timestamp", "transaction_id", "price")
    # Counted per market without the semi-join: probes and all trades of a market are no fewer than what is sorted.
    sizes = probes.select("market_id").union(trades.select("market_id"))
    priced = asof_join(probes, ticks, out="price", default="entry_price", limit=limit, sizes_from=sizes)
    move = F.col("price") - F.col("entry_price")
    return priced.drop("at").withColumn("delta", F.when(F.col("side") == "SELL", -move).otherwise(move))


def event_study(
    trades: DataFrame, informed: DataFrame, windows: list[int] | None = None, limit: int | None = None, buckets: int | None = None
) -> DataFrame:
    """Wide form: one row per informed trade, ``delta_{w}m`` and ``price_{w}m`` per horizon."""
    windows = windows or WINDOWS
    long = event_prices(trades, informed, windows, limit, buckets)
    # The group starts with the market, by which the rows already are partitioned: no further shuffle.
    keys = ["market_id", "transaction_id", "address", "timestamp", "side", "entry_price", "volume"]
    at = lambda c, w: F.max(F.when(F.col("horizon") == w, F.col(c))).alias(f"{c}_{w}m")
    wide = long.groupBy(*keys).agg(*[at(c, w) for w in windows for c in ("delta", "price")])
    return wide.select("transaction_id", "address", "market_id", *keys[3:], *wide.columns[len(keys):])


def _horizon_rows(study: DataFrame) -> DataFrame:
    windows = [int(c[6:-1]) for c in study.columns if c.startswith("delta_") and c.endswith("m")]
    cells = F.array(*[F.struct(F.lit(w).alias("horizon"), F.col(f"delta_{w}m").alias("delta")) for w in windows])
    return study.select("volume", F.inline(cells))


def event_study_summary(study: DataFrame) -> DataFrame:
    """Per horizon: mean move, share of moves in favour, deviation, standard error and half width of its 95% band."""
    stats = _horizon_rows(study).groupBy("horizon").agg(
        F.count("*").alias("events"),
        F.avg("delta").alias("mean_delta"),
        F.avg((F.col("delta") > 0).cast("double")).alias("win_rate"),
        F.stddev_samp("delta").alias("std_delta"),
    )
    error = F.when(F.col("events") > 1, F.col("std_delta") / F.sqrt("events")).otherwise(0.0)
    return stats.withColumn("sem", error).withColumn("ci95", 1.96 * F.col("sem"))


def whale_impact(study: DataFrame, min_volume: float = 500.0) -> DataFrame:
    """Mean move per horizon after large trades."""
    large = _horizon_rows(study.where(F.col("volume") >= min_volume))
    return large.groupBy("horizon").agg(F.count("*").alias("events"), F.avg("delta").alias("mean_delta"))


def copy_trades(
    trades: DataFrame,
    informed: DataFrame,
    resolutions: DataFrame,
    latency_minutes: int = 5,
    trade_size: float = 100.0,
    fee: float = 0.001,
    limit: int | None = None,
    buckets: int | None = None,
) -> DataFrame:
    """Copies of informed purchases in resolved markets, filled at the price known after the delay.

    ``buckets``: as for ``event_prices``.

    A fill at price 0 on a winning bet has no defined profit: it is NULL and ``undefined_profit`` is set.
    """
    results = resolutions.select("market_id", normalise_resolution_strict(F.col("resolution")).alias("result"))
    bought = keep_members(trades.where(is_buy(F.col("side"))), informed, "address")
    bets = bought.join(results.where(F.col("result").isin("YES", "NO")), "market_id").select(
        "transaction_id", "market_id", F.col("address").alias("expert_address"),
        F.col("timestamp").alias("entry_time"), F.col("price").alias("expert_price"), "result",
    )
    bets = materialise(bets, "bets")
    probes = _dealt(bets.withColumn("at", F.col("entry_time") + _minutes(F.lit(latency_minutes))), buckets)
    ticks = keep_members(trades, bets, "market_id").select("market_id", "timestamp", "transaction_id", "price")
    sizes = probes.select("market_id").union(trades.select("market_id"))
    filled = asof_join(probes, ticks, out="exec_price", default="expert_price", limit=limit, sizes_from=sizes)
    bet = expert_bet(F.col("expert_price"))
    won = bet == F.col("result")
    profit = F.when(won, (1.0 - F.col("exec_price")) * F.try_divide(F.lit(trade_size), F.col("exec_price"))).otherwise(
        -trade_size
    )
    gap = F.col("exec_price") - F.col("expert_price")
    return filled.select(
        "transaction_id",
        F.col("at").alias("timestamp"),
        "market_id",
        "expert_address",
        "exec_price",
        "expert_price",
        F.when(bet == "YES", gap).otherwise(-gap).alias("slippage"),
        (profit - trade_size * fee).alias("net_profit"),
        (won & (F.col("exec_price") == 0)).alias("undefined_profit"),
    )


def copy_metrics(curve: DataFrame, trade_size: float = 100.0) -> DataFrame:
    """One row of results over copied trades that carry their equity curve (``balance``, ``drawdown``).

    A fill with undefined profit is a winning bet and counts as won; the sums leave it out.
    """
    total = F.sum("net_profit")
    n = F.count("*")
    return curve.agg(
        n.alias("total_trades"),
        F.avg(F.coalesce(F.col("net_profit") > 0, F.col("undefined_profit")).cast("double")).alias("win_rate"),
        total.alias("total_net_profit"),
        (total / (F.avg("exec_price") * n + 1e-5)).alias("roi_ref"),
        (total / (n * F.lit(trade_size))).alias("roi_capital"),
        F.greatest(F.max("drawdown"), F.lit(0.0)).alias("max_drawdown"),
        F.avg("slippage").alias("average_slippage"),
    )


def daily_sharpe(copies: DataFrame) -> DataFrame:
    """Annualised ratio of mean to deviation of the daily profit; 0 for one day or no deviation."""
    days = copies.groupBy(F.to_date("timestamp").alias("day")).agg(F.sum("net_profit").alias("net"))
    stats = days.agg(F.count("*").alias("days"), F.avg("net").alias("m"), F.stddev_samp("net").alias("s"))
    ratio = F.when((F.col("days") > 1) & (F.col("s") > 0), F.col("m") / F.col("s") * F.sqrt(F.lit(365.0)))
    return stats.select("days", F.coalesce(ratio, F.lit(0.0)).alias("sharpe_ratio"))


def signal_orders(trades: DataFrame, rule: Callable[[DataFrame], tuple[Column, Column]]) -> DataFrame:
    """Orders by a user's rule: a function from the trades to a filter and a size column. A missing outcome is Yes."""
    wanted, size = rule(trades)
    outcome = F.coalesce("outcome", F.lit("Yes")) if "outcome" in trades.columns else F.lit("Yes")
    return trades.where(wanted).select(
        "transaction_id", "address", "market_id", outcome.alias("outcome"), F.lit("BUY").alias("side"),
        size.alias("amount"), "price", "timestamp",
    )


def _tradable() -> Column:
    return is_buy(F.col("side")) & (F.col("price") > 0) & (F.col("price") < 1.0)


def copy_orders(trades: DataFrame, targets: DataFrame, fraction: float = 0.05, cap: float = 500.0) -> DataFrame:
    """Scaled and capped copies of the purchases of chosen wallets; copies of 1 or less are not placed."""
    size = copy_order_size(F.col("amount"), fraction, cap)
    return signal_orders(keep_members(trades, targets, "address"), lambda t: (_tradable() & (size > 1.0), size))


def random_orders(trades: DataFrame, probability: float = 0.01, size: float = 50.0, salt: str = "") -> DataFrame:
    """Fixed-size purchases at trades drawn by a hash of their id, the same ones in every run."""
    drawn = hash_draw(F.col("transaction_id"), salt) < probability
    return signal_orders(trades, lambda t: (_tradable() & drawn, F.lit(size)))


def coin_flips(copies: DataFrame, size: float = 100.0, salt: str = "coin") -> DataFrame:
    """For each copied trade a fair gain or loss of the same size."""
    heads = hash_draw(F.col("transaction_id"), salt) < 0.5
    return copies.select("transaction_id", "timestamp", F.when(heads, size).otherwise(-size).alias("net_profit"))


def positions(trades: DataFrame) -> DataFrame:
    """Signed share balance, volume-weighted purchase price and last trade per trader and market."""
    buy = is_buy(F.col("side"))
    return trades.groupBy("address", "market_id").agg(
        F.sum(F.when(buy, F.col("amount")).otherwise(-F.col("amount"))).alias("token_balance"),
        F.try_divide(
            F.sum(F.when(buy, F.col("amount") * F.col("price"))), F.sum(F.when(buy, F.col("amount")))
        ).alias("avg_price"),
        F.max("timestamp").alias("last_updated"),
    )


def histogram(df: DataFrame, column: str, bins: int = 15) -> DataFrame:
    """Counts over equal-width bins from the smallest to the largest value, empty bins included."""
    values = materialise(df.select(F.col(column).alias("v")).where("v is not null"), "histogram")
    edges = values.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    width = F.col("hi") - F.col("lo")
    place = F.floor(safe_div((F.col("v") - F.col("lo")) * bins, width)).cast("int")
    counts = cross_scalar(values, edges).groupBy(F.least(place, F.lit(bins - 1)).alias("bin")).agg(
        F.count("*").alias("n")
    )
    frame = edges.select("lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return frame.join(counts, "bin", "left").select(
        "bin",
        (F.col("lo") + width * F.col("bin") / bins).alias("bin_start"),
        (F.col("lo") + width * (F.col("bin") + 1) / bins).alias("bin_end"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )
