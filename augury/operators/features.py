"""The per-trader feature matrix.

The trades are read once. Inside that pass they are shuffled by trader, a window adds the previous price, a second
one the running profit per market, and everything is folded to one row per (trader, market). That pair table is
written; markets, resolutions and traders are all worked out from it, so no later step touches the trades again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from augury import schemas
from augury.functions.numbers import clip, safe_div
from augury.functions.outcomes import is_buy, is_resolved_raw
from augury.functions.trades import counts_for_returns, seconds, trade_invested, trade_pnl, trade_won
from augury.operators.joins import cross_scalar, outer_blocks
from augury.operators.ordered import ordered
from augury.operators.quantiles import percentiles
from augury.session import materialise, rows_per_task

# Times enter sums as seconds since this origin (2020-01-01), which keeps the sums of doubles precise.
_ORIGIN = 1_577_836_800.0
_DAY = 86_400.0


def _returns():
    """Profit, stake and outcome by the price rule; NULL for trades that do not count."""
    side, amount, price = F.col("side"), F.col("amount"), F.col("price")
    counted = counts_for_returns(amount, price)
    return (
        F.when(counted, trade_pnl(side, amount, price)).alias("pnl"),
        F.when(counted, trade_invested(side, amount, price)).alias("invested"),
        F.when(counted, trade_won(price)).alias("won"),
    )


def pair_table(cleaned: DataFrame, limit: int | None = None, sizes_from: DataFrame | None = None) -> DataFrame:
    """One row per (trader, market) with all sums the features need, from one pass over the trades.

    ``sizes_from`` may be any table with at least these traders' rows, such as the trades before cleaning: counting
    its keys tells which groups are large without running the cleaning twice.
    """
    trades = cleaned.select(
        "transaction_id", "address", "market_id", "timestamp", "price", "volume",
        is_buy(F.col("side")).alias("buy"),
        *_returns(),
    )
    # Previous price of the trader across markets. This window fixes the shuffle by trader for all that follows.
    keys = (cleaned if sizes_from is None else sizes_from).select("address", "market_id")
    by_trader = ordered(trades, ["address"], ["timestamp", "transaction_id"], limit, sizes_from=keys)
    lagged = by_trader.previous(F.col("price"), "prev").df
    # Running profit of the trader within the market, and its running peak.
    gained = F.coalesce("pnl", F.lit(0.0))
    # A pair has no more rows than its trader: with no large trader there is no large pair to look for.
    pair_keys = keys if by_trader.runs is not None else None
    by_pair = ordered(
        lagged, ["address", "market_id"], ["timestamp", "transaction_id"], limit,
        sizes_from=pair_keys, all_fit=pair_keys is None,
    )
    path = by_pair.running("sum", gained, "cum").running("max", F.col("cum"), "peak").df
    step = F.try_divide("price", "prev") - 1.0
    gain, loss = F.col("pnl") > 0, F.col("pnl") < 0
    pairs = path.withColumn("step", step).groupBy("address", "market_id").agg(
        F.count("*").alias("n"),
        F.sum("volume").alias("volume"),
        F.count_if("buy").alias("n_buy"),
        F.min("timestamp").alias("first_ts"),
        F.max("timestamp").alias("last_ts"),
        F.avg(seconds(F.col("timestamp")) - _ORIGIN).alias("mean_at"),
        # Price steps. A step from zero to a price is infinite and makes the trader's ratio undefined.
        F.count("step").alias("n_step"),
        F.sum("step").alias("sum_step"),
        F.var_pop("step").alias("var_step"),
        F.min("step").alias("min_step"),
        F.max("step").alias("max_step"),
        F.count_if((F.col("prev") == 0) & (F.col("price") > 0)).alias("n_infinite"),
        # Returns by the price rule.
        F.count("pnl").alias("n_valid"),
        F.count_if("won").alias("n_win"),
        F.sum("pnl").alias("pnl"),
        F.sum("invested").alias("invested"),
        F.count_if(gain).alias("n_gain"),
        F.sum(F.when(gain, F.col("pnl"))).alias("sum_gain"),
        F.count_if(loss).alias("n_loss"),
        F.sum(F.when(loss, -F.col("pnl"))).alias("sum_loss"),
        # The path inside the market: highest and lowest point, deepest fall.
        F.max("cum").alias("path_max"),
        F.min("cum").alias("path_min"),
        F.min(F.col("cum") - F.col("peak")).alias("path_fall"),
    )
    return materialise(pairs, "pairs")


def return_features(pairs: DataFrame, resolutions: DataFrame, limit: int | None = None) -> DataFrame:
    """Return on investment, deepest fall, win rate and gain/loss ratio over resolved markets.

    The profit path runs through a trader's markets in market order. Each market's path is already folded to three
    numbers, so the fall across markets needs only what the earlier markets add up to.
    """
    resolved = resolutions.where(is_resolved_raw(F.col("resolution"))).select("market_id").distinct()
    counted = pairs.join(resolved, "market_id", "left_semi").where("n_valid > 0")
    # The pair table is written, so its row count comes from file footers.
    small = pairs.count() <= (limit or rows_per_task(pairs.sparkSession))
    along = ordered(counted, ["address"], ["market_id"], limit, all_fit=small)
    along = along.running("sum", F.col("pnl"), "total")
    before = F.col("total") - F.col("pnl")
    along = along.running("max", before + F.col("path_max"), "top_incl").previous(F.col("top_incl"), "top_before")
    peak_before = F.greatest(F.coalesce("top_before", F.lit(0.0)), F.lit(0.0))
    fall = F.least(F.col("path_fall"), before + F.col("path_min") - peak_before)
    sums = along.df.withColumn("fall", fall).groupBy("address").agg(
        *[F.sum(c).alias(c) for c in ("pnl", "invested", "n_win", "n_valid", "n_gain", "sum_gain", "n_loss", "sum_loss")],
        F.min("fall").alias("fall"),
    )
    base = F.when(F.col("invested") > 0, F.col("invested")).otherwise(1.0)
    mean_loss = F.when(F.col("n_loss") > 0, F.col("sum_loss") / F.col("n_loss")).otherwise(1e-6)
    ratio = safe_div(F.col("sum_gain"), F.col("n_gain")) / (mean_loss + 1e-6)
    return sums.select(
        "address",
        F.when(F.col("invested") > 0, F.col("pnl") / F.col("invested")).otherwise(0.0).alias("total_roi"),
        F.least(F.col("fall") / base, F.lit(0.0)).alias("max_drawdown"),
        safe_div(F.col("n_win"), F.col("n_valid")).alias("win_rate"),
        F.least(ratio, F.lit(10.0)).alias("profit_loss_ratio"),
        F.col("pnl").alias("total_pnl"),
    )


def _with_markets(pairs: DataFrame) -> DataFrame:
    markets = pairs.groupBy("market_id").agg(
        F.min("first_ts").alias("m_start"),
        F.max("last_ts").alias("m_end"),
        (F.sum("n_buy") / F.sum("n")).alias("m_buy"),
    )
    return pairs.join(markets, "market_id")


def behaviour_sums(pairs: DataFrame):
    """Aggregates for entry time, contrarian bets, price steps, activity and volume over pairs with market columns."""
    length = F.greatest(seconds(F.col("m_end")) - seconds(F.col("m_start")), F.lit(1.0))
    entry = (F.col("mean_at") - (seconds(F.col("m_start")) - _ORIGIN)) / length
    against = F.col("n_buy") * (1.0 - F.col("m_buy")) + (F.col("n") - F.col("n_buy")) * F.col("m_buy")
    return [
        F.sum("n").alias("n"),
        F.count("*").alias("markets"),
        (F.sum(F.col("n") * entry) / F.sum("n")).alias("entry"),
        (F.sum(against) / F.sum("n")).alias("against"),
        F.min("first_ts").alias("first_ts"),
        F.max("last_ts").alias("last_ts"),
        F.sum("volume").alias("volume"),
        F.sum("n_step").alias("n_step"),
        F.sum("sum_step").alias("sum_step"),
        F.min("min_step").alias("min_step"),
        F.max("max_step").alias("max_step"),
        F.sum("n_infinite").alias("n_infinite"),
    ]


def step_squares(pairs: DataFrame) -> DataFrame:
    """``address, sq_step``: squared deviations of a trader's price steps from their mean, merged from those within the
    markets and of the markets' means. Differences of large sums would lose the digits of nearly equal steps."""
    some = pairs.where("n_step > 0").select("address", "n_step", "var_step", (F.col("sum_step") / F.col("n_step")).alias("_own"))
    means = some.groupBy("address").agg((F.sum(F.col("n_step") * F.col("_own")) / F.sum("n_step")).alias("_mean"))
    gap = F.col("_own") - F.col("_mean")
    return some.join(means, "address").groupBy("address").agg(F.sum(F.col("n_step") * (F.col("var_step") + gap * gap)).alias("sq_step"))


def information_ratio():
    """Mean over deviation of the steps. Undefined (NULL) with fewer than two steps or an infinite one, and 0 where
    all steps are equal."""
    n, total = F.col("n_step"), F.col("sum_step")
    mean = F.try_divide(total, n)
    variance = F.try_divide(F.col("sq_step"), n - 1)
    return (
        F.when(F.col("n") < 2, 0.0)
        .when((n < 2) | (F.col("n_infinite") > 0), None)
        .when(F.col("min_step") == F.col("max_step"), 0.0)
        .otherwise(F.try_divide(mean, F.sqrt(variance)))
    )


def behaviour_features(pairs: DataFrame) -> DataFrame:
    """Entry, contrarian, information, activity and volume features, one aggregate over the pairs."""
    per_trader = _with_markets(pairs).groupBy("address").agg(*behaviour_sums(pairs))
    per_trader = per_trader.join(step_squares(pairs), "address", "left")
    total = pairs.agg(F.sum("volume").alias("all_volume"))
    span = (seconds(F.col("last_ts")) - seconds(F.col("first_ts"))) / _DAY
    several = F.col("n") >= 2
    return cross_scalar(per_trader, total).select(
        "address",
        (1.0 - F.col("entry")).alias("early_entry_score"),
        F.col("against").alias("contrarian_score"),
        information_ratio().alias("information_ratio"),
        (F.col("markets") / F.col("n")).alias("cross_market_diversification"),
        F.when(several, span / (F.col("n") - 1)).otherwise(0.0).alias("avg_holding_period"),
        F.when(several, F.col("n") / F.greatest(span, F.lit(1.0 / 24))).otherwise(0.0).alias("trading_frequency"),
        F.when(F.col("all_volume") > 0, F.col("volume") / F.col("all_volume")).otherwise(0.0).alias(
            "capital_flow_centrality"
        ),
    )


def raw_features(pairs: DataFrame, resolutions: DataFrame, limit: int | None = None) -> DataFrame:
    """All features before clipping. Traders without a counted trade have zero returns."""
    returns = return_features(pairs, resolutions, limit)
    joined = behaviour_features(pairs).join(returns, "address", "left")
    zero = [F.coalesce(c, F.lit(0.0)).alias(c) for c in schemas.FEATURES[:4]]
    return joined.select("address", *zero, *schemas.FEATURES[4:])


def quantile_clip(
    df: DataFrame, cols: list[str], lo: float = 0.01, hi: float = 0.99, limit: int | None = None, approx: bool = False
) -> DataFrame:
    """Bound each column by two of its own quantiles."""
    bounds = percentiles(df, cols, [lo, hi], limit=limit, approx=approx).select(*[F.col(c).alias(f"_q_{c}") for c in cols])
    bounded = {c: clip(F.col(c), F.col(f"_q_{c}")[0], F.col(f"_q_{c}")[1]) for c in cols}
    return cross_scalar(df, bounds).withColumns(bounded).select(*df.columns)


def risk_adjusted_return(roi, drawdown):
    fall = F.abs(drawdown)
    return clip(roi / F.when(fall < 1e-4, 1e-4).otherwise(fall), F.lit(-100.0), F.lit(100.0))


def finish_features(raw: DataFrame, limit: int | None = None) -> DataFrame:
    """Clip the tails, add the risk-adjusted return, and only then fill what is undefined with 0."""
    clipped = quantile_clip(raw, schemas.CLIPPED_FEATURES, limit=limit)
    ratio = risk_adjusted_return(F.col("total_roi"), F.col("max_drawdown"))
    return clipped.withColumn("Risk_Adjusted_Return", ratio).na.fill(0.0)


def build_features(
    cleaned: DataFrame,
    resolutions: DataFrame,
    as_of=None,
    blocks: list[Callable[[DataFrame], DataFrame]] | None = None,
    limit: int | None = None,
    sizes_from: DataFrame | None = None,
) -> DataFrame:
    """The feature matrix: address, the eleven features and the risk-adjusted return.

    ``as_of`` (a timestamp) leaves out later trades. ``blocks`` are user functions from the cleaned trades to further
    per-trader columns (see :func:`with_feature_block`). ``sizes_from`` is explained at :func:`pair_table`.
    """
    if as_of is not None:
        cleaned = cleaned.where(F.col("timestamp") < F.lit(as_of).cast("timestamp"))
    raw = materialise(raw_features(pair_table(cleaned, limit, sizes_from), resolutions, limit), "features")
    features = finish_features(raw, limit)
    for block in blocks or []:
        features = with_feature_block(features, cleaned, block)
    return features


def with_feature_block(features: DataFrame, cleaned: DataFrame, block: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Add a user's per-trader columns: ``block`` maps the cleaned trades to a table with an ``address`` column."""
    return outer_blocks([features, block(cleaned)])


def with_trader_function(
    features: DataFrame, cleaned: DataFrame, columns: list[str], schema: str,
    function: Callable[[Iterator[pa.RecordBatch]], dict], order: list[str] | None = None,
) -> DataFrame:
    """Add columns by a function over one trader's rows that no DataFrame function can say.

    ``function`` gets the trader's rows in order, batch by batch, with ``columns`` and the order columns, and returns one
    value for each column of ``schema``. Rows are sorted by Spark and stream through: a trader of any size is never held
    whole, by a task or by the function unless it keeps them. The function need not read all its batches.
    """
    order = order or ["timestamp", "transaction_id"]
    names = list(dict.fromkeys([*columns, *order]))
    rows = cleaned.select("address", *names).where("address is not null").repartition("address").sortWithinPartitions("address", *order)
    out = T.StructType([rows.schema["address"], *cleaned.sparkSession.createDataFrame([], schema).schema.fields])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, pa.RecordBatch]]:
        for batch in batches:
            if batch.num_rows:
                codes = batch.column(0).dictionary_encode().indices.to_numpy()
                edges = [0, *(np.flatnonzero(codes[1:] != codes[:-1]) + 1).tolist(), len(codes)]
                for a, b in zip(edges, edges[1:]):
                    yield batch.column(0)[a].as_py(), batch.slice(a, b - a).select(names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for trader, group in groupby(pieces(batches), key=lambda piece: piece[0]):
            row = {"address": trader, **function(batch for _, batch in group)}
            yield pa.RecordBatch.from_pylist([row], schema=to_arrow_schema(out))

    return with_feature_block(features, cleaned, lambda _: rows.mapInArrow(work, out))


def drawdown_by_time(cleaned: DataFrame, resolutions: DataFrame, limit: int | None = None) -> DataFrame:
    """The deepest fall of each trader's profit along time, across markets, over the capital invested."""
    resolved = resolutions.where(is_resolved_raw(F.col("resolution"))).select("market_id").distinct()
    trades = cleaned.join(resolved, "market_id", "left_semi").select(
        "address", "timestamp", "transaction_id", *_returns()
    ).where("pnl is not null")
    path = ordered(trades, ["address"], ["timestamp", "transaction_id"], limit)
    path = path.running("sum", F.col("pnl"), "cum").running("max", F.greatest(F.col("cum"), F.lit(0.0)), "peak").df
    folded = path.groupBy("address").agg(
        F.min(F.col("cum") - F.col("peak")).alias("fall"), F.sum("invested").alias("invested")
    )
    base = F.when(F.col("invested") > 0, F.col("invested")).otherwise(1.0)
    return folded.select("address", F.least(F.col("fall") / base, F.lit(0.0)).alias("max_drawdown"))


def early_entry_pct(trades: DataFrame, limit: int | None = None) -> DataFrame:
    """Each trade's place in its market's order of time, from 0 for the first to 1 for the last.

    Trades at one time share the lowest place, as ``percent_rank`` has it.
    """
    places = ordered(trades, ["market_id"], ["timestamp", "transaction_id"], limit)
    places = places.running("sum", F.lit(1), "_rn").previous(F.col("timestamp"), "_prev")
    is_new = F.col("_prev").isNull() | (F.col("_prev") != F.col("timestamp"))
    places = places.running("max", F.when(is_new, F.col("_rn") - 1), "_earlier").df
    sizes = trades.groupBy("market_id").agg(F.count("*").alias("_n"))
    share = safe_div(F.col("_earlier"), F.col("_n") - 1)
    return places.join(sizes, "market_id").withColumn("early_entry_pct", share).drop("_rn", "_prev", "_earlier", "_n")
