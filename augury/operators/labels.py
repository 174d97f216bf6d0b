"""Splits and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from augury import schemas
from augury.functions.numbers import round_even
from augury.functions.outcomes import normalise_outcome, predicted_outcome
from augury.operators.joins import cross_scalar, with_first_trade
from augury.operators.ordered import null_safe_join, ordered
from augury.operators.quantiles import percent_ranks, percentiles
from augury.session import materialise

RANKED = {"total_roi": "_r_roi", "win_rate": "_r_win", "profit_loss_ratio": "_r_plr"}


def temporal_split(features: DataFrame, cleaned: DataFrame, train: float = 0.7, val: float = 0.15) -> DataFrame:
    """train / val / test by where a trader's first trade falls in the whole time range."""
    at = F.unix_micros("timestamp")
    span = cleaned.agg(F.min(at).alias("_lo"), F.max(at).alias("_hi"))
    first = F.unix_micros("first_trade_date")
    cut = lambda share: F.col("_lo") + F.round((F.col("_hi") - F.col("_lo")) * F.lit(share)).cast("bigint")
    split = F.when(first < cut(train), "train").when(first < cut(train + val), "val").otherwise("test")
    placed = cross_scalar(with_first_trade(features, cleaned), span).withColumn("split", split).drop("_lo", "_hi")
    return placed.withColumn("is_train", F.col("split") == "train")


def resolution_accuracy(trades: DataFrame, resolutions: DataFrame, side_aware: bool = False) -> DataFrame:
    """Per trader: trades in markets resolved YES or NO, and how many of them bet on the result.

    Trades are first counted per (trader, market, bet), so the lookup of resolutions meets the small table and a
    busy market or trader is merged before any shuffle.
    """
    outcome = F.col("outcome") if "outcome" in trades.columns else F.lit(None).cast("string")
    bet = predicted_outcome(F.col("side"), outcome, F.col("price"), side_aware)
    bets = trades.groupBy("address", "market_id").agg(
        F.count("*").alias("n"),
        F.count_if(bet == "YES").alias("yes"),
        F.count_if(bet == "NO").alias("no"),
    )
    results = resolutions.select("market_id", normalise_outcome(F.col("resolution")).alias("result"))
    known = bets.join(results, "market_id", "left").withColumn("known", F.col("result").isin("YES", "NO"))
    counts = known.groupBy("address").agg(
        F.sum(F.when(F.col("known"), F.col("n")).otherwise(0)).alias("n_resolved"),
        F.sum(F.when(F.col("result") == "YES", F.col("yes")).when(F.col("result") == "NO", F.col("no")).otherwise(0)).alias(
            "n_correct"
        ),
    )
    share = F.when(F.col("n_resolved") > 0, F.col("n_correct") / F.col("n_resolved")).otherwise(0.0)
    return counts.withColumn("_share", share).withColumn("accuracy", round_even(F.col("_share"), 4))


def resolution_labels(
    trades: DataFrame,
    resolutions: DataFrame,
    min_resolved_trades: int = 3,
    accuracy_threshold: float = 0.60,
    side_aware: bool = False,
) -> DataFrame:
    """1 / 0 for enough resolved trades, -1 for too few, 0 for none. The threshold meets the unrounded accuracy."""
    enough = F.col("n_resolved") >= min_resolved_trades
    label = (
        F.when(enough, F.when(F.col("_share") >= accuracy_threshold, 1).otherwise(0))
        .when(F.col("n_resolved") > 0, -1)
        .otherwise(0)
    )
    source = (
        F.when(enough, "resolution")
        .when(F.col("n_resolved") > 0, "resolution_insufficient")
        .otherwise("no_resolved_data")
    )
    rated = resolution_accuracy(trades, resolutions, side_aware)
    return rated.select(
        "address", "n_resolved", "n_correct", "accuracy",
        label.alias(schemas.LABEL), source.alias("label_source"),
    )


def apply_resolution_labels(features: DataFrame, labels: DataFrame) -> DataFrame:
    """Left join of the labels; traders marked -1 go, traders without a label stay."""
    joined = features.join(labels, "address", "left")
    return joined.where(F.coalesce(F.col(schemas.LABEL), F.lit(0)) != -1)


def composite_labels(split: DataFrame, top: float = 0.2, limit: int | None = None) -> DataFrame:
    """Label the top share of each split by the mean of three percent ranks; inactive traders get 0.

    A trader with a missing value counts as active, has no rank there and so no score, and gets 0. A NULL split is a split.
    """
    differs = lambda c: F.coalesce(F.col(c) != 0, F.lit(True))
    is_active = differs("total_roi") | differs("win_rate") | differs("profit_loss_ratio")
    active = percent_ranks(split.where(is_active), RANKED, ["split"], limit)
    total = sum((F.col(c) for c in list(RANKED.values())[1:]), F.col(list(RANKED.values())[0]))
    scored = materialise(active.withColumn("composite_score", total / 3.0).drop(*RANKED.values()), "scored")
    bars = percentiles(scored, ["composite_score"], [1 - top], ["split"], limit).select(
        "split", F.col("composite_score")[0].alias("_bar")
    )
    # One row per split: joined by shuffle, a split would be one task.
    marked = null_safe_join(scored, F.broadcast(bars), ["split"], "left").select(
        *split.columns,
        F.coalesce((F.col("composite_score") >= F.col("_bar")).cast("int"), F.lit(0)).alias(schemas.LABEL),
        "composite_score",
        F.lit("composite_rank").alias("label_source"),
    )
    rest = split.where(~is_active).select(
        *split.columns,
        F.lit(0).alias(schemas.LABEL),
        F.lit(0.0).alias("composite_score"),
        F.lit("composite_inactive").alias("label_source"),
    )
    return marked.unionByName(rest)


def label_traders(
    split: DataFrame,
    trades: DataFrame,
    resolutions: DataFrame,
    mode: str = "auto",
    min_resolved_trades: int = 3,
    accuracy_threshold: float = 0.60,
    top: float = 0.2,
    min_coverage: float = 0.10,
    limit: int | None = None,
) -> DataFrame:
    """Labels from resolved markets; ``auto`` takes composite labels where those cover too few traders."""
    if mode not in ("auto", "resolution", "composite"):
        raise ValueError(f"mode must be auto, resolution or composite, not {mode!r}")
    split = materialise(split, "split")
    if mode != "composite":
        labels = resolution_labels(trades, resolutions, min_resolved_trades, accuracy_threshold)
        labeled = apply_resolution_labels(split, labels)
        if mode == "auto":
            labeled = materialise(labeled, "labels")
            seen = labeled.agg(F.count("*").alias("n"), F.count_if(F.col("label_source") == "resolution").alias("k")).first()
        if mode == "resolution" or (seen["n"] and seen["k"] / seen["n"] >= min_coverage):
            return _filled(labeled)
    return _filled(composite_labels(split, top, limit))


def _filled(df: DataFrame) -> DataFrame:
    return df.withColumn(schemas.LABEL, F.coalesce(F.col(schemas.LABEL), F.lit(0)))


def rar_labels(df: DataFrame, quantile: float = 0.8, limit: int | None = None) -> DataFrame:
    """1 where the risk-adjusted return reaches the quantile of the training rows."""
    bar = percentiles(df.where("is_train"), ["Risk_Adjusted_Return"], [quantile], limit=limit)
    bar = bar.select(F.col("Risk_Adjusted_Return")[0].alias("_bar"))
    marked = cross_scalar(df, bar)
    return marked.withColumn(schemas.LABEL, (F.col("Risk_Adjusted_Return") >= F.col("_bar")).cast("int")).drop("_bar")


def numbered(df: DataFrame, order: list[str], out: str = "rn", limit: int | None = None) -> DataFrame:
    """Number all rows from 1 along ``order``, whatever their number."""
    return ordered(df, [], order, limit).running("sum", F.lit(1), out).df


def legacy_split(df: DataFrame, order: list[str] | None = None, share: float = 0.8, limit: int | None = None) -> DataFrame:
    """For tables with ``is_train`` only: the last fifth of the training rows becomes the validation split."""
    order = order or ["first_trade_date", "address"]
    train = numbered(df.where("is_train"), order, "_rn", limit)
    size = df.agg(F.floor(F.count_if("is_train") * F.lit(share)).alias("_cut"))
    split = F.when(F.col("_rn") <= F.col("_cut"), "train").otherwise("val")
    placed = cross_scalar(train, size).withColumn("split", split).drop("_rn", "_cut")
    rest = df.where(~F.coalesce(F.col("is_train"), F.lit(False)))
    return placed.unionByName(rest.withColumn("split", F.lit("test")))


def split_summary(labeled: DataFrame) -> DataFrame:
    """Traders and informed traders per split and label source, with subtotals (NULL marks a subtotal)."""
    return labeled.rollup("split", "label_source").agg(
        F.count("*").alias("traders"),
        F.sum(F.col(schemas.LABEL).cast("bigint")).alias("informed"),
        F.avg(schemas.LABEL).alias("informed_rate"),
    )


def volume_quintiles(trades: DataFrame, labels: DataFrame, limit: int | None = None) -> DataFrame:
    """Traders, volume, accuracy and share of informed traders per fifth of the traders by volume."""
    totals = materialise(trades.groupBy("address").agg(F.sum("volume").alias("volume")), "totals")
    placed = numbered(totals, ["volume", "address"], "_rn", limit)
    placed = cross_scalar(placed, totals.agg(F.count("*").alias("_n")))
    # As ntile(5): the first (n mod 5) fifths have one row more.
    small, extra = F.floor(F.col("_n") / 5), F.col("_n") % 5
    in_large = F.ceil(F.col("_rn") / (small + 1))
    in_small = extra + F.ceil((F.col("_rn") - extra * (small + 1)) / F.greatest(small, F.lit(1)))
    fifth = F.when(F.col("_rn") <= extra * (small + 1), in_large).otherwise(in_small).cast("int")
    joined = placed.withColumn("quintile", fifth).join(
        labels.select("address", "accuracy", schemas.LABEL), "address", "left"
    )
    return joined.groupBy("quintile").agg(
        F.count("*").alias("traders"),
        F.sum("volume").alias("volume"),
        F.avg("accuracy").alias("mean_accuracy"),
        F.avg((F.coalesce(F.col(schemas.LABEL), F.lit(0)) == 1).cast("double")).alias("informed_rate"),
    )
