"""As-of lookup: the last known value at or before a time."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from augury.operators.ordered import ordered


def asof_join(
    probes: DataFrame,
    ticks: DataFrame,
    by: str = "market_id",
    probe_time: str = "at",
    tick_time: str = "timestamp",
    value: str = "price",
    tie: str = "transaction_id",
    out: str = "asof_price",
    default: str | None = None,
    limit: int | None = None,
    sizes_from: DataFrame | None = None,
) -> DataFrame:
    """Add to each probe the latest tick value of its group at or before its time, that time included.

    Of several ticks at one time the last by ``tie`` counts. Probes without a tick get the column ``default``.
    Probes and ticks are read in one shuffle and one sort; groups too large for a task are scanned in runs.
    ``sizes_from``: a cheaper table with column ``by`` and at least as many rows per group as probes and ticks have,
    so that finding the large groups doesn't compute the inputs first.
    """
    columns = probes.columns
    probe_rows = probes.select(
        F.col(by).alias("_by"),
        F.col(probe_time).alias("_at"),
        F.lit(1).alias("_kind"),
        F.col(tie).alias("_tie"),
        F.lit(None).cast(ticks.schema[value].dataType).alias("_value"),
        *[F.col(c).alias(f"_p_{c}") for c in columns if c != by],
    )
    tick_rows = ticks.select(
        F.col(by).alias("_by"),
        F.col(tick_time).alias("_at"),
        F.lit(0).alias("_kind"),
        F.col(tie).alias("_tie"),
        F.col(value).alias("_value"),
        *[F.lit(None).cast(f.dataType).alias(f"_p_{f.name}") for f in probes.schema if f.name != by],
    )
    sizes = None if sizes_from is None else sizes_from.select(F.col(by).alias("_by"))
    rows = ordered(tick_rows.unionByName(probe_rows), ["_by"], ["_at", "_kind", "_tie"], limit, sizes)
    found = rows.running("last", F.col("_value"), "_found").df.where(F.col("_kind") == 1)
    result = F.col("_found") if default is None else F.coalesce("_found", f"_p_{default}")
    # The group column is taken from the shuffle key, so a grouping on it right after needs no further shuffle.
    carried = [F.col("_by" if c == by else f"_p_{c}").alias(c) for c in columns]
    return found.select(*carried, result.alias(out))
