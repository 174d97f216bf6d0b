"""Per-trade arithmetic and calendar parts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from augury.functions.outcomes import is_buy

# Report intervals and the label format of each.
PERIOD_FORMATS = {"hour": "yyyy-MM-dd HH:00:00", "day": "yyyy-MM-dd", "month": "yyyy-MM"}


def counts_for_returns(size: Column, price: Column) -> Column:
    return (size > 0) & (price > 0)


def trade_invested(side: Column, size: Column, price: Column) -> Column:
    return F.when(is_buy(side), size * price).otherwise(size * (1.0 - price))


def trade_pnl(side: Column, size: Column, price: Column) -> Column:
    """Profit by the price rule: buying the favourite wins the rest to one, buying the outsider loses the stake,
    selling earns the proceeds."""
    return (
        F.when(~is_buy(side), size * price)
        .when(price >= 0.5, size * (1.0 - price))
        .otherwise(-(size * price))
    )


def trade_won(price: Column) -> Column:
    return price >= 0.5


def trade_result(side: Column, size: Column, price: Column) -> Column:
    """struct(pnl, invested, win), NULL for trades that do not count."""
    return F.when(
        counts_for_returns(size, price),
        F.struct(
            trade_pnl(side, size, price).alias("pnl"),
            trade_invested(side, size, price).alias("invested"),
            trade_won(price).alias("win"),
        ),
    )


def hour_of_day(ts: Column) -> Column:
    return F.hour(ts)


def day_of_week(ts: Column) -> Column:
    """0 is Monday."""
    return F.weekday(ts)


def _known(interval: str) -> str:
    if interval not in PERIOD_FORMATS:
        raise ValueError(f"interval must be one of {sorted(PERIOD_FORMATS)}, not {interval!r}")
    return interval


def truncate_period(ts: Column, interval: str) -> Column:
    return F.date_trunc(_known(interval), ts)


def period_label(ts: Column, interval: str) -> Column:
    return F.date_format(ts, PERIOD_FORMATS[_known(interval)])


def copy_order_size(amount: Column, fraction: float = 0.05, cap: float = 500.0) -> Column:
    return F.least(amount * fraction, F.lit(cap))


def normalize_address(address: Column) -> Column:
    return F.lower(address)


def seconds(ts: Column) -> Column:
    """Epoch seconds with the fraction, as double."""
    return ts.cast("double")
