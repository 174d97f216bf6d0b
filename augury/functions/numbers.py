"""Null-safe arithmetic, rounding and number classes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def clip(x: Column, lo: Column, hi: Column) -> Column:
    """Bound ``x``; NULL stays NULL (``greatest``/``least`` would return the bound)."""
    return F.when(x < lo, lo).when(x > hi, hi).otherwise(x)


def safe_div(a: Column, b: Column, default: float | None = 0.0) -> Column:
    """``a / b``, or ``default`` where the quotient is undefined."""
    ratio = F.try_divide(a.cast("double"), b.cast("double"))
    return ratio if default is None else F.coalesce(ratio, F.lit(default))


def round_money(x: Column, digits: int = 2) -> Column:
    """Round half away from zero after dropping float noise.

    Sums of doubles differ in the last bits with the order of partitions; the inner rounding makes the result
    independent of it.
    """
    return F.round(F.round(x, 6), digits)


def round_even(x: Column, digits: int = 4) -> Column:
    """Round half to even."""
    return F.bround(x, digits)


def significance_stars(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("ns")


def volume_tier(n: Column) -> Column:
    """Size class of a data set by its trade count."""
    return F.when(n >= 10_000, "full").when(n >= 100, "partial").otherwise("insufficient")


def hash_draw(key: Column, salt: str = "") -> Column:
    """A repeatable number in [0, 1) per key: unlike ``rand``, equal after any retry or repartitioning."""
    digest = F.md5(F.concat(F.lit(salt), key.cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(float(2**32))
