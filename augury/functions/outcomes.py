"""Readings of outcome and resolution texts. Three rules exist side by side because their users differ."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Texts that name the positive and the negative side.
YES_TEXTS = ["yes", "up", "true", "1", "higher", "over", "win"]
NO_TEXTS = ["no", "down", "false", "0", "lower", "under", "lose"]
# The shorter lists of the strict reading.
STRICT_YES_TEXTS = ["yes", "1", "true", "up"]
STRICT_NO_TEXTS = ["no", "0", "false", "down"]
# Fixed value: the mark of a market that has not closed.
OPEN_MARK = "__OPEN__"

_NUMBER = r"^[+-]?([0-9][0-9_]*\.?[0-9_]*|\.[0-9][0-9_]*)(e[+-]?[0-9]+)?$"


def normalise_outcome(raw: Column) -> Column:
    """YES / NO / OPEN / UNKNOWN. NULL and empty are OPEN; a number above one half is YES."""
    text = F.lower(F.regexp_replace(raw, r"^\s+|\s+$", ""))
    # The pattern keeps out texts such as '1.0d' that a SQL cast would accept.
    number = F.when(text.rlike(_NUMBER), F.regexp_replace(text, "_", "").try_cast("double"))
    return (
        F.when(raw.isNull() | raw.isin("", OPEN_MARK, "nan"), "OPEN")
        .when(text.isin(*YES_TEXTS), "YES")
        .when(text.isin(*NO_TEXTS), "NO")
        .when(text.rlike(r"^\+?inf(inity)?$"), "YES")
        .when(text.rlike(r"^(-inf(inity)?|[+-]?nan)$"), "NO")
        .when(number > 0.5, "YES")
        .when(number.isNotNull(), "NO")
        .otherwise("UNKNOWN")
    )


def normalise_resolution_strict(raw: Column) -> Column:
    """YES / NO / OPEN by the short lists only: no trimming, no numbers."""
    text = F.lower(raw)
    return (
        F.when(text.isin(*STRICT_YES_TEXTS), "YES").when(text.isin(*STRICT_NO_TEXTS), "NO").otherwise("OPEN")
    )


def is_resolved_raw(raw: Column) -> Column:
    """Any text but the open mark counts as resolved."""
    return F.coalesce((raw != "") & (raw != OPEN_MARK), F.lit(False))


def is_buy(side: Column) -> Column:
    """Anything that is not BUY, NULL included, is treated as a sale."""
    return F.coalesce(F.upper(side) == "BUY", F.lit(False))


def predicted_outcome(side: Column, outcome: Column, price: Column, side_aware: bool = False) -> Column:
    """What the trade bets on: its outcome text if there is one, else the side of one half its price lies on.

    ``side_aware=True`` also turns the outcome round for sales.
    """
    favourite = is_buy(side) == (price >= 0.5)
    by_price = F.when(favourite, "YES").otherwise("NO")
    by_text = normalise_outcome(outcome)
    if side_aware:
        flipped = F.when(by_text == "YES", "NO").when(by_text == "NO", "YES").otherwise(by_text)
        by_text = F.when(is_buy(side), by_text).otherwise(flipped)
    return F.when(outcome.isNotNull(), by_text).otherwise(by_price)


def expert_bet(price: Column) -> Column:
    return F.when(price >= 0.5, "YES").otherwise("NO")
