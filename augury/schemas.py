"""Explicit schemas: nothing in this library infers column types from data."""

from __future__ import annotations

from pyspark.sql import types as T


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


STR, DBL, LONG, INT, BOOL, TS = (
    T.StringType(), T.DoubleType(), T.LongType(), T.IntegerType(), T.BooleanType(), T.TimestampType(),
)

TRADES = _schema(
    transaction_id=STR, address=STR, market_id=STR, side=STR, outcome=STR, amount=DBL, price=DBL, timestamp=TS
)
# Trades as text files carry them: the time is parsed by the reader so that bad values become NULL.
TRADES_CSV = _schema(
    transaction_id=STR, address=STR, market_id=STR, side=STR, outcome=STR, amount=DBL, price=DBL, timestamp=STR
)
RESOLUTIONS = _schema(market_id=STR, question=STR, resolution=STR, slug=STR)
POSITIONS = _schema(address=STR, market_id=STR, token_balance=DBL, avg_price=DBL, last_updated=TS)
MARKETS = _schema(market_id=STR, question=STR, resolved=BOOL, resolution_outcome=STR)
PREDICTIONS = _schema(address=STR, predicted_label=INT, predicted_probability=DBL, actual_label=INT)
EQUITY = _schema(timestamp=TS, cash=DBL, positions_value=DBL, total_equity=DBL)

# One trade object of the public feed. Numbers are read as text, because the feed also sends quoted numbers.
FEED_TRADE = _schema(
    transactionHash=STR, proxyWallet=STR, conditionId=STR, side=STR, size=STR, price=STR, timestamp=STR,
    outcome=STR, _outcome=STR, title=STR, slug=STR, eventSlug=STR,
)
# One market object; the array fields hold JSON text.
FEED_MARKET = _schema(
    conditionId=STR, question=STR, slug=STR, outcomes=STR, outcomePrices=STR, closed=BOOL, active=BOOL,
    clobTokenIds=STR, volume=DBL,
)
FILLS = _schema(market=STR, maker_address=STR, taker_address=STR)

# The model inputs, in the order models and exports use.
FEATURES = [
    "total_roi", "max_drawdown", "win_rate", "profit_loss_ratio",
    "early_entry_score", "contrarian_score", "information_ratio",
    "cross_market_diversification", "avg_holding_period", "trading_frequency",
    "capital_flow_centrality",
]
# The features whose tails are clipped.
CLIPPED_FEATURES = [
    "total_roi", "max_drawdown", "win_rate", "profit_loss_ratio", "information_ratio",
    "trading_frequency", "avg_holding_period", "capital_flow_centrality",
]
LABEL = "Trader_Success_Rate"
