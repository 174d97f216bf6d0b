from __future__ import annotations

import tempfile

import pytest

from augury import schemas
from augury.session import build_session

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        "local[8]",
        {
            "spark.sql.shuffle.partitions": "8",
            "spark.driver.memory": "6g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.checkpoint.dir": tempfile.mkdtemp(prefix="spark-", dir="/tmp"),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def make_trades(spark):
    """Trades from short rows (id, address, market, side, amount, price, time)."""

    def make(rows, outcomes=None):
        text = [(r[0], r[1], r[2], r[3], (outcomes or {}).get(r[0]), r[4], r[5], r[6]) for r in rows]
        return _timed(spark.createDataFrame(text, schemas.TRADES_CSV))

    return make


def _timed(df):
    from augury.sources.tables import normalize_timestamp

    return normalize_timestamp(df)


@pytest.fixture
def make_resolutions(spark):
    def make(pairs):
        return spark.createDataFrame([(m, None, r, None) for m, r in pairs.items()], schemas.RESOLUTIONS)

    return make


@pytest.fixture
def small():
    return SMALL


def rows_of(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def same_rows(a, b, digits=9):
    """Equal as multisets, doubles compared after rounding."""

    def key(r):
        return tuple("~" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v) for v in r)

    columns = sorted(a.columns)
    assert columns == sorted(b.columns)
    x = sorted(key(r) for r in a.select(*columns).collect())
    y = sorted(key(r) for r in b.select(*columns).collect())
    assert x == y
