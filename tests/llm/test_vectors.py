"""Grid order join and nearest neighbours against brute force."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from augury.llm import ann, egojoin

SCHEMA = "vec_id long, embedding array<float>, label int"


def clustered(n=600, d=16, seed=1):
    """Clusters around the threshold, copies, and vectors that can't be compared."""
    draw = np.random.default_rng(seed)
    centres = draw.standard_normal((25, d))
    x = (centres[draw.integers(0, 25, n)] + draw.standard_normal((n, d)) * draw.uniform(0.02, 0.4, (n, 1))).astype(np.float32)
    rows = [(int(i), [float(v) for v in x[i]], 0) for i in range(n)]
    rows += [(n + i, rows[3][1], 1) for i in range(40)]  # copies
    rows += [(2000, None, 0), (2001, [], 0), (2002, [0.0] * d, 0), (2003, [1.0] * (d - 1) + [float("nan")], 0)]
    rows += [(2004, [1.0] * (d - 1) + [float("inf")], 0), (2005, [1.0] * (d - 1) + [None], 0), (2006, [1.0] * 3, 0)]
    return rows


def usable(rows, d=16):
    return [(i, np.array(v, float)) for i, v, _ in rows if v is not None and len(v) == d and None not in v and np.isfinite(v).all() and np.any(v)]


@pytest.mark.parametrize("block", [64, 4096])
def test_grid_order_join_finds_all_links(spark, block):
    rows = clustered()
    got = {r["id"]: (r["n_links"], r["component_id"]) for r in egojoin.links(spark.createDataFrame(rows, SCHEMA), block=block).collect()}
    good = usable(rows)
    x = np.stack([v for _, v in good])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    label = np.array([i for i, _ in good])
    while True:
        low = np.where(near, label[None, :], label[:, None]).min(axis=1)
        if (low == label).all():
            break
        label = low
    expected = {i: (0, i) for i, _, _ in rows}
    expected |= {i: (int(near[k].sum()), int(label[k])) for k, (i, _) in enumerate(good)}
    assert sum(n for n, _ in expected.values()) > 1000
    assert got == expected


def test_grid_order_join_ids(spark):
    rows = [(None, [1.0, 0.0], 0), (5, [1.0, 0.0], 0), (5, [1.0, 0.0], 0), (None, [0.0, 1.0], 0), (7, [-1.0, -0.0], 0)]
    got = sorted(map(tuple, egojoin.links(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert got == sorted([(None, 2, 5), (5, 2, 5), (5, 2, 5), (None, 0, None), (7, 0, 7)], key=str)


def test_grid_order_join_of_nothing(spark):
    assert egojoin.links(spark.createDataFrame([], SCHEMA)).count() == 0
    assert egojoin.links(spark.createDataFrame([(1, None, 0)], SCHEMA)).collect()[0]["n_links"] == 0


def test_neighbours_have_the_asked_recall_and_exact_scores(spark):
    rows = clustered()
    got = {}
    for r in ann.search(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    good = usable(rows)
    found = total = 0
    for i, v in good:
        if i % 20:
            continue
        best = sorted(((-sum(a * b for a, b in zip(v.tolist(), w.tolist())), j) for j, w in good if j != i))[:20]
        assert sorted(got[i]) == list(range(1, 21))
        scores = {j: -s for s, j in best}
        found += sum(got[i][k][0] in scores for k in got[i])
        assert all(abs(scores.get(j, s) - s) < 1e-12 for j, s in got[i].values())
        assert [got[i][k] for k in range(1, 21)] == sorted(got[i].values(), key=lambda x: (-x[1], x[0]))
        total += 20
    assert set(got) == {i for i, _ in good if i % 20 == 0}
    assert found / total >= 0.99


def test_neighbours_of_few_vectors(spark):
    rows = [(0, [1.0, 2.0], 0), (1, [1.0, 0.0], 0), (2, [1.0, 0.0], 0), (None, [9.0, 9.0], 0), (20, None, 0)]
    got = [tuple(r) for r in ann.search(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 20 == 0).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 1.0), (0, 2, 2, 1.0)]
    assert ann.search(spark.createDataFrame([], SCHEMA), F.col("vec_id") == 0).count() == 0


def test_other_columns_play_no_part(spark):
    """Columns named like those the operators add change nothing."""
    rows = clustered(120)
    plain = spark.createDataFrame(rows, SCHEMA)
    clash = {c: F.lit("clash") for c in ("id", "vector", "n_links", "component_id", "query_id", "rank", "score", "block", "x", "codes", "q", "deal", "asked", "floor")}
    wide = plain.withColumns(clash)
    key = lambda r: str(tuple(r))
    for run in (lambda df: egojoin.links(df), lambda df: ann.search(df, F.col("vec_id") % 20 == 0)):
        assert sorted(run(wide).collect(), key=key) == sorted(run(plain).collect(), key=key)
