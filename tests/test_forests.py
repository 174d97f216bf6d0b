"""Forests grown together: the same trees at every limit, brute-force trees, shared runs, and searches by join."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from augury.ml import forests, models
from augury.operators.metrics import rank_metrics
from augury.plans import training
from tests.test_additive_models import COLS, probabilities, rows  # noqa: F401

POINTS = [
    {"n_estimators": 4, "max_depth": 3, "min_samples_leaf": 2, "max_features": "sqrt"},
    {"n_estimators": 9, "max_depth": None, "min_samples_leaf": 2, "max_features": "log2"},
    {"n_estimators": 30, "max_depth": 5, "min_samples_leaf": 1, "max_features": None},
]


def brute(bins, label, weight, tree, run, heap=1):
    """One node after the other, in plain loops."""
    c = [int(weight[label == k].sum()) for k in (0, 1)]
    own = [n * w for n, w in zip(c, run.weights)]
    value = int(np.rint(own[1] / sum(own) * forests.ONE)) if sum(own) else forests.ONE // 2
    if not min(c) or sum(c) < 2 * run.leaf or heap >= 2**run.depth:
        return {heap: (-1, 0, value)}
    best, order = None, forests.feature_order(np.array([heap]), tree, bins.shape[1])[0]
    for place, f in enumerate(order):
        if place >= run.tried and best:
            break
        for cut in range(forests.BINS):
            left = bins[:, f] <= cut
            sides = [[weight[s & (label == k)].sum() for k in (0, 1)] for s in (left, ~left)]
            if min(sum(s) for s in sides) < run.leaf:
                continue
            gain = sum(((s[0] * run.weights[0]) ** 2 + (s[1] * run.weights[1]) ** 2) / (s[0] * run.weights[0] + s[1] * run.weights[1]) for s in sides)
            if best is None or gain > best[0] + 1e-9:
                best = (gain, f, cut)
    if best is None:
        return {heap: (-1, 0, value)}
    _, f, cut = best
    left = bins[:, f] <= cut
    out = {heap: (int(f), int(cut), value)}
    for child, s in ((2 * heap, left), (2 * heap + 1, ~left)):
        out |= brute(bins[s], label[s], weight[s], tree, run, child)
    return out


@pytest.mark.parametrize("nodes", [2, 4096])
@pytest.mark.parametrize("tried", [1, 2, 4])
def test_trees_by_brute_force(monkeypatch, nodes, tried):
    monkeypatch.setattr(forests, "NODES", nodes)
    draw = np.random.default_rng(tried)
    bins = draw.integers(0, 6, (120, 4)).astype(np.uint8)
    bins[:, 3] = 1  # a feature that can't split
    label = (bins[:, 0] + draw.integers(0, 4, 120) > 4).astype(np.int64)
    for leaf, depth in ((1, 30), (3, 4), (1, 1)):
        run = forests.Run((0,), leaf, tried, 5, depth, (0.7, 1.6))
        for tree in range(3):
            weight = forests.row_weights(np.arange(120), tree)
            own = weight > 0
            found = forests.grow(bins[own], label[own], weight[own], tree, run)
            got = {int(h): (int(f), int(c) if f >= 0 else 0, int(v)) for h, f, c, v in zip(*found)}
            assert got == brute(bins[own], label[own], weight[own], tree, run)


def test_row_weights():
    w = np.concatenate([forests.row_weights(np.arange(20_000), t) for t in range(3)])
    assert abs(w.mean() - 1) < 0.02 and abs((w == 0).mean() - np.exp(-1)) < 0.01 and abs(w.var() - 1) < 0.03
    assert not np.array_equal(w[:20_000], w[20_000:40_000])


def test_runs_are_shared():
    tasks = [(p, [0, 1]) for p in POINTS]
    runs, run_of = forests.runs_of(tasks, {(0, 0): 3, (0, 1): 1, (1, 0): 3, (1, 1): 1}, 5)
    assert run_of[0] == run_of[1] != run_of[2] and len(runs) == 2
    shared = runs[run_of[0]]
    assert (shared.trees, shared.depth, shared.tried) == (9, forests.DEEPEST, 2) and shared.weights == (8 / 12, 2.0)
    whole, _ = forests.runs_of([(p, list(range(k))) for k in training.FOLDS for p in models.parameter_sets(models.FOREST_SPACE, 30)], {}, 11)
    assert len(whole) <= 30  # 150 forests


def trees_of(models_):
    return [[(t.feature.tolist(), t.value.tolist(), np.where(t.feature >= 0, t.cut, 0).tolist()) for t in m.trees] for m in models_]


def test_same_trees_whatever_the_limit_and_the_partitions(rows):  # noqa: F811
    tasks = [(p, g) for p in POINTS for g in ([0, 1], [0, 1, 2, 3])]
    whole = forests.fit_forests(rows, "block", COLS, tasks)
    assert [len(m.trees) for m in whole] == [4, 4, 9, 9, 30, 30]
    few, expected = tasks[2:4], trees_of(whole)[2:4]
    assert trees_of(forests.fit_forests(rows.repartition(7), "block", COLS, few, limit=60)) == expected
    # A task's forest is that of a run of its own: fewer trees are the first ones, less depth is the top.
    alone = forests.fit_forests(rows, "block", COLS, [(POINTS[0], [0, 1])])[0]
    assert np.array_equal(probabilities(models.score(alone, rows)), probabilities(models.score(whole[0], rows)))


@pytest.mark.parametrize("limit", [None, 25])
def test_search_scores_are_those_of_the_models(rows, limit):  # noqa: F811
    points = POINTS[:2]
    tasks = [(i, p, list(range(k)), k) for k in (2, 4) for i, p in enumerate(points)]
    found = forests.search_scores(rows, "block", COLS, tasks, limit)
    got = {(k, i): [] for i, _, _, k in tasks}
    for r in found.collect():
        got[r["block"], r["point"]].append((r["label"], r["predicted_probability"]))
    fitted = forests.fit_forests(rows, "block", COLS, [(p, g) for _, p, g, _ in tasks])
    for (i, _, _, k), model in zip(tasks, fitted):
        scored = models.score(model, rows.where(f"block = {k}")).select("label", "predicted_probability").collect()
        assert sorted(got[k, i]) == sorted(map(tuple, scored)) and len(scored) == rows.where(f"block = {k}").count()


def test_as_good_as_the_estimator(rows):  # noqa: F811
    train, params = rows.where("block < 4"), {"n_estimators": 60, "max_depth": 6, "min_samples_leaf": 2, "max_features": "sqrt"}
    tested = rows.where("block >= 4").withColumnRenamed("label", "actual_label")
    theirs = models.score(models.fit_weighted(models.forest(params, 0), train), tested)
    ours = models.score(forests.fit_forests(train, "block", COLS, [(params, [0, 1, 2, 3])])[0], tested)
    areas = [rank_metrics(s.select("actual_label", "predicted_probability"), []).first()["auc_roc"] for s in (theirs, ours)]
    assert areas[1] > areas[0] - 0.03 and areas[1] > 0.8


def test_nothing_one_class_and_missing_values(spark, tmp_path):
    kind = "block int, x double, y double, label double"
    empty = spark.createDataFrame([], kind)
    model = forests.fit_forests(empty, "block", ["x", "y"], [(POINTS[0], [0])])[0]
    data = spark.createDataFrame([(0, float(i), None if i % 3 else 1.0, 1.0) for i in range(20)] + [(None, 1.0, 1.0, 0.0), (0, 1.0, 1.0, None)], kind)
    assert not model.trees and {r[0] for r in models.score(model, data).select("predicted_probability").collect()} == {0.5}
    assert forests.search_scores(empty, "block", ["x", "y"], [(0, POINTS[0], [0], 1)]).count() == 0
    one = forests.fit_forests(data, "block", ["x", "y"], [(POINTS[0], [0])])[0]
    one.save(spark, f"{tmp_path}/one")
    again = forests.Forest.load(spark, f"{tmp_path}/one")
    assert {r[0] for r in models.score(again, data).select("predicted_probability").collect()} == {1.0}


def test_search_of_the_family(rows):  # noqa: F811
    spaces = {"n_estimators": [3, 6], "max_depth": [1, 4], "min_samples_leaf": [1], "max_features": ["sqrt"]}
    candidate = models.Candidate(models.forest, spaces, fit_many=forests.fit_forests, score_many=forests.search_scores)
    points = models.parameter_sets(spaces)
    scores = training.search_scores(candidate, points, rows, COLS)
    assert scores.select("block", "point").distinct().count() == len(points) * len(training.FOLDS)
    best, area = training.rate_points(scores, len(training.FOLDS))
    assert points[best]["max_depth"] == 4 and area > 0.75


@pytest.mark.parametrize("tried", [2, 4])
def test_runs_that_differ_in_leaves_share_nodes(monkeypatch, tried):
    draw, asked = np.random.default_rng(5), []
    bins = draw.integers(0, 6, (150, 4)).astype(np.uint8)
    label = (bins[:, 0] + draw.integers(0, 4, 150) > 4).astype(np.int64)
    cells, labels, cell = forests.cells_of(bins, label)
    assert np.array_equal(cells[cell], bins) and np.array_equal(labels[cell], label) and len(np.unique(np.column_stack([cells, labels]), axis=0)) == len(cells)
    runs = [forests.Run((0,), leaf, tried, 5, depth, (0.7, 1.6)) for leaf, depth in ((2, 6), (1, 30), (4, 30))]
    real = forests.decide
    monkeypatch.setattr(forests, "decide", lambda heaps, *a: (asked.append(len(heaps)), real(heaps, *a))[1])
    for tree in range(3):
        weight = np.bincount(cell, forests.row_weights(np.arange(150), tree), len(labels)).astype(np.int64)
        own = weight > 0
        asked.clear()
        together = forests.grow_together(cells[own], labels[own], weight[own], tree, runs)
        shared = sum(asked)
        asked.clear()
        for run, found in zip(runs, together):
            got = {int(h): (int(f), int(c) if f >= 0 else 0, int(v)) for h, f, c, v in zip(*found)}
            assert got == brute(bins, label, forests.row_weights(np.arange(150), tree), tree, run)
            forests.grow(cells[own], labels[own], weight[own], tree, run)
        assert shared < sum(asked)


def test_rows_that_are_alike_are_scored_once(spark, rows, monkeypatch):  # noqa: F811
    """Copies of the held-out rows give as many scores, from no more rows put through the trees."""
    seen, real = spark.sparkContext.accumulator(0), forests.Tree.values

    def values(self, bins, depths):
        seen.add(len(bins))
        return real(self, bins, depths)

    tasks = [(i, p, [0, 1], 2) for i, p in enumerate(POINTS[:2])]
    learnt, tested = rows.where("block < 2"), rows.where("block = 2")
    copies = learnt.unionByName(tested)
    for _ in range(4):
        copies = copies.unionByName(tested)
    monkeypatch.setattr(forests.Tree, "values", values)
    found = forests.search_scores(copies.coalesce(1), "block", COLS, tasks)
    n = tested.count()
    assert found.count() == 2 * 5 * n and seen.value <= n * 9  # nine trees in the run of both points


def test_scores_are_worked_out_once_and_rows_dealt_out(rows, monkeypatch):  # noqa: F811
    """Areas read the scores of a search from files; rows that lie in one file are scored by many tasks."""
    tasks = [(i, p, [0, 1], 2) for i, p in enumerate(POINTS[:2])]
    found = forests.search_scores(rows, "block", COLS, tasks)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInPandas" not in plan and "parquet" in plan
    one = rows.coalesce(1)
    assert models.dealt_out(one).rdd.getNumPartitions() > 8 and models.dealt_out(one).count() == rows.count()


def test_copies_are_counted_and_a_search_keeps_no_trees(rows, monkeypatch):  # noqa: F811
    """Disk and shuffles of a search follow the rows that differ: alike ones are one cell, trees are scored where they grow."""
    written, real = [], forests.materialise
    monkeypatch.setattr(forests, "materialise", lambda df, name: (written.append(name), real(df, name))[1])
    copies = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(9)))).withColumn("address", F.concat_ws("-", "address", "copy"))
    one, nine = (forests.cells_table(df, "block", COLS) for df in (rows, copies))
    assert nine.sizes == one.sizes and nine.counts == {k: 9 * n for k, n in one.counts.items()}
    tasks = [(i, p, [0, 1], 2) for i, p in enumerate(POINTS[:2])]
    written.clear()
    found = forests.search_scores(copies, "block", COLS, tasks, times="times")
    assert written == ["cells", "scores"]
    assert found.groupBy("point").agg(F.sum("times")).collect()[0][1] == copies.where("block = 2").count()
    assert found.count() <= 2 * one.sizes[2]


def test_weights_of_cells():
    keys, copies = np.arange(20_000), np.repeat([1, 5, 64, 1000], 5_000)
    w = forests.row_weights(keys, 1, copies)
    for n in (1, 5, 64, 1000):
        own = w[copies == n]
        assert abs(own.mean() / n - 1) < 0.05 / n**0.5 and abs(own.var() / n - 1) < 0.1
    assert np.array_equal(forests.row_weights(keys[:5_000], 1), w[:5_000])
