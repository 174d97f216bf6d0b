"""Boosted trees grown together: brute-force trees, the same trees at every limit, searches, and the queries that train all families."""

from __future__ import annotations

import inspect

import numpy as np
import pytest
from pyspark.sql import functions as F

from augury.ml import boosting, models
from augury.operators.metrics import rank_metrics
from augury.plans import catalog, training
from tests.test_additive_models import COLS, probabilities, rows  # noqa: F401

POINTS = [
    {"n_estimators": 3, "max_depth": 2, "learning_rate": 0.2, "subsample": 0.8, "colsample_bytree": 0.7, "min_child_weight": 3},
    {"n_estimators": 6, "max_depth": 2, "learning_rate": 0.2, "subsample": 0.8, "colsample_bytree": 0.7, "min_child_weight": 3},
    {"n_estimators": 4, "max_depth": 3, "learning_rate": 0.1, "subsample": 1.0, "colsample_bytree": 1.0, "min_child_weight": 1},
]


def brute(bins, g, h, run, features, heap=1):
    """One node after the other, in plain loops."""
    part = lambda a, b: a * a / (b + boosting.UNIT)
    value = int(np.rint(-g.sum() / (h.sum() + boosting.UNIT) * run.rate * boosting.STEP))
    best = None
    for f in features if heap < 2**run.depth else ():
        for cut in range(boosting.BINS):
            left = bins[:, f] <= cut
            if min(h[left].sum(), h[~left].sum()) < run.leaf * boosting.UNIT:
                continue
            gain = part(g[left].sum(), h[left].sum()) + part(g[~left].sum(), h[~left].sum())
            if gain - part(g.sum(), h.sum()) > 1e-6 * boosting.UNIT and (best is None or gain > best[0] * (1 + 1e-12)):
                best = (gain, int(f), cut)
    if best is None:
        return np.full(len(g), value)
    left, out = bins[:, best[1]] <= best[2], np.zeros(len(g), np.int64)
    for child, side in ((2 * heap, left), (2 * heap + 1, ~left)):
        out[side] = brute(bins[side], g[side], h[side], run, features, child)
    return out


@pytest.mark.parametrize("depth", [1, 3, 6])
def test_a_tree_by_brute_force(depth):
    draw = np.random.default_rng(depth)
    bins = draw.integers(0, 8, (300, 4)).astype(np.uint8)
    label = (bins[:, 0] + draw.integers(0, 5, 300) > 6).astype(np.int64)
    run = boosting.Run((0,), depth, 0.3, 1.0, 0.8, 1, (5,), 2.5)
    g, h = boosting.slopes(draw.integers(-9, 9, 300) * boosting.STEP // 9, label, run)
    features = boosting.features_of(2, run, 4)
    tree, step = boosting.grow(np.ascontiguousarray(bins.T), g, h, run, features)
    assert len(features) == 3 and np.array_equal(step, brute(bins, g, h, run, features))
    assert np.array_equal(boosting.values_of([tree], bins), step)


def test_samples_of_cells():
    keys, copies = np.arange(20_000), np.repeat([1, 7, 64, 1000], 5_000)
    run = boosting.Run((0,), 3, 0.1, 0.7, 1.0, 1, (5,), 1.0)
    seen = boosting.sampled(keys, copies, 1, run)
    assert (seen <= copies).all() and not np.array_equal(seen, boosting.sampled(keys, copies, 2, run))
    for n in (1, 7, 64, 1000):
        own = seen[copies == n]
        assert abs(own.mean() / n - 0.7) < 0.03 / n**0.5 and abs(own.var() / n - 0.21) < 0.03


def trees_of(fitted):
    return [[(t.feature.tolist(), t.value.tolist(), np.where(t.feature >= 0, t.cut, 0).tolist()) for t in m.trees] for m in fitted]


def test_same_trees_whatever_the_limit_and_the_partitions(rows, monkeypatch):  # noqa: F811
    monkeypatch.setattr(boosting, "REFRESH", 2)
    tasks, val = [(p, [0, 1, 2]) for p in POINTS], rows.where("block = 5")
    whole = boosting.fit_boosted_trees(rows, "block", COLS, tasks, val=val)
    assert all(0 < len(m.trees) <= p["n_estimators"] for m, p in zip(whole, POINTS))
    assert trees_of(whole)[1][:3] == trees_of(whole)[0]
    assert trees_of(boosting.fit_boosted_trees(rows.repartition(7), "block", COLS, tasks, limit=50, val=val)) == trees_of(whole)
    # Copies weigh as many rows, and are as many cells.
    twice = boosting.fit_boosted_trees(rows.unionByName(rows), "block", COLS, [({**POINTS[2], "min_child_weight": 2}, [0, 1])])[0]
    assert len(twice.trees) == 4


@pytest.mark.parametrize("limit", [None, 50])
def test_search_scores_are_those_of_the_models(rows, limit):  # noqa: F811
    tasks, val = [(i, p, list(range(k)), k) for k in (2, 4) for i, p in enumerate(POINTS[1:])], rows.where("block = 5")
    fitted = boosting.fit_boosted_trees(rows, "block", COLS, [(p, g) for _, p, g, _ in tasks], val=val)
    found = boosting.search_scores(rows, "block", COLS, tasks if limit is None else tasks[:2], limit, val=val)
    got = {}
    for r in found.collect():
        got.setdefault((r["block"], r["point"]), []).append((r["label"], r["predicted_probability"]))
    for (i, _, _, k), model in list(zip(tasks, fitted))[: len(got)]:
        scored = models.score(model, rows.where(f"block = {k}")).select("label", "predicted_probability").collect()
        assert sorted(got[k, i]) == sorted(map(tuple, scored)) and len(scored) > 60


def test_rounds_end_by_the_validation_rows(rows):  # noqa: F811
    train, val = rows.where("block < 4"), rows.where("block >= 4")
    params = {"n_estimators": 400, "max_depth": 4, "learning_rate": 0.3}
    model, whole = (boosting.fit_boosted_trees(train, "block", COLS, [(params, [0, 1, 2, 3])], val=v)[0] for v in (val, None))
    assert len(model.trees) < len(whole.trees) == 400
    losses = []
    for n in range(1, len(model.trees) + 16):
        part = boosting.Boosted(COLS, whole.cuts, whole.trees[:n])
        scored = models.score(part, val).select("label", "predicted_probability").toPandas()
        p = scored["predicted_probability"]
        losses.append(-np.log(np.where(scored["label"] == 1, p, 1 - p)).mean())
    assert models.rounds_kept(losses, 400) == (len(model.trees), False)


def test_as_good_as_the_estimator(rows):  # noqa: F811
    train, params = rows.where("block < 4"), {"n_estimators": 30, "max_depth": 3, "learning_rate": 0.1}
    tested = rows.where("block >= 4").withColumnRenamed("label", "actual_label")
    theirs = models.score(models.fit_weighted(models.boosting(params, 0), train), tested)
    ours = models.score(boosting.fit_boosted_trees(train, "block", COLS, [(params, [0, 1, 2, 3])])[0], tested)
    areas = [rank_metrics(s.select("actual_label", "predicted_probability"), []).first()["auc_roc"] for s in (theirs, ours)]
    assert areas[1] > areas[0] - 0.03 and areas[1] > 0.8


def test_nothing_and_one_class(spark, tmp_path):
    kind = "block int, x double, y double, label double"
    empty = spark.createDataFrame([], kind)
    model = boosting.fit_boosted_trees(empty, "block", ["x", "y"], [(POINTS[0], [0])], val=empty)[0]
    data = spark.createDataFrame([(0, float(i), None if i % 3 else 1.0, 1.0) for i in range(20)] + [(None, 1.0, 1.0, 0.0), (0, 1.0, 1.0, None)], kind)
    assert not model.trees and {r[0] for r in models.score(model, data).select("predicted_probability").collect()} == {0.5}
    assert boosting.search_scores(empty, "block", ["x", "y"], [(0, POINTS[0], [0], 1)]).count() == 0
    one = boosting.fit_boosted_trees(data, "block", ["x", "y"], [(POINTS[2], [0])])[0]
    one.save(spark, f"{tmp_path}/one")
    again = boosting.Boosted.load(spark, f"{tmp_path}/one")
    assert [r[0] for r in models.score(again, data).collect()] == [r[0] for r in models.score(one, data).collect()]
    # Without negatives the positives weigh nothing.
    assert {r[0] for r in models.score(again, data).select("predicted_probability").collect()} == {0.5}


def test_the_queries_train_every_family(spark, rows, monkeypatch):  # noqa: F811
    """Boosting was left out of the registered training queries."""
    seen = []
    monkeypatch.setattr(catalog, "searched", lambda spark, sf, name: (seen.append(name), ({}, 0.5))[1])
    monkeypatch.setattr(catalog, "prepared", lambda spark, sf: None)
    monkeypatch.setattr(catalog, "once", lambda spark, sf, name, make: name)
    monkeypatch.setattr(training, "together", lambda families: families)
    assert catalog.trained(spark, "any") == list(models.CANDIDATES) and set(seen) == set(models.CANDIDATES)
    space = models.CANDIDATES["Gradient Boosting"]
    assert space.space == models.BOOSTING_SPACE and space.draws == 30 and space.early_stop
    assert "names=" in str(inspect.signature(catalog.trained)).replace(" ", "")


def test_whole_search_of_the_family(rows):  # noqa: F811
    spaces = {"n_estimators": [5, 30], "max_depth": [1, 3], "learning_rate": [0.2]}
    candidate = models.Candidate(models.boosting, spaces, early_stop=True, fit_many=boosting.fit_boosted_trees, score_many=boosting.search_scores)
    bound = models.stopped_by(candidate, rows.where("block = 5"))
    scores = training.search_scores(bound, models.parameter_sets(spaces), rows, COLS, times="times")
    assert scores.select("block", "point").distinct().count() == 4 * len(training.FOLDS)
    assert scores.where("point = 0").agg(F.sum("times")).first()[0] == rows.where("block > 0").count()
    best, area = training.rate_points(scores, len(training.FOLDS), "times")
    assert area > 0.75
