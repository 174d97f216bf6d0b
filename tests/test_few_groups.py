"""Tables of a few groups are not joined by shuffle, equal scores travel once, and a search is run without what follows it."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from augury.ml import additive, forests, models
from augury.operators import labels, metrics
from augury.plans import catalog
from tests.test_additive_models import COLS, rows  # noqa: F401
from tests.test_forests import POINTS


@pytest.fixture
def sizes_unknown(spark):
    """Spark broadcasts nothing unasked, as where it can't tell that a table is small."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_task_holds_a_split(spark, sizes_unknown):
    data = [(f"a{i}", ("train", "val", None)[i % 3], i % 7 / 7, i % 5 / 5, i % 11 / 11) for i in range(60)]
    split = spark.createDataFrame(data, "address string, split string, total_roi double, win_rate double, profit_loss_ratio double")
    assert "SortMergeJoin" not in plan_of(labels.composite_labels(split))


def test_no_task_holds_a_group_of_scores(spark, sizes_unknown):
    scores = spark.createDataFrame([(i % 2, i % 3 % 2, i / 50) for i in range(50)], "part int, actual_label int, predicted_probability double")
    assert "SortMergeJoin" not in plan_of(metrics.score_steps(scores, ["part"]))


def test_equal_scores_travel_once(rows):  # noqa: F811
    copies = rows.unionByName(rows).unionByName(rows)
    tasks = [(i, p, [0, 1], 2) for i, p in enumerate(POINTS[:2])]
    plain = forests.search_scores(copies, "block", COLS, tasks).withColumn("actual_label", F.col("label").cast("int"))
    merged = forests.search_scores(copies, "block", COLS, tasks, times="n").withColumn("actual_label", F.col("label").cast("int"))
    assert merged.count() * 3 <= plain.count() == merged.agg(F.sum("n")).first()[0]
    areas = [sorted(map(tuple, metrics.rank_metrics(s, ["point", "block"], times=t).collect())) for s, t in ((plain, None), (merged, "n"))]
    assert areas[0] == areas[1]


def test_logistic_sums_are_those_of_each_scaling(spark):
    """Sets of rows of like and of very unlike scaling, one with a constant feature, and rows of no set."""
    draw = np.random.default_rng(3)
    x, y, g = draw.normal(size=(90, 2)), draw.integers(0, 2, 90).astype(float), np.arange(90) % 4
    x[g == 1, 0] = 1e6 + 1e-3 * x[g == 1, 0]
    x[g == 2, 1] = 4.0
    table = spark.createDataFrame([(int(k), *map(float, r), float(v)) for k, r, v in zip(g, x, y)], "g int, a double, b double, label double")
    scales, betas = [], []
    for k, groups in enumerate(([0], [1], [2], [0, 2])):
        own = x[np.isin(g, groups)]
        std = own.std(0, ddof=1)
        scales.append((groups, own.mean(0), np.divide(1.0, std, out=np.zeros(2), where=std > 1e-9), (0.8, 1.3)))
        betas += [(k, draw.normal(size=3)) for _ in range(2)]
    found = additive.sums(table, "g", ["a", "b"], scales, betas)
    for i, (k, beta) in enumerate(betas):
        groups, mean, factor, (w0, w1) = scales[k]
        here = np.isin(g, groups)
        z = np.column_stack([np.ones(here.sum()), (x[here] - mean) * factor])
        w, p, t = np.where(y[here] == 1, w1, w0), 1 / (1 + np.exp(-z @ beta)), y[here]
        loss = (w * (np.logaddexp(0, z @ beta) - t * (z @ beta))).sum()
        want = np.r_[loss, z.T @ (w * (p - t)), ((z * (w * p * (1 - p))[:, None]).T @ z).ravel()]
        assert np.allclose(found[i], want, rtol=1e-9, atol=1e-7)


def test_attribution_needs_no_calibration(spark, small, monkeypatch):
    """Only the search and one fit on all training rows."""
    monkeypatch.setattr(models, "calibrate_many", lambda *a, **k: pytest.fail("calibrated"))
    monkeypatch.setattr(catalog, "_kept", {})
    assert catalog.QUERIES["attribution_gaussian_nb"](spark, small).count() == 11
