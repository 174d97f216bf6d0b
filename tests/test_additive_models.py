"""Fits by sums against Spark's own estimators, isotonic fits against brute force, boosting prefixes, and whole searches."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import functions as F

from augury import schemas
from augury.ml import additive, isotonic, models
from augury.plans import training

COLS = ["a", "b", "c", "flat"]


@pytest.fixture(scope="module")
def rows(spark):
    draw = np.random.default_rng(5)
    x = draw.normal(size=(400, 3)) * [1.0, 30.0, 0.01] + [0.0, 500.0, 2.0]
    y = (x[:, 0] + (x[:, 1] - 500) / 40 + draw.normal(size=400) > 0.8).astype(float)
    data = [(f"t{i:03d}", i, int(i * 6 // 400), *map(float, r), 7.0, float(v)) for i, (r, v) in enumerate(zip(x, y))]
    df = spark.createDataFrame(data, "address string, first_trade_date int, block int, a double, b double, c double, flat double, label double")
    return models.assemble_features(df.withColumn(schemas.LABEL, F.col("label").cast("int")), COLS).repartition(3)


def probabilities(df):
    return np.array([r["predicted_probability"] for r in df.orderBy("address").collect()])


@pytest.mark.parametrize("strength", [0.01, 1.0, 100.0])
def test_logistic_equals_the_estimator(rows, strength):
    train = rows.where("block < 4")
    theirs = models.fit_weighted(models.logistic({"C": strength}, train.count()), train)
    ours = additive.fit_logistic(rows, "block", COLS, [({"C": strength}, [0, 1, 2, 3])])[0]
    assert np.allclose(probabilities(models.score(theirs, rows)), probabilities(models.score(ours, rows)), atol=2e-5)


def test_many_fits_are_the_single_ones_and_converged(rows):
    tasks = [({"C": c}, list(range(k))) for k in (1, 3, 5) for c in (0.001, 1.0, 100.0)]
    together = additive.fit_logistic(rows, "block", COLS, tasks)
    for task, model in zip(tasks, together):
        alone = additive.fit_logistic(rows.where(F.col("block").isin(task[1])), "block", COLS, [task])[0]
        assert np.allclose(alone.values["scaled"], model.values["scaled"], atol=1e-8)
    by_fold = {}
    for (params, groups), model in zip(tasks, together):
        by_fold.setdefault(tuple(groups), []).append((model, params["C"]))
    slope = additive.gradients(rows, by_fold, "block").agg(F.max(F.abs("gradient")), F.count("*")).first()
    assert slope[0] < 1e-8 and slope[1] == len(tasks) * (len(COLS) + 1)


def test_separable_classes_and_one_class(spark):
    data = [(0, float(i), float(i >= 10)) for i in range(20)]
    df = spark.createDataFrame(data, "block int, x double, label double")
    fitted = additive.fit_logistic(df, "block", ["x"], [({"C": 1e6}, [0])])[0]
    assert fitted.values["scaled"][0] > 5 and np.isfinite(fitted.values["scaled"]).all()
    one = df.where("label = 1")
    for fit in (additive.fit_logistic, additive.fit_naive_bayes):
        assert one.select(fit(one, "block", ["x"], [({}, [0])])[0].probability().alias("p")).agg(F.min("p")).first()[0] >= 0.5


def test_naive_bayes_equals_the_estimator(rows):
    train = rows.where("block < 4")
    theirs = models.fit_weighted(models.naive_bayes({}, 0), train)
    ours = additive.fit_naive_bayes(rows, "block", COLS, [({}, [0, 1, 2, 3])])[0]
    assert np.allclose(probabilities(models.score(theirs, rows)), probabilities(models.score(ours, rows)), atol=1e-6)


def test_merged_moments():
    draw = np.random.default_rng(1)
    x = draw.normal(size=(50, 2)) * 1e-6 + 1e6  # nearly equal values: sums of squares would lose all digits
    of = lambda part: additive.Moments(len(part), part.mean(0), ((part - part.mean(0)) ** 2).sum(0))
    both = of(x[:20]) + of(x[20:])
    assert both.n == 50 and np.allclose(both.squares, of(x).squares, rtol=1e-3)


def test_held_out_scores(rows):
    fitted = additive.fit_logistic(rows, "block", COLS, [({"C": c}, [0, 1]) for c in (0.1, 1.0)])
    got = additive.held_out(rows, "block", {2: fitted, 4: fitted[:1]}, keep=("address", "label")).collect()
    assert {r["block"] for r in got} == {2, 4} and all(len(r["scores"]) == (2 if r["block"] == 2 else 1) for r in got)
    expected = {r["address"]: r["predicted_probability"] for r in models.score(fitted[0], rows).collect()}
    assert all(abs(r["scores"][0] - expected[r["address"]]) < 1e-12 for r in got)


# ---------------------------------------------------------------- isotonic


def brute_isotonic(points):
    """max over starts of the min over ends of the mean, for each distinct x."""
    merged = {}
    for x, y, w in points:
        s, t = merged.get(x, (0.0, 0.0))
        merged[x] = (s + y * w, t + w)
    xs = sorted(merged)
    mean = lambda a, b: sum(merged[x][0] for x in xs[a : b + 1]) / sum(merged[x][1] for x in xs[a : b + 1])
    return {x: max(min(mean(a, b) for b in range(i, len(xs))) for a in range(i + 1)) for i, x in enumerate(xs)}


@pytest.mark.parametrize("limit", [3, 7, 1000])
def test_isotonic_levels(spark, limit):
    draw = np.random.default_rng(limit)
    points = [(g, float(x), float(draw.random() < (x / 30 if g else 0.5)), float(draw.integers(1, 4))) for g in (0, 1, 2) for x in draw.integers(0, 30, 60)]
    df = spark.createDataFrame([*points, (0, None, 1.0, 1.0), (0, float("nan"), 1.0, 1.0), (1, 3.0, None, 1.0)], "g int, x double, y double, w double")
    got = {}
    for r in isotonic.levels(df, "x", "y", "g", "w", limit).collect():
        for x in range(30):
            if r["low"] <= x <= r["high"]:
                got[r["group"], x] = r["level"]
    for g in (0, 1, 2):
        expected = brute_isotonic([(x, y, w) for k, x, y, w in points if k == g])
        assert all(abs(got[g, x] - v) < 1e-12 for x, v in expected.items())
    theirs = IsotonicRegression(featuresCol="x", labelCol="y", weightCol="w").fit(df.where("g = 1 and x is not null and y is not null"))
    ours = isotonic.fit(df, "x", "y", "g", "w", limit)[1]
    grid = spark.range(0, 130).select((F.col("id") / 4 - 1).alias("x"))
    both = theirs.transform(grid).withColumn("ours", ours.predict(F.col("x"))).collect()
    assert all(abs(r["prediction"] - r["ours"]) < 1e-9 for r in both)


def test_isotonic_of_nothing(spark):
    assert isotonic.fit(spark.createDataFrame([], "x double, y double"), "x", "y") == {}


# ---------------------------------------------------------------- boosting


def test_patience():
    losses = [1.0, 0.9, 0.95, *[0.96] * 13, 0.8, *[0.85] * 20]
    assert models.rounds_kept(losses, 40) == (17, False)  # the gain came 15 rounds after the one before
    assert models.rounds_kept([1.0, 0.9, *[0.95] * 15, 0.1], 40) == (2, False)  # one round too late
    assert models.rounds_kept(losses, 10) == (2, False) and models.rounds_kept(losses[:5], 40) == (2, True)


def test_boosting_prefixes(rows, monkeypatch):
    monkeypatch.setattr(models, "FIRST_ROUNDS", 4)
    fits = []
    plain = models.fit_weighted
    monkeypatch.setattr(models, "fit_weighted", lambda p, t, label="label": fits.append(p.getStages()[0].getMaxIter()) or plain(p, t, label))
    params = {"max_depth": 2, "learning_rate": 0.2, "subsample": 0.8, "colsample_bytree": 0.8}
    train, val = rows.where("block < 4").coalesce(1), rows.where("block = 4")
    found = models.fit_boosted(params, 0, train, None, [3, 6])
    assert fits == [6] and {n: m.stages[-1].getNumTrees for n, m in found.items()} == {3: 3, 6: 6}
    alone = plain(models.boosting({**params, "n_estimators": 3}, 0), train)
    assert np.allclose(probabilities(models.score(found[3], rows)), probabilities(models.score(alone, rows)))
    fits.clear()
    stopped = models.fit_boosted(params, 0, train, val, [8, 10])
    assert fits == [4, 10] and all(m.stages[-1].getNumTrees <= n for n, m in stopped.items())
    losses = plain(models.boosting({**params, "n_estimators": 10}, 0), train).stages[-1].evaluateEachIteration(val.withColumn("pos_scaled", F.lit(1.0)))
    assert stopped[10].stages[-1].getNumTrees == models.rounds_kept(losses, 10)[0]


def test_points_that_share_a_run():
    points = models.parameter_sets({"n_estimators": [10, 20], "max_depth": [2, 3]})
    assert training.runs_of(models.CANDIDATES["Gradient Boosting"], points) == [[0, 2], [1, 3]]
    assert training.runs_of(models.CANDIDATES["Random Forest"], points) == [[0], [1], [2], [3]]


# ---------------------------------------------------------------- whole searches


def table(spark, n=240):
    draw = np.random.default_rng(2)
    rows = []
    for i in range(n):
        label = i % 3 == 0
        values = [float(v) for v in draw.normal(size=len(schemas.FEATURES))]
        values[0] += 5.0 * label
        rows.append((f"t{i:03d}", i, i < n * 3 // 4, float(values[0]), *values, int(label)))
    kinds = ", ".join(f"{c} double" for c in schemas.FEATURES)
    return spark.createDataFrame(rows, f"address string, first_trade_date int, is_train boolean, Risk_Adjusted_Return double, {kinds}, {schemas.LABEL} int")


def test_search_of_every_family(spark, tmp_path):
    small = {
        "Logistic Regression": models.CANDIDATES["Logistic Regression"],
        "Random Forest": models.Candidate(models.forest, {"n_estimators": [3, 5], "max_depth": [3]}),
        "Gradient Boosting": models.Candidate(models.boosting, {"n_estimators": [2, 4], "max_depth": [2]}, early_stop=True),
        "Gaussian NB": models.CANDIDATES["Gaussian NB"],
    }
    # No split column: the last fifth of the training rows validates, and the fold search runs to its end.
    run = training.train_all(table(spark), small, detailed_cv=False)
    report = {r["model"]: r for r in training.training_report(run).collect()}
    assert set(report) == set(small)
    for name, r in report.items():
        assert r["auc_roc"] > 0.8 and r["train_auc"] > 0.8 and r["val_auc"] > 0.8, name
        assert (r["n_train"], r["n_val"], r["n_test"]) == (144, 36, 60) and len(r["feature_columns"]) == len(schemas.FEATURES)
        assert name == "Gaussian NB" or r["cv_auc"] > 0.8
    assert run.parameters["Logistic Regression"]["C"] in models.LOGISTIC_GRID["C"]
    for name in small:  # saved and loaded, whatever the kind of model
        run.fitted[name].save(f"{tmp_path}/{name}")
        again = models.CalibratedModel.load(f"{tmp_path}/{name}")
        tested = models.assemble_features(table(spark).where("not is_train"))
        assert np.allclose(probabilities(again.predict(tested)), probabilities(run.fitted[name].predict(tested)))


def test_labels_from_returns_where_there_are_none(spark):
    bare = table(spark).drop(schemas.LABEL)
    ready = training.prepare(bare)
    labels = ready.rows.groupBy("split").agg(F.avg(schemas.LABEL).alias("p")).collect()
    train = next(r["p"] for r in labels if r["split"] == "train")
    assert {r["split"] for r in labels} == {"train", "val", "test"} and 0.15 < train < 0.25
    assert ready.n == 144 and ready.val.count() == 36


def test_fold_metrics_of_summed_families(spark):
    only = {k: models.CANDIDATES[k] for k in ("Logistic Regression", "Gaussian NB")}
    got = {r["model"]: r for r in training.cv_results(training.train_all(table(spark), only)).collect()}
    assert set(got) == set(only) and all(r["auc_mean"] > 0.9 and r["auc_std"] >= 0 for r in got.values())
