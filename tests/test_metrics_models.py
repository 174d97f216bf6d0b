from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from augury import schemas
from augury.ml import attribution, models
from augury.operators import metrics
from augury.plans import preprocess, research, training
from augury.sources import sample_tables as D

from conftest import rows_of, same_rows

KIND = "address string, actual_label int, predicted_label int, predicted_probability double"


def _predictions(spark, n=300, seed=2):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        p = rng.randrange(0, 21) / 20
        rows.append((f"a{i}", int(rng.random() < p), int(p >= 0.5), p))
    return rows, spark.createDataFrame(rows, KIND)


@pytest.mark.parametrize("limit", [None, 4])
def test_rank_metrics(spark, limit):
    rows, df = _predictions(spark)
    got = metrics.rank_metrics(df, limit=limit).first()
    pos = [r[3] for r in rows if r[1] == 1]
    neg = [r[3] for r in rows if r[1] == 0]
    auc = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / len(pos) / len(neg)
    assert got["auc_roc"] == pytest.approx(auc)
    ap, before = 0.0, 0
    for s in sorted({r[3] for r in rows}, reverse=True):
        tp = sum(1 for p in pos if p >= s)
        ap += (tp - before) / len(pos) * tp / (tp + sum(1 for q in neg if q >= s))
        before = tp
    assert got["avg_precision"] == pytest.approx(ap)
    turned = df.withColumn("predicted_probability", 1 - F.col("predicted_probability"))
    assert metrics.rank_metrics(turned).first()["auc_roc"] == pytest.approx(1 - auc)


def test_one_class_gives_placeholders(spark):
    df = spark.createDataFrame([("a", 0, 0, 0.2), ("b", 0, 1, 0.7)], KIND)
    got = metrics.evaluate(df).first()
    assert (got["auc_roc"], got["avg_precision"], got["precision"], got["recall"], got["f1"]) == (0.5, 0, 0, 0, 0)
    assert got["log_loss"] == pytest.approx(-(math.log(0.8) + math.log(0.3)) / 2)
    assert rows_of(metrics.confusion_matrix(df), "actual", "predicted") == [(0, 0, 1), (0, 1, 1), (1, 0, 0), (1, 1, 0)]
    assert [r["class"] for r in metrics.class_report(df).collect()] == ["Noise"]


def test_curves_and_bins(spark):
    df = spark.createDataFrame([("a", 1, 1, 1.0), ("b", 0, 0, 0.125), ("c", 1, 0, 0.0), ("d", 0, 1, 0.126)], KIND)
    bins = rows_of(metrics.calibration_bins(df).select("bin", "n"), "bin")
    assert bins == [(0, 2), (1, 1), (7, 1)]
    roc = metrics.roc_points(df).orderBy(F.desc("threshold")).collect()
    assert (roc[0]["fpr"], roc[0]["tpr"]) == (0, 0) and (roc[-1]["fpr"], roc[-1]["tpr"]) == (1, 1)
    assert metrics.pr_points(df).where("threshold = 1").first()["precision"] == 1.0


def test_mcnemar(spark):
    _, df = _predictions(spark)
    same = metrics.mcnemar(df, df).first()
    assert (same["chi2"], same["p_value"], same["significance"]) == (0.0, 1.0, "ns")
    other = df.withColumn("predicted_label", F.lit(1))
    got = metrics.mcnemar_pairs({"a": df, "b": other, "c": df})
    assert got.count() == 3
    row = got.where("model_a = 'a' and model_b = 'b'").first()
    n = row["a_only"] + row["b_only"]
    assert row["chi2"] == pytest.approx((abs(row["a_only"] - row["b_only"]) - 1) ** 2 / n)
    assert row["p_value"] == pytest.approx(math.erfc(math.sqrt(row["chi2"] / 2)))


def _model_input(spark, n=600, seed=5):
    """The first two features separate the classes, the others are noise."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        y = int(rng.random() < 0.3)
        x = [y * 2.0 + rng.gauss(0, 0.5), y * 1.0 + rng.gauss(0, 0.5)] + [rng.gauss(0, 1) for _ in range(9)]
        split = "train" if i < 400 else "val" if i < 500 else "test"
        rows.append((f"a{i:04d}", *x, y, split, i))
    columns = ", ".join(f"{c} double" for c in schemas.FEATURES)
    df = spark.createDataFrame(rows, f"address string, {columns}, {schemas.LABEL} int, split string, s long")
    return df.withColumn("first_trade_date", F.timestamp_seconds("s")).drop("s")


@pytest.fixture(scope="module")
def run(spark):
    rows = _model_input(spark)
    few = {
        "Logistic Regression": models.Candidate(models.logistic, {"C": [0.1, 1.0]}),
        "Random Forest": models.Candidate(models.forest, {"n_estimators": [10], "max_depth": [None]}),
        "Gradient Boosting": models.Candidate(models.boosting, {"n_estimators": [5], "max_depth": [3]}, early_stop=True),
        "Gaussian NB": models.Candidate(models.naive_bayes, {}),
    }
    return rows, training.train_all(rows, few, detailed_cv=False)


def test_training_separates(run):
    table = {r["model"]: r for r in training.model_comparison(run[1]).collect()}
    assert len(table) == 4
    assert all(r["auc_roc"] > 0.95 and 0 <= r["brier_score"] < 0.2 for r in table.values())
    assert table["Gaussian NB"]["cv_auc"] == 0.0 and table["Logistic Regression"]["cv_auc"] > 0.95
    assert training.mcnemar_tests(run[1]).count() == 6
    assert training.overfit_flags(run[1]).count() == 4


def test_save_load_and_export(run, tmp_path, spark):
    rows, result = run
    name = training.save_best(result, str(tmp_path))
    exported = training.export_predictions(result, name)
    loaded = training.load_best(str(tmp_path))
    again = loaded.predict(models.assemble_features(rows.where("split = 'test'")))
    same_rows(exported.select("address", "predicted_probability"), again.select("address", "predicted_probability"))
    probabilities = [r["predicted_probability"] for r in exported.collect()]
    assert probabilities == sorted(probabilities, reverse=True) and len(probabilities) == 100
    meta = spark.read.schema("model_name string, auc_roc double, feature_columns array<string>").json(f"{tmp_path}/model_metadata")
    assert meta.first()["model_name"] == name and len(meta.first()["feature_columns"]) == 11


def test_attribution_finds_the_signal(run):
    rows, result = run
    test = rows.where("split = 'test'")
    for name in ("Logistic Regression", "Random Forest"):
        model = result.fit_plain(name)
        first = attribution.feature_attribution(model, test).first()
        assert first["feature"] == "total_roi"
    with pytest.raises(TypeError):
        attribution.linear_attribution(model, models.assemble_features(test))


def test_fixed_seed_repeats(spark):
    rows = _model_input(spark, 200)
    train = models.with_weights(models.assemble_features(rows))
    scores = [
        models.score(models.forest({"n_estimators": 5}, 200).fit(train), train).select("address", "predicted_probability")
        for _ in range(2)
    ]
    same_rows(*scores)


def test_detailed_cross_validation(spark):
    only = {"Gaussian NB": models.CANDIDATES["Gaussian NB"]}
    got = training.cv_results(training.train_all(_model_input(spark, 420), only)).first()
    assert got["auc_mean"] > 0.9 and got["auc_std"] >= 0


def test_expanding_blocks_and_draws(spark):
    df = spark.createDataFrame([(f"a{i:02d}", i) for i in range(20)], "address string, first_trade_date int")
    blocks = [r["block"] for r in models.expanding_blocks(df).orderBy("address").collect()]
    assert blocks == [0] * 5 + [1] * 3 + [2] * 3 + [3] * 3 + [4] * 3 + [5] * 3
    draws = models.parameter_sets(models.FOREST_SPACE, 30)
    assert len(draws) == 30 and draws == models.parameter_sets(models.FOREST_SPACE, 30)
    assert len(models.parameter_sets(models.LOGISTIC_GRID)) == 6


def test_preprocess_and_research_plans(spark, small, tmp_path):
    trades, res = D.trades(spark, small), D.resolutions(spark, small)
    labeled = preprocess.preprocess(trades, res, f"{tmp_path}/data", min_trades=1, min_volume=0.0)
    assert labeled.count() == 15 and set(labeled.columns) >= {*schemas.FEATURES, "split", schemas.LABEL}
    cleaned = spark.read.parquet(f"{tmp_path}/data/cleaned")
    predictions = labeled.select("address", F.col(schemas.LABEL).alias("predicted_label"))
    summary = research.run_event_study(cleaned, predictions, f"{tmp_path}/out")
    assert summary.count() == 7
    result = research.run_copy_trades(cleaned, predictions, res, f"{tmp_path}/out").first()
    assert result["total_trades"] == spark.read.parquet(f"{tmp_path}/out/copy_trades").count() > 0
