"""Classifiers on the feature matrix, built from Spark ML estimators."""

from __future__ import annotations

import itertools
import random
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace
from functools import partial

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, LogisticRegression, NaiveBayes, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from augury import schemas
from augury.ml import additive, boosting as boosted_trees, forests, isotonic
from augury.ml.boosting import rounds_kept
from augury.operators.joins import cross_scalar
from augury.operators.ordered import ordered
from augury.session import materialise

SEED = 42

# The search spaces.
LOGISTIC_GRID = {"C": [0.001, 0.01, 0.1, 1.0, 10.0, 100.0]}
FOREST_SPACE = {
    "n_estimators": [100, 200, 300, 500],
    "max_depth": [3, 5, 7, 10, 15, None],
    "min_samples_leaf": [1, 2, 4],
    "max_features": ["sqrt", "log2", None],
}
BOOSTING_SPACE = {
    "n_estimators": [100, 200, 500, 1000],
    "max_depth": [3, 5, 7, 9],
    "learning_rate": [0.001, 0.01, 0.05, 0.1, 0.2],
    "subsample": [0.7, 0.8, 0.9, 1.0],
    "colsample_bytree": [0.7, 0.8, 0.9, 1.0],
    "min_child_weight": [1, 3, 5, 7],
}
# Fixed value: the deepest tree Spark grows, used where no depth limit is asked for.
MAX_DEPTH = 30


def assemble_features(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Add the vector ``features`` and the double ``label``."""
    assembler = VectorAssembler(inputCols=cols or schemas.FEATURES, outputCol="features", handleInvalid="error")
    return assembler.transform(df).withColumn("label", F.col(schemas.LABEL).cast("double"))


def with_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Add two class weights: ``balanced`` = n / (2 n_class) and ``pos_scaled`` = n_neg / n_pos for positives, else 1."""
    positive = F.col(label) == 1
    counts = df.agg(F.count_if(positive).alias("_pos"), F.count_if(~positive).alias("_neg"))
    own = F.when(positive, F.col("_pos")).otherwise(F.col("_neg"))
    ratio = F.coalesce(F.try_divide(F.col("_neg").cast("double"), F.col("_pos")), F.lit(1.0))
    return cross_scalar(df, counts).withColumns(
        {
            "balanced": (F.col("_pos") + F.col("_neg")) / (2.0 * own),
            "pos_scaled": F.when(positive, ratio).otherwise(1.0),
        }
    ).drop("_pos", "_neg")


def fit_weighted(pipeline: Pipeline, train: DataFrame, label: str = "label") -> PipelineModel:
    """Fit with class weights from the rows of this fit alone."""
    return pipeline.fit(with_weights(train.drop("balanced", "pos_scaled"), label))


def _scaler() -> StandardScaler:
    return StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True)


def logistic(params: dict, n_rows: int) -> Pipeline:
    """Scaled L2 logistic regression; C is the inverse strength against the summed loss, hence 1 / (C n)."""
    model = LogisticRegression(
        featuresCol="scaled", labelCol="label", weightCol="balanced", maxIter=2000, elasticNetParam=0.0,
        standardization=False, regParam=1.0 / (params.get("C", 1.0) * max(n_rows, 1)),
    )
    return Pipeline(stages=[_scaler(), model])


def forest(params: dict, n_rows: int) -> Pipeline:
    depth = params.get("max_depth")
    model = RandomForestClassifier(
        featuresCol="features", labelCol="label", weightCol="balanced", seed=SEED,
        numTrees=params.get("n_estimators", 100), maxDepth=MAX_DEPTH if depth is None else depth,
        minInstancesPerNode=params.get("min_samples_leaf", 1),
        featureSubsetStrategy={"sqrt": "sqrt", "log2": "log2", None: "all"}[params.get("max_features", "sqrt")],
    )
    return Pipeline(stages=[model])


def boosting(params: dict, n_rows: int) -> Pipeline:
    """Boosted trees of a fixed number of rounds; ``fit_boosted`` decides how many of them count."""
    model = GBTClassifier(
        featuresCol="features", labelCol="label", weightCol="pos_scaled", seed=SEED,
        maxIter=params.get("n_estimators", 100), maxDepth=params.get("max_depth", 5),
        stepSize=params.get("learning_rate", 0.1), subsamplingRate=params.get("subsample", 1.0),
        minInstancesPerNode=params.get("min_child_weight", 1),
        featureSubsetStrategy=str(params.get("colsample_bytree", 1.0)) if params.get("colsample_bytree", 1.0) < 1 else "all",
    )
    return Pipeline(stages=[model])


FIRST_ROUNDS = 32


def first_rounds(model: GBTClassificationModel, n: int) -> GBTClassificationModel:
    """The model of the first ``n`` rounds of a fitted one."""
    if n >= model.getNumTrees:
        return model
    context, java = SparkSession.active().sparkContext, model._java_obj
    ml, trees, weights = context._jvm.org.apache.spark.ml, java.trees(), model.treeWeights
    first = context._gateway.new_array(ml.regression.DecisionTreeRegressionModel, n)
    sizes = context._gateway.new_array(context._jvm.double, n)
    for k in range(n):
        first[k], sizes[k] = trees[k], weights[k]
    cut = ml.classification.GBTClassificationModel(java.uid(), first, sizes)
    return GBTClassificationModel(cut)


def fit_boosted(params: dict, n_rows: int, train: DataFrame, val: DataFrame | None, counts: list[int]) -> dict[int, PipelineModel]:
    """One model for each number of rounds in ``counts``, all cut from one run.

    A run's first rounds don't depend on how many follow, so the models are prefixes of the longest run. Its length
    grows fourfold until ``boosting.PATIENCE`` rounds in a row have brought no gain on ``val``, or the largest count is reached.
    Without validation rows every model has all its rounds.
    """
    most = max(counts)
    some = val is not None and val.limit(1).count() > 0
    rounds = min(FIRST_ROUNDS, most) if some else most
    while True:
        model = fit_weighted(boosting({**params, "n_estimators": rounds}, n_rows), train).stages[-1]
        if not some:
            return {n: PipelineModel([first_rounds(model, n)]) for n in counts}
        losses = model.evaluateEachIteration(val.withColumn("pos_scaled", F.lit(1.0)))
        kept = {n: rounds_kept(losses, n) for n in counts}
        if not any(open_ for _, open_ in kept.values()):
            return {n: PipelineModel([first_rounds(model, k)]) for n, (k, _) in kept.items()}
        rounds = min(4 * rounds, most)


def naive_bayes(params: dict, n_rows: int) -> Pipeline:
    model = NaiveBayes(featuresCol="scaled", labelCol="label", modelType="gaussian")
    return Pipeline(stages=[_scaler(), model])


@dataclass(frozen=True)
class Candidate:
    """A model family: how to build it, what to search, how many draws (None: the whole grid).

    ``fit_many`` fits all settings and groups of rows at once, where a family can do that. ``score_many`` scores held-out
    rows under all fits of a search, where the models are too large to be held.
    """

    build: Callable[[dict, int], Pipeline]
    space: dict
    draws: int | None = None
    early_stop: bool = False  # boosting: rounds are cut by the validation rows
    fit_many: Callable[[DataFrame, str, list[str], list[additive.Task]], list] | None = None
    score_many: Callable[[DataFrame, str, list[str], list[tuple[int, dict, list[int], int]]], DataFrame] | None = None


CANDIDATES = {
    "Logistic Regression": Candidate(logistic, LOGISTIC_GRID, fit_many=additive.fit_logistic),
    "Random Forest": Candidate(forest, FOREST_SPACE, 30, fit_many=forests.fit_forests, score_many=forests.search_scores),
    "Gradient Boosting": Candidate(
        boosting, BOOSTING_SPACE, 30, early_stop=True, fit_many=boosted_trees.fit_boosted_trees, score_many=boosted_trees.search_scores
    ),
    "Gaussian NB": Candidate(naive_bayes, {}, fit_many=additive.fit_naive_bayes),
}


def stopped_by(candidate: Candidate, val: DataFrame | None) -> Candidate:
    """The family with its rounds cut by these rows, where it stops early and fits all at once."""
    if not candidate.early_stop or candidate.fit_many is None:
        return candidate
    return replace(candidate, fit_many=partial(candidate.fit_many, val=val), score_many=partial(candidate.score_many, val=val))


# Settings of a fit without a search.
DEFAULTS = {
    "Logistic Regression": {"C": 1.0},
    "Random Forest": {"n_estimators": 100, "max_depth": 10, "min_samples_leaf": 1, "max_features": "sqrt"},
    "Gradient Boosting": {"n_estimators": 100, "max_depth": 5, "learning_rate": 0.1},
    "Gaussian NB": {},
}


def fit_one(candidate: Candidate, params: dict, n_rows: int, train: DataFrame, val: DataFrame | None) -> PipelineModel:
    if candidate.early_stop:
        n = params.get("n_estimators", 100)
        return fit_boosted(params, n_rows, train, val, [n])[n]
    return fit_weighted(candidate.build(params, n_rows), train)


def parameter_sets(space: dict, draws: int | None = None, seed: int = SEED) -> list[dict]:
    """The whole grid, or so many distinct points of it drawn with a fixed seed."""
    grid = [dict(zip(space, point)) for point in itertools.product(*space.values())]
    return grid if draws is None or draws >= len(grid) else random.Random(seed).sample(grid, draws)


def score(model, df: DataFrame) -> DataFrame:
    """Add ``predicted_probability`` of the positive class. Only the probability is kept of the model's columns."""
    if isinstance(model, tuple(OWN_KINDS.values())):
        return df.withColumn("predicted_probability", model.probability())
    scored = model.transform(df)
    return scored.select(*df.columns, vector_to_array("probability")[1].alias("predicted_probability"))


def expanding_blocks(df: DataFrame, n_splits: int = 5, order: list[str] | None = None) -> DataFrame:
    """Add ``block``: 0 for the first rows in order, 1..n_splits for the test blocks that follow them.

    Fold k trains on the blocks before k and tests on block k.
    """
    order = order or ["first_trade_date", "address"]
    rows = ordered(df, [], order).running("sum", F.lit(1), "_rn").df
    n = df.agg(F.count("*").alias("_n"))
    size = F.floor(F.col("_n") / (n_splits + 1))
    past = F.col("_rn") - 1 - (F.col("_n") - n_splits * size)
    block = F.when(past < 0, 0).otherwise(F.floor(F.try_divide(past.cast("double"), size)) + 1)
    return cross_scalar(rows, n).withColumn("block", block.cast("int")).drop("_rn", "_n")


# Models that save and load themselves, by the name under which they are stored.
OWN_KINDS = {"additive": additive.Additive, "forest": forests.Forest, "boosted": boosted_trees.Boosted}


@dataclass
class CalibratedModel:
    """Averages the isotonic-calibrated probabilities of models fitted on parts of the training rows."""

    members: list[tuple[PipelineModel | additive.Additive | forests.Forest | boosted_trees.Boosted, isotonic.Isotonic]]

    def predict(self, df: DataFrame) -> DataFrame:
        columns = df.columns
        for i, (model, calibrator) in enumerate(self.members):
            df = score(model, df).withColumnRenamed("predicted_probability", "_raw")
            df = df.withColumn(f"_p{i}", calibrator.predict(F.col("_raw"))).drop("_raw")
        mean = sum((F.col(f"_p{i}") for i in range(1, len(self.members))), F.col("_p0")) / len(self.members)
        return df.select(*columns, mean.alias("predicted_probability")).withColumn(
            "predicted_label", (F.col("predicted_probability") > 0.5).cast("int")
        )

    def save(self, path: str) -> None:
        spark = SparkSession.active()
        kinds = [next((k for k, kind in OWN_KINDS.items() if isinstance(model, kind)), "pipeline") for model, _ in self.members]
        spark.createDataFrame([(" ".join(kinds),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/kinds")
        for i, (model, calibrator) in enumerate(self.members):
            if kinds[i] in OWN_KINDS:
                model.save(spark, f"{path}/part{i}/model")
            else:
                model.write().overwrite().save(f"{path}/part{i}/model")
            calibrator.save(spark, f"{path}/part{i}/calibrator")

    @staticmethod
    def load(path: str) -> "CalibratedModel":
        spark = SparkSession.active()
        kinds = spark.read.text(f"{path}/kinds").first()[0].split(" ")
        members = []
        for i, kind in enumerate(kinds):
            at = f"{path}/part{i}/model"
            model = OWN_KINDS[kind].load(spark, at) if kind in OWN_KINDS else PipelineModel.load(at)
            members.append((model, isotonic.Isotonic.load(spark, f"{path}/part{i}/calibrator")))
        return CalibratedModel(members)


def dealt_out(rows: DataFrame) -> DataFrame:
    """The rows in about equal parts for all cores: many trees a row are much work for little data, which would else lie in few files."""
    keys = ["address"] if "address" in rows.columns else []
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, *keys)


def calibration_parts(train: DataFrame, parts: int = 3, order: list[str] | None = None, by: list[str] | None = None) -> DataFrame:
    """Add ``part``: contiguous thirds (or so) of each class, within the groups ``by``."""
    order, keys = order or ["first_trade_date", "address"], [*(by or []), "label"]
    placed = ordered(train, keys, order).running("sum", F.lit(1), "_rn").df
    sizes = train.groupBy(*keys).agg(F.count("*").alias("_n"))
    part = F.floor((F.col("_rn") - 1) * parts / F.col("_n")).cast("int")
    # Two classes, a few folds: the table of sizes has as many rows.
    return placed.join(F.broadcast(sizes), keys).withColumn("part", part).drop("_rn", "_n")


def calibrate(
    fit: Callable[[DataFrame], PipelineModel], train: DataFrame, parts: int = 3,
    order: list[str] | None = None, pieces: int | None = None, score_digits: int | None = None,
) -> CalibratedModel:
    """``fit`` on all parts but one, calibrate on the one left out, for each part in turn.

    ``pieces``: partitions of a fit. ``score_digits`` rounds the scores before the isotonic fit, and is off unless asked
    for.
    """
    placed = materialise(calibration_parts(train, parts, order), "parts")
    placed = placed if pieces is None else placed.coalesce(pieces)

    def fit_part(i: int) -> tuple[PipelineModel, isotonic.Isotonic]:
        model = fit(placed.where(F.col("part") != i).drop("part"))
        held_out = score(model, placed.where(F.col("part") == i))
        raw = F.col("predicted_probability")
        held_out = held_out.withColumn("_raw", raw if score_digits is None else F.round(raw, score_digits))
        return model, isotonic.fit(held_out, "_raw", "label")[0]

    with ThreadPoolExecutor(parts) as pool:
        return CalibratedModel(list(pool.map(fit_part, range(parts))))


def calibrate_many(candidate: Candidate, params: dict, rows: DataFrame, cols: list[str], folds: list[int], parts: int = 3) -> dict[int, CalibratedModel]:
    """As ``calibrate``, for a family that fits many at once: one calibrated model for each value of ``fold`` in the rows."""
    placed = calibration_parts(rows, parts, by=["fold"]).withColumn("group", F.col("fold") * parts + F.col("part"))
    placed = materialise(placed, "parts")
    spots = [(k, i) for k in folds for i in range(parts)]
    models = candidate.fit_many(placed, "group", cols, [(params, [k * parts + j for j in range(parts) if j != i]) for k, i in spots])
    scored = additive.held_out(dealt_out(placed), "group", {k * parts + i: [m] for (k, i), m in zip(spots, models)})
    fitted = isotonic.fit(scored.withColumn("_raw", F.col("scores")[0]), "_raw", "label", "group")
    by_fold: dict[int, list] = {k: [] for k in folds}
    for (k, i), model in zip(spots, models):
        if k * parts + i in fitted:
            by_fold[k].append((model, fitted[k * parts + i]))
    return {k: CalibratedModel(members) for k, members in by_fold.items() if members}
