"""Train, calibrate and compare the classifiers."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, functions as F

from augury import schemas
from augury.ml import additive, models as M
from augury.operators import labels, metrics
from augury.operators.joins import cross_scalar
from augury.session import materialise, scratch_path
from augury.sources.tables import write_metrics_json


# Default of the training rows per partition of a fit. Tree sampling follows the partitions, so it is a parameter.
ROWS_PER_PARTITION = 50_000


def _union(tables: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), tables)


def _labelled(scored: DataFrame) -> DataFrame:
    return scored.withColumn("actual_label", F.col("label").cast("int"))


FOLDS = range(1, 6)


def fold_rows(blocks: DataFrame, k: int) -> DataFrame:
    """What fold ``k`` trains on: the blocks before it."""
    return blocks.where(F.col("block") < k).drop("block")


def fold_size(n: int, k: int) -> int:
    """Rows that fold ``k`` trains on: all but the blocks from k on, each a sixth of the rows, rounded down."""
    return n - (len(FOLDS) + 1 - k) * (n // (len(FOLDS) + 1))


def search(
    candidate: M.Candidate, blocks: DataFrame, val: DataFrame | None, n: int, parallelism: int = 8
) -> tuple[dict, float]:
    """The parameters with the best mean area under the curve over the folds; the first of equals.

    The fits of all points and folds run side by side. Their scores go to one written table, so that all points are
    rated by a single grouped job.
    """
    points, candidate = M.parameter_sets(candidate.space, candidate.draws), M.stopped_by(candidate, val)
    if not candidate.space:
        return {}, 0.0
    if candidate.fit_many is not None:
        rated = rate_points(search_scores(candidate, points, blocks, times="times"), len(FOLDS), "times")
        return points[rated[0]], rated[1]
    spark = blocks.sparkSession
    scores = scratch_path(spark, "folds")

    def fit_and_score(task: tuple[list[int], int]) -> None:
        same, k = task
        rows, tested = fold_rows(blocks, k), blocks.where(F.col("block") == k)
        if candidate.early_stop:
            counts = {i: points[i].get("n_estimators", 100) for i in same}
            fitted = M.fit_boosted(points[same[0]], fold_size(n, k), rows, val, sorted(set(counts.values())))
            models = {i: fitted[c] for i, c in counts.items()}
        else:
            models = {i: M.fit_one(candidate, points[i], fold_size(n, k), rows, None) for i in same}
        for i, model in models.items():
            scored = _labelled(M.score(model, tested)).select("actual_label", "predicted_probability")
            scored.write.parquet(f"{scores}/point={i}/block={k}")

    with ThreadPoolExecutor(parallelism) as pool:
        list(pool.map(fit_and_score, [(same, k) for same in runs_of(candidate, points) for k in FOLDS]))
    kind = "actual_label int, predicted_probability double, point int, block int"
    best, area = rate_points(spark.read.schema(kind).parquet(scores), len(FOLDS))
    return points[best], area


def runs_of(candidate: M.Candidate, points: list[dict]) -> list[list[int]]:
    """The points that one run of fits serves: those that differ in the number of boosting rounds alone, else each its own."""
    if not candidate.early_stop:
        return [[i] for i in range(len(points))]
    together: dict[str, list[int]] = {}
    for i, point in enumerate(points):
        together.setdefault(json.dumps({k: v for k, v in point.items() if k != "n_estimators"}, sort_keys=True), []).append(i)
    return list(together.values())


def rate_points(scores: DataFrame, n_folds: int, times: str | None = None) -> tuple[int, float]:
    """The point with the best mean area over the folds, the first of equals, and that mean."""
    areas = metrics.rank_metrics(scores, ["point", "block"], times=times)
    rated = areas.groupBy("point").agg(F.avg("auc_roc").alias("cv_auc"))
    best = rated.orderBy(F.desc("cv_auc"), "point").first()
    return best["point"], best["cv_auc"]


def search_models(candidate: M.Candidate, points: list[dict], blocks: DataFrame, cols: list[str] | None = None) -> dict[int, list]:
    """Per fold the models of all points, fitted together on the blocks before it."""
    fitted = candidate.fit_many(blocks, "block", cols or schemas.FEATURES, [(p, list(range(k))) for k in FOLDS for p in points])
    return {k: fitted[(k - 1) * len(points) : k * len(points)] for k in FOLDS}


def search_scores(
    candidate: M.Candidate, points: list[dict], blocks: DataFrame, cols: list[str] | None = None, times: str | None = None
) -> DataFrame:
    """``block, point, actual_label, predicted_probability`` of every test row under every point. With ``times`` that column
    says how many rows one stands for: the searches of some families merge those that are alike."""
    if candidate.score_many is not None:
        tasks = [(i, p, list(range(k)), k) for k in FOLDS for i, p in enumerate(points)]
        found = candidate.score_many(blocks, "block", cols or schemas.FEATURES, tasks, **({"times": times} if times else {}))
        return _labelled(found).select("block", "actual_label", "point", "predicted_probability", *([times] if times else []))
    scored = additive.held_out(blocks, "block", search_models(candidate, points, blocks, cols))
    alone = [F.lit(1).cast("bigint").alias(times)] if times else []
    return _labelled(scored).select("block", "actual_label", F.posexplode("scores").alias("point", "predicted_probability"), *alone)


def calibrated_cv(candidate: M.Candidate, params: dict, blocks: DataFrame, val: DataFrame | None, n: int) -> DataFrame:
    """Test metrics of the calibrated model on every expanding fold."""
    folds, candidate = [], M.stopped_by(candidate, val)
    if candidate.fit_many is not None:
        # A row learns in all later folds: one copy for each, so that all folds are calibrated together.
        learnt = blocks.where(F.col("block") < len(FOLDS))
        copies = learnt.withColumn("fold", F.explode(F.sequence(F.col("block") + 1, F.lit(len(FOLDS)))))
        for k, model in M.calibrate_many(candidate, params, copies, schemas.FEATURES, list(FOLDS)).items():
            folds.append(_labelled(model.predict(M.dealt_out(blocks.where(F.col("block") == k)))))
    for k in FOLDS if candidate.fit_many is None else ():
        train = blocks.where(F.col("block") < k).drop("block")
        size = fold_size(n, k) * 2 // 3  # two of three calibration parts
        model = M.calibrate(lambda part: M.fit_one(candidate, params, size, part, val), train)
        folds.append(_labelled(model.predict(blocks.where(F.col("block") == k))))
    scored = _union(folds).select("block", "actual_label", "predicted_label", "predicted_probability")
    return metrics.evaluate(materialise(scored, "folds"), ["block"])


@dataclass
class Training:
    predictions: DataFrame  # model, address, split, labels and probability
    fitted: dict[str, M.CalibratedModel]
    parameters: dict[str, dict]
    cv: DataFrame | None  # model, fold and its metrics
    info: DataFrame  # model, position, cv_auc, train_time_sec
    fit_plain: Callable[[str], PipelineModel | additive.Additive]  # the uncalibrated model on all training rows, for attribution


@dataclass
class Prepared:
    """The written tables that all families are trained on."""

    rows: DataFrame
    train: DataFrame
    val: DataFrame | None
    blocks: DataFrame
    n: int
    pieces: int


def prepare(model_input: DataFrame, rows_per_partition: int = ROWS_PER_PARTITION) -> Prepared:
    """Assemble, split and block the rows once.

    A table without ``split`` needs ``is_train``: the last fifth of its training rows is for validation. Without a label
    the risk-adjusted return decides.
    """
    if "split" not in model_input.columns:
        model_input = labels.legacy_split(model_input)
    if schemas.LABEL not in model_input.columns:
        marked = model_input.withColumn("is_train", F.col("split") == "train")
        model_input = labels.rar_labels(marked)
    rows = materialise(M.assemble_features(model_input), "assembled")
    train, val = materialise(rows.where("split = 'train'"), "train"), rows.where("split = 'val'")
    n = train.count()
    # Every boosting round and every optimiser step is a job: small tables run best in few partitions.
    pieces = max(1, n // rows_per_partition)
    train, val = train.coalesce(pieces), val.coalesce(pieces)
    blocks = materialise(M.expanding_blocks(train), "blocks").coalesce(pieces)
    return Prepared(rows, train, val if val.limit(1).count() > 0 else None, blocks, n, pieces)


def fold_metrics(prepared: Prepared, name: str, candidate: M.Candidate, params: dict) -> DataFrame:
    """``model``, fold and its test metrics, for chosen parameters."""
    val = prepared.val if candidate.early_stop else None
    return calibrated_cv(candidate, params, prepared.blocks, val, prepared.n).select(F.lit(name).alias("model"), "*")


def fit_searched(prepared: Prepared, candidate: M.Candidate, params: dict) -> PipelineModel | additive.Additive:
    """The uncalibrated model on all training rows."""
    candidate = M.stopped_by(candidate, prepared.val)
    if candidate.fit_many is not None:
        return candidate.fit_many(prepared.train.withColumn("_all", F.lit(0)), "_all", schemas.FEATURES, [(params, [0])])[0]
    return M.fit_one(candidate, params, prepared.n, prepared.train, prepared.val if candidate.early_stop else None)


def train_family(
    prepared: Prepared, name: str, candidate: M.Candidate, position: int = 0, parallelism: int = 8, detailed_cv: bool = True,
    found: tuple[dict, float] | None = None,
) -> Training:
    """Search, calibrate and score one family of models. ``found``: parameters and area of a search already run.

    Class weights come from the rows of each fit: a fold knows nothing of later blocks.
    """
    train, blocks, n, pieces = prepared.train, prepared.blocks, prepared.n, prepared.pieces
    started = time.time()
    extra = prepared.val if candidate.early_stop else None
    params, cv_auc = found or search(candidate, blocks, extra, n, parallelism)
    if candidate.fit_many is not None:
        model = M.calibrate_many(M.stopped_by(candidate, extra), params, train.withColumn("fold", F.lit(0)), schemas.FEATURES, [0])[0]
    else:
        model = M.calibrate(lambda part: M.fit_one(candidate, params, n * 2 // 3, part, extra), train, pieces=pieces)
    elapsed = time.time() - started
    scored = _labelled(model.predict(M.dealt_out(prepared.rows))).select(
        F.lit(name).alias("model"), "address", "split", "actual_label", "predicted_label", "predicted_probability"
    )
    predictions = materialise(scored, "predictions")
    cv = fold_metrics(prepared, name, candidate, params) if detailed_cv else None
    info = train.sparkSession.createDataFrame(
        [(name, position, float(cv_auc), float(elapsed))], "model string, position int, cv_auc double, train_time_sec double"
    )

    return Training(predictions, {name: model}, {name: params}, cv, info, lambda _: fit_searched(prepared, candidate, params))


def together(families: list[Training]) -> Training:
    """The runs of several families as one."""
    owner = {name: run for run in families for name in run.fitted}
    cv = [run.cv for run in families if run.cv is not None]
    return Training(
        _union([run.predictions for run in families]),
        {name: run.fitted[name] for name, run in owner.items()},
        {name: run.parameters[name] for name, run in owner.items()},
        _union(cv) if cv else None,
        _union([run.info for run in families]),
        lambda name: owner[name].fit_plain(name),
    )


def train_all(
    model_input: DataFrame, candidates: dict[str, M.Candidate] | None = None, parallelism: int = 8,
    detailed_cv: bool = True, rows_per_partition: int = ROWS_PER_PARTITION,
) -> Training:
    """Search, calibrate and score every candidate. Fits run on the executors; the driver only loops over settings."""
    prepared = prepare(model_input, rows_per_partition)
    families = (candidates or M.CANDIDATES).items()
    return together([train_family(prepared, name, c, k, parallelism, detailed_cv) for k, (name, c) in enumerate(families)])


def cv_results(training: Training) -> DataFrame:
    """Mean and deviation of the fold metrics per model (deviation over the folds as a whole)."""
    return training.cv.groupBy("model").agg(
        F.avg("accuracy").alias("accuracy_mean"), F.stddev_pop("accuracy").alias("accuracy_std"),
        F.avg("auc_roc").alias("auc_mean"), F.stddev_pop("auc_roc").alias("auc_std"),
        F.avg("f1").alias("f1_mean"), F.stddev_pop("f1").alias("f1_std"),
        F.avg("precision").alias("precision_mean"), F.avg("recall").alias("recall_mean"),
    )


def model_comparison(training: Training) -> DataFrame:
    """Ten test metrics per model."""
    tested = metrics.evaluate(training.predictions.where("split = 'test'"), ["model"])
    # One row per model: tiny by construction.
    return tested.join(F.broadcast(training.info), "model").select(
        "model", "accuracy", "precision", "recall", "f1", "auc_roc", "avg_precision", "log_loss", "brier_score",
        "cv_auc", "train_time_sec", "position",
    )


def select_best(comparison: DataFrame) -> DataFrame:
    """The model with the largest area under the curve; the first of equals."""
    return comparison.orderBy(F.desc("auc_roc"), "position").limit(1)


def mcnemar_tests(training: Training) -> DataFrame:
    tested = training.predictions.where("split = 'test'")
    return metrics.mcnemar_pairs({name: tested.where(F.col("model") == name) for name in training.fitted})


def overfit_flags(training: Training) -> DataFrame:
    return metrics.overfit_flags(training.predictions, ["model"])


def training_report(training: Training) -> DataFrame:
    """One row per model: chosen parameters as JSON, test metrics, the areas on training and validation rows with both
    overfit flags, the fold means where folds were run, and for all the same the row counts and the features."""
    spark = training.predictions.sparkSession
    chosen = [(name, json.dumps(params, sort_keys=True)) for name, params in training.parameters.items()]
    # One row per model: tiny by construction.
    parameters = F.broadcast(spark.createDataFrame(chosen, "model string, parameters string"))
    flags = overfit_flags(training)
    flags = flags.select("model", *[c for c in flags.columns if c.startswith(("train_", "val_", "overfit"))])
    first = training.predictions.where(F.col("model") == chosen[0][0])
    counts = first.agg(*[F.count_if(F.col("split") == part).alias(f"n_{part}") for part in ("train", "val", "test")])
    report = model_comparison(training).join(parameters, "model").join(F.broadcast(flags), "model")
    report = cross_scalar(report, counts).withColumn("feature_columns", F.array(*[F.lit(c) for c in schemas.FEATURES]))
    return report if training.cv is None else report.join(F.broadcast(cv_results(training)), "model", "left")


def write_report(training: Training, path: str) -> None:
    """The report, the model pairs and the fold metrics as JSON tables below ``path``."""
    write_metrics_json(training_report(training), f"{path}/training_report")
    write_metrics_json(mcnemar_tests(training), f"{path}/mcnemar")
    if training.cv is not None:
        write_metrics_json(training.cv, f"{path}/cv_folds")


def export_predictions(training: Training, name: str) -> DataFrame:
    """Test predictions of one model in the exported shape, the surest first."""
    rows = training.predictions.where((F.col("split") == "test") & (F.col("model") == name))
    return rows.select("address", "predicted_label", "predicted_probability", "actual_label").orderBy(
        F.desc("predicted_probability"), "address"
    )


def save_best(training: Training, path: str) -> str:
    """Save the best model and its metadata; returns the model's name."""
    best = select_best(model_comparison(training))
    name = best.first()["model"]
    training.fitted[name].save(f"{path}/best_model")
    features = F.array(*[F.lit(c) for c in schemas.FEATURES]).alias("feature_columns")
    meta = best.select(F.col("model").alias("model_name"), "auc_roc", "accuracy", "f1", features)
    write_metrics_json(meta, f"{path}/model_metadata")
    return name


def load_best(path: str) -> M.CalibratedModel:
    return M.CalibratedModel.load(f"{path}/best_model")
