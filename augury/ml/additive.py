"""Classifiers whose fits are sums over rows, fitted for many folds and settings at once.

Rows carry a group number (a block, a part). A task names its settings and the groups it learns from. Counts, means and
squared deviations of each group and class are computed once; those of any set of groups are merged from them, which
gives the scaling, the class weights and the whole of a Gaussian naive Bayes fit. Logistic regression takes Newton
steps: one job adds up loss, gradient and curvature of all tasks at their present coefficients, so the number of jobs is
that of the slowest task's steps, however many tasks there are. Nothing but these sums reaches the driver.
"""

from __future__ import annotations

import itertools
import json
from collections.abc import Iterable
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField

Task = tuple[dict, list[int]]  # settings, groups learnt from

SMOOTHING = 1e-9  # of the largest variance of a feature, added to all variances of naive Bayes
TOLERANCE = 1e-10  # of the mean gradient
MOST_STEPS = 100
CLOSE = 16.0  # deviations between means, and ratio of deviations, of sets of rows that share a scaling


@dataclass
class Moments:
    """Rows, means and sums of squared deviations."""

    n: float
    mean: np.ndarray
    squares: np.ndarray

    def __add__(self, other: "Moments") -> "Moments":
        n = self.n + other.n
        if not self.n or not other.n:
            return self if self.n else other
        gap = other.mean - self.mean
        return Moments(n, self.mean + gap * (other.n / n), self.squares + other.squares + gap * gap * (self.n * other.n / n))


def moments(rows: DataFrame, group: str, cols: list[str], label: str = "label") -> DataFrame:
    """``group, label, n, means, squares`` of every group and class, in one aggregate."""
    parts = rows.groupBy(F.col(group).alias("group"), F.col(label).cast("int").alias("label")).agg(
        F.count("*").alias("n"), F.array(*[F.avg(c) for c in cols]).alias("means"), F.array(*[F.var_pop(c) for c in cols]).alias("_v")
    )
    return parts.withColumn("squares", F.transform("_v", lambda v: v * F.col("n"))).drop("_v")


def collected(rows: DataFrame, group: str, cols: list[str], label: str = "label") -> dict[tuple[int, int], Moments]:
    """The moments by (group, class): two rows for each group."""
    return {(r["group"], r["label"]): Moments(r["n"], np.array(r["means"]), np.array(r["squares"])) for r in moments(rows, group, cols, label).collect()}


def merged(table: dict[tuple[int, int], Moments], groups: Iterable[int], classes: tuple[int, ...] = (0, 1)) -> Moments:
    wanted = set(groups)
    width = len(next(iter(table.values())).mean) if table else 0
    out = Moments(0, np.zeros(width), np.zeros(width))
    for key in sorted(table):
        if key[0] in wanted and key[1] in classes:
            out = out + table[key]
    return out


@dataclass(frozen=True)
class Additive:
    """A fitted model: log odds as a sum of one term for each feature."""

    kind: str
    cols: list[str]
    values: dict[str, list[float]] = field(hash=False)

    def log_odds(self) -> Column:
        """Intercept + sum of linear terms on scaled values, or of differences of two log densities."""
        v, total = self.values, F.lit(self.values["intercept"][0])
        for j, c in enumerate(self.cols):
            x = F.col(c).cast("double")
            if self.kind == "logistic":
                term = (x - v["mean"][j]) * v["raw"][j]
            else:
                gap = [(x - v[f"mean{k}"][j]) * (x - v[f"mean{k}"][j]) / (2 * v[f"var{k}"][j]) for k in (0, 1)]
                term = gap[0] - gap[1]
            total = total + term
        return total

    def probability(self) -> Column:
        return 1 / (1 + F.exp(-self.log_odds()))

    def odds_of(self, x: np.ndarray) -> np.ndarray:
        """As ``log_odds``, of a matrix with one column for each feature."""
        v = {k: np.array(a) for k, a in self.values.items()}
        if self.kind == "logistic":
            return v["intercept"][0] + (x - v["mean"]) @ v["raw"]
        return v["intercept"][0] + ((x - v["mean0"]) ** 2 / (2 * v["var0"]) - (x - v["mean1"]) ** 2 / (2 * v["var1"])).sum(1)

    def scores_of(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.odds_of(x), -700, 700)))

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame([(json.dumps(asdict(self)),)], "value string").coalesce(1).write.mode("overwrite").text(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> "Additive":
        return Additive(**json.loads(spark.read.text(path).first()[0]))


def naive_bayes_of(table: dict[tuple[int, int], Moments], groups: Iterable[int], cols: list[str]) -> Additive:
    """Gaussian naive Bayes from moments, as on scaled features: variances get a part of the largest scaled one added."""
    groups = list(groups)
    whole, parts = merged(table, groups), [merged(table, groups, (k,)) for k in (0, 1)]
    if not all(p.n for p in parts):  # one class alone: its share decides
        share = 0.0 if not whole.n else (1e9 if parts[1].n else -1e9)
        flat = {f"{a}{k}": [float(a == "var")] * len(cols) for a in ("mean", "var") for k in (0, 1)}
        return Additive("naive_bayes", list(cols), {"intercept": [share], **flat})
    scale = whole.squares / max(1.0, whole.n - 1)
    live = scale > 0
    added = SMOOTHING * (whole.n - 1) / whole.n * np.where(live, scale, 1.0)  # scaled features all have one variance
    var = [np.where(live, p.squares / p.n + added, 1.0) for p in parts]
    mean = [np.where(live, p.mean, 0.0) for p in parts]  # a constant feature says the same of both classes
    intercept = np.log(parts[1].n) - np.log(parts[0].n) - 0.5 * float((np.log(var[1]) - np.log(var[0])).sum())
    return Additive("naive_bayes", list(cols), {"intercept": [float(intercept)], **{f"{a}{k}": x[k].tolist() for a, x in (("mean", mean), ("var", var)) for k in (0, 1)}})


def fit_naive_bayes(rows: DataFrame, group: str, cols: list[str], tasks: list[Task]) -> list[Additive]:
    """All tasks from one pass over the rows."""
    table = collected(rows, group, cols)
    return [naive_bayes_of(table, groups, cols) for _, groups in tasks]


@dataclass
class Step:
    """A Newton run of one task."""

    at: np.ndarray  # coefficients tried next, the intercept first
    best: np.ndarray | None = None
    move: np.ndarray | None = None
    loss: float = np.inf
    done: bool = False

    def take(self, loss: float, gradient: np.ndarray, curvature: np.ndarray, n: float) -> None:
        """Go on from what was found at ``at``: half the move where the loss has grown, else the next Newton step."""
        if loss > self.loss + 1e-12 * abs(self.loss) and self.move is not None:
            self.move = self.move / 2
            self.done = bool(np.abs(self.move).max() < 1e-14)
        else:
            self.best, self.loss = self.at, loss
            self.done = bool(np.abs(gradient).max() <= TOLERANCE * n)
            self.move = -np.linalg.lstsq(curvature, gradient, rcond=None)[0]
        self.at = self.best if self.done else self.best + self.move


def sums(rows: DataFrame, group: str, cols: list[str], scales: list[tuple[list[int], np.ndarray, np.ndarray, tuple[float, float]]], betas: list[tuple[int, np.ndarray]]) -> dict[int, np.ndarray]:
    """Per task: loss, gradient and curvature of the weighted logistic loss, added up in Spark.

    ``scales``: groups, means, factors and class weights of each set of groups; ``betas``: number of its set and
    coefficients of each task.
    """
    width = len(cols) + 1
    most = max([g for groups, *_ in scales for g in groups], default=0) + 1
    inside = np.zeros((len(scales), most + 1), bool)  # the last column stands for groups of no set
    for k, (groups, *_) in enumerate(scales):
        inside[k, groups] = True
    size = 1 + width + width * width
    set_of = np.array([k for k, _ in betas])
    class_weights = np.array([scales[k][3] for k in set_of])
    # Sets of about the same scaling share that of the first of them, of which their own is a linear map: the products of
    # features then serve all their tasks.
    lead, maps = np.arange(len(scales)), np.zeros((len(scales), width, width))
    for k, (_, mean, factor, _) in enumerate(scales):
        live = factor > 0
        for f in range(k):
            _, centre, spread, _ = scales[f]
            near = (np.abs(centre - mean) * factor <= CLOSE) & (factor <= CLOSE * spread) & (spread <= CLOSE * factor)
            if lead[f] == f and near[live].all():
                lead[k] = f
                break
        _, centre, spread, _ = scales[lead[k]]
        maps[k, 0, 0] = 1.0
        maps[k, 1:, 0] = (centre - mean) * factor
        maps[k][np.arange(1, width), np.arange(1, width)] = np.divide(factor, spread, out=np.zeros_like(factor), where=live)
    at = np.stack([maps[k].T @ beta for k, beta in betas], 1)
    first, second = np.triu_indices(width)
    starts = np.searchsorted(first, np.arange(width))

    def work(batches):
        loss, gradient, bends = np.zeros(len(betas)), np.zeros((width, len(betas))), np.zeros((len(first), len(betas)))
        for batch in batches:
            raw = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in range(len(cols))], 1)
            label, number = (batch.column(len(cols) + k).to_numpy(zero_copy_only=False) for k in (0, 1))
            number = np.where((number >= 0) & (number < most), number, most).astype(np.int64)
            for g, f in itertools.product(np.unique(number), np.unique(lead)):
                own = np.flatnonzero(inside[set_of, g] & (lead[set_of] == f))
                if not len(own):
                    continue
                here, (_, centre, spread, _) = number == g, scales[f]
                x = np.ones((int(here.sum()), width))
                x[:, 1:] = (raw[here] - centre) * spread
                y = label[here][:, None]
                w = np.where(y == 1, class_weights[own, 1], class_weights[own, 0])
                z = x @ at[:, own]
                e = np.exp(-np.abs(z))
                p = np.where(z >= 0, 1.0, e) / (1 + e)
                loss[own] += (w * (np.log1p(e) + np.maximum(z, 0) - y * z)).sum(0)
                gradient[:, own] += x.T @ (w * (p - y))
                across, products = np.ascontiguousarray(x.T), np.empty((len(first), len(x)))
                for c in range(width):
                    np.multiply(across[c:], across[c], out=products[starts[c] : starts[c] + width - c])
                bends[:, own] += products @ (w * p * (1 - p))
        total = np.zeros((len(betas), size))
        for i, k in enumerate(set_of):
            bend = np.zeros((width, width))
            bend[first, second] = bend[second, first] = bends[:, i]
            total[i] = np.r_[loss[i], maps[k] @ gradient[:, i], (maps[k] @ bend @ maps[k].T).ravel()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.arange(len(betas)), size)), pa.array(np.tile(np.arange(size), len(betas))), pa.array(total.ravel())], names=["task", "at", "part"]
        )

    narrow = rows.select(*[F.col(c).cast("double").alias(f"_{j}") for j, c in enumerate(cols)], F.col("label").cast("double").alias("_y"), F.col(group).cast("int").alias("_g"))
    parts = narrow.mapInArrow(work, "task bigint, at bigint, part double").groupBy("task", "at").agg(F.sum("part").alias("part")).toPandas()
    out = np.zeros((len(betas), size))
    out[parts["task"], parts["at"]] = parts["part"]
    return dict(enumerate(out))


def fit_logistic(rows: DataFrame, group: str, cols: list[str], tasks: list[Task]) -> list[Additive]:
    """L2 logistic regression on scaled features with balanced class weights, for all tasks side by side.

    A task minimises sum(weight * loss) + |coefficients|^2 / (2 C); the intercept is free.
    """
    table, width = collected(rows, group, cols), len(cols) + 1
    sets = sorted({tuple(sorted(groups)) for _, groups in tasks})
    scales = []
    for groups in sets:
        whole, (n0, n1) = merged(table, groups), [merged(table, groups, (k,)).n for k in (0, 1)]
        std = np.sqrt(whole.squares / max(1.0, whole.n - 1))
        factor = np.divide(1.0, std, out=np.zeros_like(std), where=std > 0)
        scales.append((list(groups), whole.mean, factor, tuple(whole.n / (2.0 * n) if n else 1.0 for n in (n0, n1))))
    set_of = [sets.index(tuple(sorted(groups))) for _, groups in tasks]
    sizes = [merged(table, groups).n for _, groups in tasks]
    pull = [np.r_[0.0, np.full(width - 1, 1.0 / params.get("C", 1.0))] for params, _ in tasks]
    runs = [Step(np.zeros(width)) for _ in tasks]
    for _ in range(MOST_STEPS):
        going = [i for i, r in enumerate(runs) if not r.done]
        if not going:
            break
        found = sums(rows, group, cols, scales, [(set_of[i], runs[i].at) for i in going])
        for k, i in enumerate(going):
            s, beta = found[k], runs[i].at
            loss = float(s[0] + 0.5 * (pull[i] * beta * beta).sum())
            runs[i].take(loss, s[1 : 1 + width] + pull[i] * beta, s[1 + width :].reshape(width, width) + np.diag(pull[i]), max(1.0, sizes[i]))
    out = []
    for run, k in zip(runs, set_of):
        _, mean, factor, _ = scales[k]
        beta = run.best if run.best is not None else run.at
        values = {"intercept": [float(beta[0])], "scaled": beta[1:].tolist(), "mean": mean.tolist(), "raw": (beta[1:] * factor).tolist()}
        out.append(Additive("logistic", list(cols), values))
    return out


def held_out(rows: DataFrame, group: str, models: dict[int, list[Additive]], keep: tuple[str, ...] = ("label",)) -> DataFrame:
    """``group``, ``keep`` and ``scores``: the probabilities of each row of group g by the models of g, in one pass of matrix
    products; rows of other groups are left out."""
    cols = next(iter(models.values()))[0].cols
    own = rows.where(F.col(group).isin(list(models))).select(F.col(group).cast("int").alias(group), *keep, *[F.col(c).cast("double").alias(f"_x{j}") for j, c in enumerate(cols)])
    schema = own.select(group, *keep).schema.add(StructField("scores", ArrayType(DoubleType())))

    def work(batches):
        for batch in batches:
            x = np.stack([batch.column(batch.num_columns - len(cols) + j).to_numpy(zero_copy_only=False) for j in range(len(cols))], 1)
            number = batch.column(0).to_numpy(zero_copy_only=False)
            scores: list = [None] * batch.num_rows
            for g, fitted in models.items():
                here = np.flatnonzero(number == g)
                if len(here):
                    found = np.stack([m.scores_of(x[here]) for m in fitted], 1)
                    for i, row in zip(here.tolist(), found.tolist()):
                        scores[i] = row
            yield pa.RecordBatch.from_arrays([*batch.columns[: 1 + len(keep)], pa.array(scores, pa.list_(pa.float64()))], names=schema.names)

    return own.mapInArrow(work, schema)


def gradients(rows: DataFrame, fitted: dict[tuple[int, ...], list[tuple[Additive, float]]], group: str, label: str = "label") -> DataFrame:
    """``groups, c, feature, n, gradient``: the mean gradient of the penalised loss at fitted coefficients, in DataFrame
    functions alone; zero for a converged fit. ``fitted``: per set of groups, models and their C. ``groups`` is the
    largest group number of the set."""
    parts = []
    for groups, models in fitted.items():
        own = rows.where(F.col(group).isin(list(groups)))
        counts = own.agg(F.count("*").alias("_n"), F.count_if(F.col(label) == 1).alias("_pos"))
        own = own.crossJoin(F.broadcast(counts))
        weight = F.col("_n") / (2 * F.when(F.col(label) == 1, F.col("_pos")).otherwise(F.col("_n") - F.col("_pos")))
        terms = []
        for model, strength in models:
            error, v = weight * (model.probability() - F.col(label)), model.values
            terms.append(("intercept", strength, F.avg(error)))
            for j, c in enumerate(model.cols):
                factor = v["raw"][j] / v["scaled"][j] if v["scaled"][j] else 0.0
                terms.append((c, strength, F.avg(error * (F.col(c) - v["mean"][j]) * factor) + v["scaled"][j] / strength / F.count("*")))
        wide = own.agg(F.count("*").alias("n"), *[t.alias(f"_{k}") for k, (_, _, t) in enumerate(terms)])
        cells = [F.struct(F.lit(max(groups)).alias("groups"), F.lit(s).alias("c"), F.lit(c).alias("feature"), F.col("n"), F.col(f"_{k}").alias("gradient")) for k, (c, s, _) in enumerate(terms)]
        parts.append(wide.select(F.inline(F.array(*cells))))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
