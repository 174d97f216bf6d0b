"""Boosted trees of many settings and folds, grown from one table of counted cells (see ``forests``).

A round fits a tree to the log loss: splits by gradients and curvatures summed in bins, leaf values by a Newton step with a
ridge of ``RIDGE``. Positives weigh negatives / positives of the rows learnt from. The smallest sum of curvatures of a leaf,
the shares of rows and features that a tree sees, its depth and the step are settings. All start from even odds. Rounds
end once ``PATIENCE`` in a row bring no gain in the unweighted log loss of the validation rows. Settings that differ in the
number of rounds alone share a run, as a run's first rounds don't depend on how many follow.

Gradients, leaf values and losses are whole numbers of small units and draws are hashes of cells, so a tree doesn't depend
on the order or the partitions of the rows. A run whose cells fit a task grows there as a whole, a few runs a task. Runs of
more cells than ``limit`` grow side by side, one job a level for all of them, by histograms that Spark adds up. In a search
the held-out cells are sent along and no tree is kept.
"""

from __future__ import annotations

import functools
import json
import math
from collections.abc import Iterable
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.functions import pandas_udf

from augury.ml.additive import Task
from augury.ml.forests import (
    BINS, ROOT, Cells, Tree, _heaps, _limit, _read, _rows_of, binned, cell_keys, cells_of, cells_table, dealt_cells,
    drawn, feature_order, tree_seed,
)
from augury.session import materialise, remove

UNIT, STEP, LOSS = 1 << 20, 1 << 24, 1 << 30  # whole numbers stand for such parts of gradients, leaf values and losses
LARGEST = 100  # of a leaf value
RIDGE, GAIN = 1.0, 1e-6
PATIENCE = 15  # fixed value: rounds without a gain on the validation rows after which boosting stops
TOGETHER, MANY = 4, 125_000  # runs grown by one task at most: one more for each so many cells, which are sent once for them
REFRESH = 32  # rounds after which margins of large runs are written
VAL = -1  # group of the validation rows


def rounds_kept(losses: list[float], limit: int, patience: int = PATIENCE) -> tuple[int, bool]:
    """The rounds up to the best one before ``patience`` in a row bring no gain, and whether more rounds could change that."""
    best = 0
    for i, loss in enumerate(losses[:limit]):
        if loss < losses[best]:
            best = i
        elif i - best >= patience:
            return best + 1, False
    return best + 1, len(losses) < limit


@dataclass(frozen=True)
class Run:
    """Trees that serve several tasks."""

    groups: tuple[int, ...]
    depth: int
    rate: float
    subsample: float
    columns: float
    leaf: float  # least sum of curvatures
    rounds: tuple[int, ...]  # that are asked for
    positive: float  # weight of the positives


def runs_of(tasks: list[Task], counts: dict[tuple[int, int], int]) -> tuple[list[Run], list[int]]:
    """The runs that serve all tasks, and the run of each task. ``counts``: rows by (group, class)."""
    alone = []
    for p, groups in tasks:
        n0, n1 = (sum(counts.get((g, k), 0) for g in set(groups)) for k in (0, 1))
        alone.append(Run(
            tuple(sorted(set(groups))), p.get("max_depth", 5), p.get("learning_rate", 0.1), p.get("subsample", 1.0),
            p.get("colsample_bytree", 1.0), p.get("min_child_weight", 1), (), n0 / n1 if n1 else 1.0,
        ))
    places = list(dict.fromkeys(alone))
    asked = [tuple(sorted({p.get("n_estimators", 100) for (p, _), own in zip(tasks, alone) if own == run})) for run in places]
    return [replace(run, rounds=n) for run, n in zip(places, asked)], [places.index(run) for run in alone]


# ---------------------------------------------------------------- one round


@functools.cache
def binomial_steps(share: float, power: int) -> tuple[int, np.ndarray]:
    """The least value, and the chances of at most that and each further value, of 2 ** power draws of ``share``."""
    n, wide = 1 << power, int(10 * (share * (1 - share) * 2**power) ** 0.5) + 20
    first, last = max(0, int(n * share) - wide), min(n, int(n * share) + wide)
    ways = [math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) for k in range(first, last + 1)]
    upto = np.cumsum([math.exp(w + k * math.log(share) + (n - k) * math.log1p(-share)) for k, w in zip(range(first, last + 1), ways)])
    return first, upto / upto[-1]


def sampled(keys: np.ndarray, copies: np.ndarray, tree: int, run: Run) -> np.ndarray:
    """The rows of each cell that a tree sees."""
    return copies if run.subsample >= 1 else drawn(keys, copies, tree_seed(tree), functools.partial(binomial_steps, run.subsample))


def features_of(tree: int, run: Run, width: int) -> np.ndarray:
    return np.sort(feature_order(np.array([ROOT]), tree, width)[0][: max(1, int(run.columns * width + 1e-9))])


def slopes(margin: np.ndarray, label: np.ndarray, run: Run) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and curvature of the weighted log loss of one row of each cell."""
    p = 1 / (1 + np.exp(-np.clip(margin / STEP, -500, 500)))
    weight = np.where(label == 1, run.positive, 1.0) * UNIT
    return np.rint(weight * (p - label)), np.rint(weight * (p * (1 - p)))


def loss_of(margin: np.ndarray, label: np.ndarray, copies: np.ndarray) -> int:
    """The log loss of all rows together."""
    return int((np.rint(np.logaddexp(0, -np.clip(margin / STEP, -500, 500) * (2 * label - 1)) * LOSS).astype(np.int64) * copies).sum())


def leaf_values(g: np.ndarray, h: np.ndarray, run: Run) -> np.ndarray:
    step = -g / (h + RIDGE * UNIT) * run.rate
    return np.rint(np.clip(step, -LARGEST, LARGEST) * STEP).astype(np.int32)


def splits_of(hist: np.ndarray, run: Run) -> tuple[np.ndarray, np.ndarray]:
    """Per node the place of the best feature (-1: no split gains) and its last bin on the left, the first of equals.
    ``hist``: gradients and curvatures by (node, feature, bin)."""
    g, h = hist.cumsum(3)

    def part(a, b):
        return a * a / (b + RIDGE * UNIT)

    other = h[..., -1:] - h
    gain = part(g, h)
    gain += part(g[..., -1:] - g, other)
    gain[(h < run.leaf * UNIT) | (other < run.leaf * UNIT) | (h <= 0) | (other <= 0)] = -np.inf
    gain = gain.reshape(len(gain), -1)
    best = gain.argmax(1)
    good = gain[np.arange(len(gain)), best] - part(g[:, 0, -1], h[:, 0, -1]) > GAIN * UNIT
    return np.where(good, best // BINS, -1), best % BINS


def grow(cell: np.ndarray, g: np.ndarray, h: np.ndarray, run: Run, features: np.ndarray) -> tuple[Tree, np.ndarray]:
    """One tree, and its value for each cell. ``cell``: bins by (feature, cell); ``g``, ``h``: sums over the rows of a cell."""

    def histogram(rows, spot, n):
        base, out, a, b = spot * BINS, np.empty((2, n, len(features), BINS)), g[rows], h[rows]
        for j, f in enumerate(features):
            at = base + cell[f][rows]
            out[0, :, j] = np.bincount(at, a, n * BINS).reshape(n, BINS)
            out[1, :, j] = np.bincount(at, b, n * BINS).reshape(n, BINS)
        return out

    rows, at, heaps = np.arange(len(g)), np.zeros(len(g), np.int64), np.array([ROOT], np.int64)
    hist, step, nodes = histogram(slice(None), at, 1), np.zeros(len(g), np.int32), []
    for level in range(run.depth + 1):
        last = level == run.depth
        total = np.stack([np.bincount(at, x[rows], len(heaps)) for x in (g, h)]) if last else hist[:, :, 0].sum(2)
        value = leaf_values(*total, run)
        place, cut = (np.full(len(heaps), -1), np.zeros(len(heaps), np.int64)) if last else splits_of(hist, run)
        feature = np.where(place >= 0, features[place], -1)
        nodes.append((heaps, feature, cut, value))
        ends = (place < 0)[at]
        step[rows[ends]] = value[at[ends]]
        going = np.flatnonzero(place >= 0)
        if not len(going):
            break
        number = np.full(len(heaps), -1)
        number[going] = np.arange(len(going))
        rows, spot = rows[~ends], number[at[~ends]]
        right = cell[feature[going][spot], rows] > cut[going][spot]
        at = 2 * spot + right
        heaps = np.stack([2 * heaps[going], 2 * heaps[going] + 1], 1).ravel()
        if level + 1 < run.depth:
            # One child is counted, the one of fewer cells; the other is what is left of the parent.
            sizes = np.bincount(at, minlength=len(heaps)).reshape(-1, 2)
            fewer = sizes[:, 1] < sizes[:, 0]
            own = np.flatnonzero(right == fewer[spot])
            part = histogram(rows[own], spot[own], len(going))
            both = np.stack([part, hist[:, going] - part])
            order = fewer.astype(np.int64)
            each = np.arange(len(going))
            hist = np.stack([both[order, :, each], both[1 - order, :, each]], 1).reshape(-1, *part.shape[:1], *part.shape[2:]).swapaxes(0, 1)
    return Tree.of(*(np.concatenate(x) for x in zip(*nodes))), step


def values_of(trees: Iterable[Tree], bins: np.ndarray) -> np.ndarray:
    total = np.zeros(len(bins), np.int64)
    for tree in trees:
        total += tree.values(bins, [64])[64]
    return total


def boosted(learnt: tuple[np.ndarray, ...], val: tuple[np.ndarray, ...] | None, run: Run) -> tuple[list[Tree], dict[int, int]]:
    """The trees of a run, and for each number of rounds asked for those that count."""
    bins, label, group, copies = learnt
    keys = cell_keys(bins, label, group)
    bins, label, of = cells_of(bins, label)
    whole = np.bincount(of, copies, len(label))
    cell, margin = np.ascontiguousarray(bins.T), np.zeros(len(label), np.int64)
    if val is not None:
        val_bins, val_label, val_of = cells_of(val[0], val[1])
        val_copies, val_margin = np.bincount(val_of, val[3], len(val_label)).astype(np.int64), np.zeros(len(val_label), np.int64)
    trees, losses, most = [], [], run.rounds[-1]
    for t in range(most):
        seen = whole if run.subsample >= 1 else np.bincount(of, sampled(keys, copies, t, run), len(label))
        g, h = slopes(margin, label, run)
        tree, step = grow(cell, g * seen, h * seen, run, features_of(t, run, len(cell)))
        trees.append(tree)
        margin += step
        if val is not None:
            val_margin += values_of([tree], val_bins)
            losses.append(loss_of(val_margin, val_label, val_copies))
            if ended(losses, most):
                break
    return trees, kept(losses, run) if val is not None else {n: n for n in run.rounds}


def ended(losses: list[int], most: int) -> bool:
    return len(losses) > PATIENCE and min(losses[-PATIENCE:]) >= min(losses[:-PATIENCE]) and not rounds_kept(losses, most)[1]


def kept(losses: list[int], run: Run) -> dict[int, int]:
    return {n: rounds_kept(losses, n)[0] for n in run.rounds}


# ---------------------------------------------------------------- runs above the limit


def boosted_apart(cells: Cells, runs: list[Run], checked: bool) -> list[tuple[list[Tree], dict[int, int]]]:
    """As ``boosted`` for all runs side by side, by sums over all tasks. ``checked``: there are validation rows."""
    width = len(cells.cols)
    trees: list[list[Tree]] = [[] for _ in runs]
    losses: list[list[int]] = [[] for _ in runs]
    open_, start, state, first = list(range(len(runs))), 0, cells.df.withColumn("_f", F.lit(b"")), None

    def margins(batch, start, recent):
        bins, label, group, copies = _read(batch, width)
        before = np.frombuffer(b"".join(batch.column(4).to_pylist()), np.int64)
        margin = before.reshape(-1, len(runs)).T.copy() if len(before) else np.zeros((len(runs), len(label)), np.int64)
        for r, own in recent.items():
            margin[r] += values_of(own, bins)
        return bins, label, group, copies, margin

    def summed(work):
        found = state.mapInArrow(work, "at bigint, part bigint").groupBy("at").agg(F.sum("part").alias("part")).toPandas()
        return dict(zip(found["at"].tolist(), found["part"].tolist()))

    def batch_of(total):
        at = np.flatnonzero(total)
        return pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at].astype(np.int64))], names=["at", "part"])

    t = 0
    while open_:
        recent = {r: trees[r][start:] for r in open_}
        known: dict[int, list[tuple]] = {r: [] for r in open_}
        frontier = [(r, ROOT) for r in open_]
        while frontier:
            place, size = {node: i for i, node in enumerate(frontier)}, width * BINS * 2
            splits = {r: {h: (f, c) for h, f, c, _ in known[r] if f >= 0} for r in dict.fromkeys(r for r, _ in frontier)}

            def histograms(batches, place=place, splits=splits, size=size, start=start, recent=recent, t=t):
                total = np.zeros(len(place) * size)
                for batch in batches:
                    bins, label, group, copies, margin = margins(batch, start, recent)
                    keys = cell_keys(bins, label, group)
                    for r, own in splits.items():
                        inside = np.flatnonzero(np.isin(group, runs[r].groups))
                        seen = sampled(keys[inside], copies[inside], t, runs[r])
                        spot = np.array([place.get((r, h), -1) for h in _heaps(own, bins[inside]).tolist()], np.int64)
                        here = np.flatnonzero(spot >= 0)
                        for k, slope in enumerate(slopes(margin[r][inside], label[inside], runs[r])):
                            for j in range(width):
                                np.add.at(total, spot[here] * size + (k * width + j) * BINS + bins[inside[here], j], (slope * seen)[here])
                yield batch_of(total)

            got = np.zeros(len(frontier) * size)
            for at, part in summed(histograms).items():
                got[at] = part
            following = []
            for (r, heap), hist in zip(frontier, got.reshape(len(frontier), 2, 1, width, BINS)):
                features, total = features_of(t, runs[r], width), hist[:, :, 0].sum(2)
                place_, cut = splits_of(hist[:, :, features], runs[r]) if heap < 1 << runs[r].depth else (np.array([-1]), np.array([0]))
                feature = int(features[place_[0]]) if place_[0] >= 0 else -1
                known[r].append((heap, feature, int(cut[0]), int(leaf_values(*total, runs[r])[0])))
                following += [(r, 2 * heap), (r, 2 * heap + 1)] if feature >= 0 else []
            frontier = following
        for r in open_:
            trees[r].append(Tree.of(*(np.array(x) for x in zip(*known[r]))))
        t += 1
        if checked:
            recent = {r: trees[r][start:] for r in open_}

            def checks(batches, recent=recent, start=start):
                total = np.zeros(len(runs), np.int64)
                for batch in batches:
                    _, label, group, copies, margin = margins(batch, start, recent)
                    own = group == VAL
                    for r in recent:
                        total[r] += loss_of(margin[r][own], label[own], copies[own])
                yield batch_of(total)

            found = summed(checks)
            for r in open_:
                losses[r].append(found.get(r, 0))
        if t - start >= REFRESH:
            recent = {r: trees[r][start:] for r in open_}

            def write(batches, recent=recent, start=start):
                for batch in batches:
                    margin = np.ascontiguousarray(margins(batch, start, recent)[4].T)
                    yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array([m.tobytes() for m in margin], pa.binary())], names=batch.schema.names)

            old, state, start = first, materialise(state.mapInArrow(write, state.schema), "margins"), t
            first = state.inputFiles()[0].rsplit("/", 1)[0]
            if old is not None:
                remove(cells.df.sparkSession, old)
        open_ = [r for r in open_ if t < runs[r].rounds[-1] and not (checked and ended(losses[r], runs[r].rounds[-1]))]
    return [(own, kept(lost, run) if checked else {n: n for n in run.rounds}) for own, lost, run in zip(trees, losses, runs)]


# ---------------------------------------------------------------- fits and searches


def _prepared(rows: DataFrame, group: str, cols: list[str], val: DataFrame | None) -> tuple[Cells, bool]:
    """Cells of the rows and, as those of group ``VAL``, of the validation rows; and whether there are any of these."""
    cells = cells_table(rows, group, cols)
    if val is None:
        return cells, False
    more = cells_table(val.withColumn("_val", F.lit(VAL)), "_val", cols, cells.cuts)
    if not more.sizes:
        return cells, False
    return replace(cells, df=cells.df.unionByName(more.df), counts=cells.counts | more.counts, sizes=cells.sizes | more.sizes), True


def _jobs(cells: Cells, runs: list[Run], asked: list[tuple[int, int | None]]) -> list[tuple[tuple[int, ...], int | None, list[int]]]:
    """Runs on the same rows that one task grows: those of most work are dealt out first."""
    same: dict[tuple, list[int]] = {}
    for i, (r, tested) in enumerate(asked):
        same.setdefault((runs[r].groups, tested), []).append(i)
    jobs = []
    for (groups, tested), own in same.items():
        own.sort(key=lambda i: (-runs[asked[i][0]].rounds[-1] * runs[asked[i][0]].depth, i))
        n = -(-len(own) // min(TOGETHER, 1 + cells.size(groups) // MANY))
        jobs += [(groups, tested, own[k::n]) for k in range(n)]
    return jobs


def _fits(cells: Cells, runs: list[Run], limit: int, also: Iterable[int]) -> list[bool]:
    return [max(cells.size(run.groups), *(cells.size([g]) for g in also), 0) <= limit for run in runs]


def fit_boosted_trees(rows: DataFrame, group: str, cols: list[str], tasks: list[Task], limit: int | None = None, val: DataFrame | None = None) -> list[Boosted]:
    """One model a task; their trees are collected. ``val``: the rows that end the rounds of all of them."""
    cells, checked = _prepared(rows, group, cols, val)
    limit, width = _limit(rows.sparkSession, limit), len(cols)
    runs, run_of = runs_of(tasks, cells.counts)
    fits = _fits(cells, runs, limit, [VAL])
    jobs = _jobs(cells, runs, [(r, None) for r in range(len(runs)) if fits[r]])
    numbers = [r for r in range(len(runs)) if fits[r]]

    def work(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        groups, _, own = jobs[key[0]]
        learnt, check = part[part["of"].isin(groups)], part[part["of"] == VAL]
        out = []
        for r in (numbers[i] for i in own) if len(learnt) else ():
            trees, rounds = boosted(_rows_of(learnt, width), _rows_of(check, width) if len(check) else None, runs[r])
            told = json.dumps(sorted(rounds.items()))
            out += [(r, told, t, *_tree_bytes(tree)) for t, tree in enumerate(trees[: max(rounds.values())])]
        return pd.DataFrame(out, columns=["run", "rounds", "tree", "feature", "cut", "value", "child"])

    dealt = dealt_cells(cells, [(*groups, VAL) for groups, *_ in jobs])
    found = dealt.groupBy("job").applyInPandas(work, "run bigint, rounds string, tree bigint, feature binary, cut binary, value binary, child binary")
    grown: dict[int, tuple[list[Tree], dict[int, int]]] = {}
    for r, own in found.toPandas().sort_values("tree").groupby("run"):
        trees = [_tree_from(*x) for x in own[["feature", "cut", "value", "child"]].itertuples(index=False)]
        grown[int(r)] = trees, dict(json.loads(own["rounds"].iloc[0]))
    large = [r for r in range(len(runs)) if not fits[r]]
    grown |= dict(zip(large, boosted_apart(cells, [runs[r] for r in large], checked) if large else ()))
    out = []
    for (p, _), r in zip(tasks, run_of):
        trees, rounds = grown.get(r, ([], {}))
        out.append(Boosted(list(cols), cells.cuts, trees[: rounds.get(p.get("n_estimators", 100), 0)]))
    return out


def search_scores(
    rows: DataFrame, group: str, cols: list[str], tasks: list[tuple[int, dict, list[int], int]], limit: int | None = None,
    times: str | None = None, val: DataFrame | None = None,
) -> DataFrame:
    """``block, point, label, predicted_probability`` of held-out rows under many models, as in ``forests.search_scores``."""
    cells, checked = _prepared(rows, group, cols, val)
    limit, width = _limit(rows.sparkSession, limit), len(cols)
    runs, run_of = runs_of([(p, g) for _, p, g, _ in tasks], cells.counts)
    served: dict[tuple[int, int], list[tuple[int, int]]] = {}  # (run, group tested) -> point and rounds of each task
    for (point, p, _, tested), r in zip(tasks, run_of):
        served.setdefault((r, tested), []).append((point, p.get("n_estimators", 100)))
    pairs = sorted(served)
    fits = _fits(cells, runs, limit, {VAL, *(tested for _, tested in pairs)})
    once = [pair for pair in pairs if fits[pair[0]]]
    jobs = _jobs(cells, runs, once)

    def scores(r: int, tested: int, held: tuple[np.ndarray, ...], grown: tuple[list[Tree], dict[int, int]]) -> Iterable[pd.DataFrame]:
        bins, label, _, copies = held
        bins, label, cell = cells_of(bins, label)
        copies = np.bincount(cell, copies, len(label)).astype(np.int64)
        total, done = np.zeros(len(label), np.int64), 0
        for point, n in sorted(served[r, tested], key=lambda task: grown[1][task[1]]):
            total, done = total + values_of(grown[0][done : grown[1][n]], bins), grown[1][n]
            alike, cell = np.unique(2 * total + label, return_inverse=True)
            some = np.bincount(cell, copies).astype(np.int64)
            found = {"label": (alike & 1).astype(np.float64), "predicted_probability": chance(alike >> 1)}
            found = {**found, times: some} if times else {c: np.repeat(v, some) for c, v in found.items()}
            yield pd.DataFrame({"block": np.int32(tested), "point": np.int32(point), **found})

    schema = "block int, point int, label double, predicted_probability double" + (f", {times} bigint" if times else "")
    names = [c.split()[0] for c in schema.split(", ")]

    def work(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        groups, tested, own = jobs[key[0]]
        learnt, held, check = part[part["of"].isin(groups)], part[part["of"] == tested], part[part["of"] == VAL]
        out = [pd.DataFrame(columns=names)]
        if len(learnt) and len(held):
            learnt, held, check = _rows_of(learnt, width), _rows_of(held, width), _rows_of(check, width) if len(check) else None
            out = [s for i in own for s in scores(once[i][0], tested, held, boosted(learnt, check, runs[once[i][0]]))]
        return pd.concat(out, ignore_index=True)

    found = [dealt_cells(cells, [(*groups, tested, VAL) for groups, tested, _ in jobs]).groupBy("job").applyInPandas(work, schema)]
    large = sorted({r for r, _ in pairs if not fits[r]})
    for r, grown in zip(large, boosted_apart(cells, [runs[r] for r in large], checked) if large else ()):
        for tested in (g for pair, g in pairs if pair == r):
            own = cells.df.where(F.col("_g") == tested)

            def apart(batches, r=r, tested=tested, grown=grown):
                for batch in batches:
                    for part in scores(r, tested, _read(batch, width), grown):
                        yield pa.RecordBatch.from_pandas(part, preserve_index=False)

            found.append(own.mapInArrow(apart, schema))
    # Written: areas read the scores more than once, and trees are not to be grown again for that.
    parts = [materialise(part, "scores") for part in found]
    return functools.reduce(DataFrame.unionByName, parts)


# ---------------------------------------------------------------- models


def chance(margin: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(margin / STEP, -500, 500)))


def _tree_bytes(tree: Tree) -> tuple[bytes, ...]:
    kinds = (np.int8, np.uint8, np.int32, np.int32)
    return tuple(a.astype(kind).tobytes() for a, kind in zip((tree.feature, tree.cut, tree.value, tree.left), kinds))


def _tree_from(feature, cut, value, child) -> Tree:
    kinds = (np.int8, np.uint8, np.int32, np.int32)
    return Tree(*(np.frombuffer(bytes(b), kind) for b, kind in zip((feature, cut, value, child), kinds)))


@dataclass(frozen=True)
class Boosted:
    """A fitted model: log odds as the sum of its trees' values; even odds without trees."""

    cols: list[str]
    cuts: list[list[float]]
    trees: list[Tree]
    kind: str = "boosted"

    def scores_of(self, x: np.ndarray) -> np.ndarray:
        return chance(values_of(self.trees, binned(x, self.cuts)))

    def probability(self) -> Column:
        @pandas_udf("double")
        def scored(*x: pd.Series) -> pd.Series:
            return pd.Series(self.scores_of(np.stack([c.to_numpy(float) for c in x], 1)))

        return scored(*[F.col(c).cast("double") for c in self.cols])

    def save(self, spark: SparkSession, path: str) -> None:
        head = json.dumps({"cols": self.cols, "cuts": self.cuts})
        spark.createDataFrame([(head,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/head")
        parts = [(i, *map(bytearray, _tree_bytes(t))) for i, t in enumerate(self.trees)]
        spark.createDataFrame(parts, "tree int, feature binary, cut binary, value binary, child binary").write.mode("overwrite").parquet(f"{path}/trees")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Boosted:
        head = json.loads(spark.read.text(f"{path}/head").first()[0])
        found = spark.read.parquet(f"{path}/trees").orderBy("tree").collect()
        return Boosted(head["cols"], head["cuts"], [_tree_from(*r[1:]) for r in found])
