"""Random forests of many settings and folds, grown together from one binned table.

Trees are grown from the top, so a forest of fewer trees is the first trees of a larger one, and one of less depth is the
top of a deeper one. Tasks that differ in these two alone share one run. Rows of equal bins, label and group are one cell
with their number, counted by Spark and written once; all else reads the cells. All randomness is a hash: the weight of a
cell in a tree (the sum of a Poisson draw with mean 1 for each of its rows) of its bins, label, group and the tree, the
order in which features are tried of the tree and the node. Splits compare whole-number class counts in bins. Hence a tree
is the same however the rows are partitioned.
Runs that differ in the fewest rows of a leaf alone grow side by side: where they choose the same splits, a node is worked
on once.

A node of more than ``limit`` rows is split by a class histogram that Spark adds up, one job a level for all trees. Below
that the cells of a node meet in one task, which grows the rest; where a whole training set has no more cells, they are
sent once for a number of trees. In a search the cells of the held-out rows are sent along, and a tree is gone once it has
scored them; trees that grow in parts are written and joined with the held-out cells. So no tree of a search passes through
the driver; only a model that is asked for itself is collected, as any forest model is.
"""

from __future__ import annotations

import functools
import json
import math
from collections.abc import Callable, Iterable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.functions import pandas_udf

from augury.ml.additive import Task
from augury.session import materialise, rows_per_task

SEED = 42
BINS = 32
ONE = 1 << 30  # stored value of probability 1: sums of whole numbers don't depend on their order
DEEPEST = 30
CHUNK = 25  # trees of one set of rows grown by one task, for all runs on these rows
SCORED, SLICE = 100, 50_000  # trees and, on average, held-out rows that meet in one task
NODES = 4096  # nodes whose histograms are held at once
CACHED = 64  # nodes whose cuts are rated at once: what that takes stays in the processor's cache
ROOT = 1  # node h has the children 2h and 2h + 1

GOLDEN = 0x9E3779B97F4A7C15


def mixed(x: np.ndarray) -> np.ndarray:
    """Well-spread 64-bit hashes of 64-bit numbers (the finisher of splitmix64)."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def tree_seed(tree: int) -> np.uint64:
    return mixed(np.array([SEED * 1_000_003 + tree + 1], np.uint64))[0]


@functools.cache
def poisson_steps(power: int) -> tuple[int, np.ndarray]:
    """The least value, and the chances of at most that and each further value, of a Poisson draw with mean 2 ** power."""
    n = 1 << power
    first, last = max(0, n - int(10 * n**0.5)), n + int(10 * n**0.5) + 20
    upto = np.cumsum([math.exp(k * math.log(n) - n - math.lgamma(k + 1)) for k in range(first, last + 1)])
    return first, upto / upto[-1]


def drawn(keys: np.ndarray, copies: np.ndarray, seed: np.uint64, steps: Callable[[int], tuple[int, np.ndarray]]) -> np.ndarray:
    """For each cell the sum of one draw a row, by hashes: as sums of draws add up, one hash for each bit of the number of rows.
    ``steps``: the distribution of such a sum over 2 ** b rows."""
    out, base = np.zeros(len(keys), np.int64), mixed(keys.view(np.uint64))
    for b in range(int(copies.max(initial=0)).bit_length()):
        own = np.flatnonzero(copies >> b & 1)
        if len(own):
            u = mixed(base[own] + np.uint64(b * GOLDEN % (1 << 64)) ^ seed)
            first, upto = steps(b)
            out[own] += first + np.searchsorted(upto, (u >> np.uint64(11)) * 2.0**-53, side="right")
    return out


def row_weights(keys: np.ndarray, tree: int, copies: np.ndarray | None = None) -> np.ndarray:
    """How often the rows of each cell (each row, without ``copies``) are in the sample of a tree."""
    return drawn(keys, np.ones(len(keys), np.int64) if copies is None else copies, tree_seed(tree), poisson_steps)


def cell_keys(bins: np.ndarray, label: np.ndarray, group: np.ndarray) -> np.ndarray:
    key = mixed(label.astype(np.uint64) + np.uint64(2) * group.astype(np.uint64) + np.uint64(1))
    for j in range(bins.shape[1]):
        key = mixed(key + bins[:, j].astype(np.uint64))
    return key.view(np.int64)


def feature_order(heaps: np.ndarray, tree: int, width: int) -> np.ndarray:
    """Per node the features in the order in which they are tried."""
    draws = mixed((mixed(heaps.astype(np.uint64)) ^ tree_seed(tree))[:, None] + np.arange(1, width + 1, dtype=np.uint64))
    return np.argsort(draws, axis=1, kind="stable")


@dataclass(frozen=True)
class Run:
    """Trees that serve several tasks."""

    groups: tuple[int, ...]
    leaf: int  # fewest rows of a leaf
    tried: int  # features tried at a node
    trees: int
    depth: int
    weights: tuple[float, float]  # of the classes


def features_tried(setting: str | None, width: int) -> int:
    return {"sqrt": max(1, int(np.sqrt(width))), "log2": max(1, int(np.log2(width))), None: width}[setting]


def _depth(params: dict) -> int:
    return min(DEEPEST, params.get("max_depth") or DEEPEST)


def runs_of(tasks: list[Task], counts: dict[tuple[int, int], int], width: int) -> tuple[list[Run], list[int]]:
    """The runs that serve all tasks, and the run of each task. ``counts``: rows by (group, class)."""
    keys = [(tuple(sorted(set(g))), p.get("min_samples_leaf", 1), features_tried(p.get("max_features", "sqrt"), width)) for p, g in tasks]
    runs, places = [], sorted(set(keys))
    for key in places:
        own = [p for (p, _), k in zip(tasks, keys) if k == key]
        n0, n1 = (sum(counts.get((g, k), 0) for g in key[0]) for k in (0, 1))
        weights = tuple((n0 + n1) / (2.0 * n) if n else 1.0 for n in (n0, n1))
        runs.append(Run(*key, max(p.get("n_estimators", 100) for p in own), max(map(_depth, own)), weights))
    return runs, [places.index(k) for k in keys]


# ---------------------------------------------------------------- splits


def rated(hist: np.ndarray, weights: tuple[float, float]) -> tuple[np.ndarray, np.ndarray]:
    """Per node, feature and cut the rows of the smaller side, and the purity by the weighted Gini measure."""
    left = hist.cumsum(3)
    right = left[..., -1:] - left

    def purity(side):
        a, b = side[0] * weights[0], side[1] * weights[1]
        total = a + b
        np.maximum(total, 1e-300, out=total)
        a *= a
        b *= b
        a += b
        a /= total
        return a

    return np.minimum(left[0] + left[1], right[0] + right[1]), purity(left) + purity(right)


def choose(hist: np.ndarray, runs: list[Run], asked: np.ndarray, order: np.ndarray | None, first: bool) -> tuple[np.ndarray, np.ndarray]:
    """Per node and run the place of the chosen feature (-1: no split) and its last bin on the left, where ``asked``.

    ``hist``: rows by (class, node, feature, bin), features as they are tried, or in the table's order and tried in ``order``.
    The purest split wins, the first of equals; with ``first`` only the first feature that can split counts.
    """
    place, cut = np.full(asked.shape, -1), np.zeros(asked.shape, np.int64)
    by_leaf = sorted(range(len(runs)), key=lambda r: runs[r].leaf)
    for k in range(0, len(asked), CACHED):
        smaller, gain = rated(hist[:, k : k + CACHED], runs[0].weights)
        here = np.arange(len(gain))
        features = np.broadcast_to(np.arange(gain.shape[1]), gain.shape[:2]) if order is None else order[k : k + CACHED]
        known, at, bin_ = np.zeros(len(here), bool), np.full(len(here), -1), np.zeros(len(here), np.int64)
        for r in by_leaf:
            # The best split for smaller leaves is the best one for larger leaves that allow it.
            good = known & ((at < 0) | (smaller[here, features[here, at], bin_] >= runs[r].leaf)) & (not first)
            new = np.flatnonzero(asked[k : k + CACHED, r] & ~good)
            if len(new):
                fits = smaller[new] >= runs[r].leaf
                score = np.where(fits, gain[new], -np.inf)
                bins = score.argmax(2)
                own = features[new]
                best = np.take_along_axis(np.take_along_axis(score, bins[:, :, None], 2)[:, :, 0], own, 1)
                chosen = (best > -np.inf).argmax(1) if first else best.argmax(1)
                rows = np.arange(len(new))
                found = best[rows, chosen] > -np.inf
                at[new], bin_[new], known[new] = np.where(found, chosen, -1), bins[rows, own[rows, chosen]], True
            told = np.flatnonzero(asked[k : k + CACHED, r])
            place[k + told, r], cut[k + told, r] = at[told], bin_[told]
    return place, cut


def decide(heaps: np.ndarray, tree: int, runs: list[Run], width: int, asked: np.ndarray, histogram: Callable) -> tuple[np.ndarray, np.ndarray]:
    """Feature (-1: none) and last left bin of each node and run, where ``asked``. Where no tried feature can split, the others
    are tried in turn. ``histogram``: of given nodes and the features tried there; of all in the table's order without these."""
    order = feature_order(heaps, tree, width)
    feature, cut = np.full(asked.shape, -1), np.zeros(asked.shape, np.int64)
    for tried in sorted({runs[0].tried, width}):
        left = asked & (feature < 0)
        nodes = np.flatnonzero(left.any(1))
        if len(nodes):
            own, left = order[nodes, :tried], left[nodes]
            whole = tried == width
            place, bins = choose(histogram(nodes, None if whole else own), runs, left, own if whole else None, first=tried > runs[0].tried)
            feature[nodes] = np.where(left, np.where(place >= 0, np.take_along_axis(own, np.maximum(place, 0), 1), -1), feature[nodes])
            cut[nodes] = np.where(left, bins, cut[nodes])
    return feature, cut


def values_of(counts: np.ndarray, run: Run) -> np.ndarray:
    a, b = counts[:, 0] * run.weights[0], counts[:, 1] * run.weights[1]
    return np.rint(np.divide(b, a + b, out=np.full(len(a), 0.5), where=a + b > 0) * ONE).astype(np.int32)


def open_nodes(counts: np.ndarray, heaps: np.ndarray, run: Run) -> np.ndarray:
    """Nodes to be split: both classes, rows for two leaves, depth left."""
    return (counts.min(1) > 0) & (counts.sum(1) >= 2 * run.leaf) & (heaps < 1 << run.depth)


def cells_of(bins: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bins and label of each cell of rows that are alike, in a fixed order, and the cell of each row."""
    if 5 * bins.shape[1] + 1 < 64:
        key = label.astype(np.int64)
        for j in range(bins.shape[1]):
            key = key * BINS + bins[:, j]
    else:
        both = np.ascontiguousarray(np.column_stack([bins, label.astype(np.uint8)]))
        key = both.view(np.dtype((np.void, both.shape[1]))).ravel()
    _, first, cell = np.unique(key, return_index=True, return_inverse=True)
    return bins[first], label[first], cell


def grow(bins: np.ndarray, label: np.ndarray, weight: np.ndarray, tree: int, run: Run, heap: int = ROOT) -> tuple[np.ndarray, ...]:
    """The nodes below and at ``heap``, level by level: heap numbers, features (-1: leaf), last left bins, values."""
    return grow_together(bins, label, weight, tree, [run], heap)[0]


def grow_together(bins: np.ndarray, label: np.ndarray, weight: np.ndarray, tree: int, runs: list[Run], heap: int = ROOT) -> list[tuple[np.ndarray, ...]]:
    """As ``grow``, for runs that differ in leaves, depth and number of trees alone. A node stands for all runs that have come to
    it by the same splits."""
    out: list[list] = [[] for _ in runs]
    width = bins.shape[1]
    cell = np.ascontiguousarray((bins + BINS * label[:, None].astype(np.uint8)).T.astype(np.uint8))  # (feature, row)
    weight, at = weight.astype(np.float64), np.zeros(len(label), np.int64)
    frontier, of = np.array([heap], np.int64), np.ones((1, len(runs)), bool)
    while len(frontier):
        counts = np.bincount(at * 2 + (cell[0] >= BINS), weight, 2 * len(frontier)).reshape(-1, 2)
        asked = of & np.stack([open_nodes(counts, frontier, run) for run in runs], 1)
        feature, cut = np.full(asked.shape, -1), np.zeros(asked.shape, np.int64)
        going = np.flatnonzero(asked.any(1))
        number = np.full(len(frontier), -1)
        number[going] = np.arange(len(going))
        spot = number[at]
        kept = np.flatnonzero(spot >= 0)
        if len(going) > NODES:  # rows in the order of their nodes, to look at a range of nodes at a time
            kept = kept[np.argsort(spot[kept], kind="stable")]
        if len(kept) < len(at) or len(going) > NODES:
            at, cell, weight = spot[kept], np.take(cell, kept, 1), weight[kept]
        ends = np.searchsorted(at, np.arange(0, len(going) + NODES, NODES)) if len(going) > NODES else None
        for k in range(0, len(going), NODES):
            rows = slice(None) if ends is None else slice(ends[k // NODES], ends[k // NODES + 1])
            here, own, times = at[rows] - k, cell[:, rows], weight[rows]
            part = going[k : k + NODES]

            def histogram(nodes, tried):
                inside, spot, w, cells = None, here, times, len(nodes) * BINS * 2
                if len(nodes) < len(part):
                    where = np.full(len(part), -1)
                    where[nodes] = np.arange(len(nodes))
                    spot = where[here]
                    inside = np.flatnonzero(spot >= 0)
                    spot, w = spot[inside], times[inside]
                base, n = spot * (BINS * 2), width if tried is None else tried.shape[1]
                hist = np.empty((2, len(nodes), n, BINS))
                row = None if tried is None else (np.arange(len(here)) if inside is None else inside)
                for j in range(n):
                    if tried is None:
                        c = own[j] if inside is None else own[j, inside]
                    elif len(nodes) == 1:
                        c = own[tried[0, j], row]
                    else:
                        c = own[tried[:, j][spot], row]
                    hist[:, :, j] = np.bincount(base + c, w, cells).reshape(len(nodes), 2, BINS).transpose(1, 0, 2)
                return hist

            feature[part], cut[part] = decide(frontier[part], tree, runs, width, asked[part], histogram)
        values = values_of(counts, runs[0])
        for r in range(len(runs)):
            own = of[:, r]
            out[r].append((frontier[own], feature[own, r], cut[own, r], values[own]))
        choice = np.where(feature >= 0, feature * BINS + cut, -1)[going]
        heaps, shared, places, parts, first = [], [], [], [], 0
        for r in range(len(runs)):  # one pair of children for each choice that differs from those of the runs before
            leads = (choice[:, r] >= 0) & (choice[:, :r] != choice[:, r : r + 1]).all(1)
            nodes = np.flatnonzero(leads)
            if not len(nodes):
                continue
            rows = np.flatnonzero(leads[at])
            own = at[rows]
            right = cell[choice[own, r] // BINS, rows] % BINS > choice[own, r] % BINS
            parts.append(rows)
            places.append(first + 2 * (np.cumsum(leads) - 1)[own] + right)
            heaps.append(np.stack([2 * frontier[going[nodes]], 2 * frontier[going[nodes]] + 1], 1).ravel())
            shared.append(np.repeat(choice[nodes] == choice[nodes, r : r + 1], 2, axis=0))
            first += 2 * len(nodes)
        if not heaps:
            break
        frontier, of = np.concatenate(heaps), np.concatenate(shared)
        rows, at = np.concatenate(parts), np.concatenate(places)
        cell, weight = np.take(cell, rows, 1), weight[rows]
    return [tuple(np.concatenate(x) for x in zip(*nodes)) for nodes in out]


@dataclass
class Tree:
    """Nodes in the order of their heap numbers; ``left`` is the place of the left child, the right one follows it."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    left: np.ndarray

    @staticmethod
    def of(heap: np.ndarray, feature: np.ndarray, cut: np.ndarray, value: np.ndarray) -> "Tree":
        order = np.argsort(heap)
        heap, feature = heap[order], feature[order].astype(np.int64)
        left = np.where(feature >= 0, np.searchsorted(heap, 2 * heap), -1)
        return Tree(feature.astype(np.int8), cut[order].astype(np.uint8), value[order].astype(np.int32), left.astype(np.int32))

    def values(self, bins: np.ndarray, depths: Iterable[int]) -> dict[int, np.ndarray]:
        """Value of each row in the tree cut at each of the depths."""
        at, out, rows = np.zeros(len(bins), np.int64), {}, np.arange(len(bins))
        wanted = sorted(set(depths))
        for level in range(wanted[-1] + 1 if wanted else 0):
            if level in wanted:
                out[level] = self.value[at]
            rows = rows[self.feature[at[rows]] >= 0]
            if not len(rows):
                break
            here = at[rows]
            at[rows] = self.left[here] + (bins[rows, self.feature[here]] > self.cut[here])
        return {d: out.get(d, self.value[at]) for d in wanted}


# ---------------------------------------------------------------- Spark jobs


def cuts_of(rows: DataFrame, cols: list[str]) -> list[list[float]]:
    """Per feature the upper ends of all bins but the last: quantiles of the values, by Spark's sketch."""
    at = [k / BINS for k in range(1, BINS)]
    found = rows.agg(*[F.percentile_approx(F.col(c).cast("double"), at, 10_000).alias(f"_{j}") for j, c in enumerate(cols)]).first()
    return [sorted({v for v in (found[j] or []) if v == v}) for j in range(len(cols))]


def binned(x: np.ndarray, cuts: list[list[float]]) -> np.ndarray:
    return np.stack([np.searchsorted(np.array(c), x[:, j], side="left") for j, c in enumerate(cuts)], 1).astype(np.uint8)


@dataclass(frozen=True)
class Cells:
    """Rows that are alike, counted: ``_b`` (bins), ``_y`` (label), ``_g`` (group), ``_n`` (rows)."""

    df: DataFrame
    cols: list[str]
    cuts: list[list[float]]
    counts: dict[tuple[int, int], int]  # rows by (group, class)
    sizes: dict[int, int]  # cells by group

    def size(self, groups: Iterable[int]) -> int:
        return sum(self.sizes.get(g, 0) for g in groups)


def cells_table(rows: DataFrame, group: str, cols: list[str], cuts: list[list[float]] | None = None) -> Cells:
    """The cells of all rows with a label and a group. They hold all that a fit reads of the rows."""
    width, cuts = len(cols), cuts or cuts_of(rows, cols)
    features = [F.col(c).cast("double").alias(f"_{j}") for j, c in enumerate(cols)]
    narrow = rows.where(F.col("label").isNotNull() & F.col(group).isNotNull())
    narrow = narrow.select(*features, F.col("label").cast("int").alias("_y"), F.col(group).cast("int").alias("_g"))

    def work(batches):
        for batch in batches:
            x = np.stack([batch.column(j).to_numpy(zero_copy_only=False).astype(float) for j in range(width)], 1)
            ends = pa.py_buffer(np.arange(0, (len(x) + 1) * width, max(1, width), dtype=np.int32))
            packed = pa.Array.from_buffers(pa.binary(), len(x), [None, ends, pa.py_buffer(np.ascontiguousarray(binned(x, cuts)))])
            yield pa.RecordBatch.from_arrays([packed, batch.column(width), batch.column(width + 1)], names=["_b", "_y", "_g"])

    counted = narrow.mapInArrow(work, "_b binary, _y int, _g int").groupBy("_b", "_y", "_g").agg(F.count("*").alias("_n"))
    # Little data but much work follows: cells lie in parts for all cores, alike ones together.
    spread = counted.repartition(2 * rows.sparkSession.sparkContext.defaultParallelism, "_b").sortWithinPartitions("_g", "_b", "_y")
    df = materialise(spread, "cells")
    found = df.groupBy("_g", "_y").agg(F.sum("_n").alias("n"), F.count("*").alias("cells")).collect()
    sizes: dict[int, int] = {}
    for r in found:
        sizes[r["_g"]] = sizes.get(r["_g"], 0) + r["cells"]
    return Cells(df, list(cols), cuts, {(r["_g"], r["_y"]): r["n"] for r in found}, sizes)


def _read(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, ...]:
    """Bins, labels, groups and numbers of rows of a batch of cells."""
    bins = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(-1, width)
    label, group, copies = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (1, 2, 3))
    return bins, label, group, copies


def _packed(names: list[str], records: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*records))
    return pa.RecordBatch.from_arrays(
        [pa.array(c, pa.binary() if isinstance(c[0], bytes) else pa.int64()) for c in columns], names=names
    )


def _bytes(bins: np.ndarray, label: np.ndarray, copies: np.ndarray) -> tuple[bytes, bytes, bytes]:
    return np.ascontiguousarray(bins).tobytes(), label.astype(np.uint8).tobytes(), copies.astype(np.int64).tobytes()


def _rows_of(part: pd.DataFrame, width: int) -> tuple[np.ndarray, ...]:
    """Bins, labels, groups and numbers of rows of packed cells."""
    bins, label, copies = (np.frombuffer(b"".join(part[c]), kind) for c, kind in (("bins", np.uint8), ("labels", np.uint8), ("copies", np.int64)))
    return bins.reshape(-1, width), label.astype(np.int64), np.repeat(part["of"].to_numpy(np.int64), [len(x) for x in part["labels"]]), copies


DEALT = "job bigint, of bigint, bins binary, labels binary, copies binary"


def dealt_cells(cells: Cells, jobs: list[tuple[int, ...]]) -> DataFrame:
    """The cells of the groups that each job asks for."""
    width = len(cells.cols)
    askers: dict[int, list[int]] = {}
    for i, groups in enumerate(jobs):
        for g in groups:
            askers.setdefault(g, []).append(i)

    def deal(batches):
        for batch in batches:
            bins, label, number, copies = _read(batch, width)
            records = []
            for g in np.unique(number).tolist():
                own = number == g
                packed = _bytes(bins[own], label[own], copies[own]) if g in askers else None
                records += [(i, g, *packed) for i in askers.get(g, ())]
            for k in range(0, len(records), 64):
                yield _packed(["job", "of", "bins", "labels", "copies"], records[k : k + 64])

    return _spread(cells.df.mapInArrow(deal, DEALT), len(jobs), ["job"])


def _tops(cells: Cells, runs: list[Run], sizes: list[int], limit: int) -> dict[tuple[int, int], list[tuple]]:
    """Per (run, tree) the nodes above those that fit a task: heap, feature, cut, value. Feature -2 marks a node to be
    finished in a task."""
    width = len(cells.cols)
    tops: dict[tuple[int, int], list[tuple]] = {}
    frontier = []
    for r, run in enumerate(runs):
        for t in range(run.trees if sizes[r] > limit else 0):
            tops[r, t] = []
            frontier.append((r, t, ROOT))
    while frontier:
        following = []
        for k in range(0, len(frontier), NODES // 4):
            part = frontier[k : k + NODES // 4]
            found = _histograms(cells, runs, {key: _tree_of(tops[key]) for key in {p[:2] for p in part}}, part)
            for (r, t, heap), hist in zip(part, found):
                run, heaps, counts = runs[r], np.array([heap]), hist[0].sum(0)[None, :]
                feature, cut = np.array([-1]), np.array([0])
                if open_nodes(counts, heaps, run)[0]:
                    whole = hist.transpose(2, 0, 1)[:, None]
                    feature, cut = (a[0] for a in decide(heaps, t, [run], width, np.ones((1, 1), bool), lambda nodes, tried, whole=whole: whole if tried is None else whole[:, :, tried[0]]))
                tops[r, t].append((heap, int(feature[0]), int(cut[0]), int(values_of(counts, run)[0])))
                if feature[0] >= 0:
                    left = hist[feature[0], : cut[0] + 1].sum()
                    for child, size in ((2 * heap, left), (2 * heap + 1, counts.sum() - left)):
                        if size > limit:
                            following.append((r, t, child))
                        else:
                            tops[r, t].append((child, -2, 0, 0))
        frontier = following
    return tops


def _tree_of(nodes: list[tuple]) -> dict[int, tuple[int, int]]:
    return {h: (f, c) for h, f, c, _ in nodes if f >= 0}


def _heaps(splits: dict[int, tuple[int, int]], bins: np.ndarray) -> np.ndarray:
    """The lowest known node of each row."""
    at = np.full(len(bins), ROOT, np.int64)
    for heap in sorted(splits):
        here = np.flatnonzero(at == heap)
        feature, cut = splits[heap]
        at[here] = 2 * heap + (bins[here, feature] > cut)
    return at


def _histograms(cells: Cells, runs: list[Run], known: dict, nodes: list[tuple[int, int, int]]) -> np.ndarray:
    """Rows by (feature, bin, class) of the given nodes, added up in Spark."""
    width, place = len(cells.cols), {n: i for i, n in enumerate(nodes)}
    size = width * BINS * 2

    def work(batches):
        total = np.zeros(len(nodes) * size)
        for batch in batches:
            bins, label, number, copies = _read(batch, width)
            keys = cell_keys(bins, label, number)
            for (r, t), splits in known.items():
                inside = np.flatnonzero(np.isin(number, runs[r].groups))
                weight, heaps = row_weights(keys[inside], t, copies[inside]), _heaps(splits, bins[inside])
                spot = np.array([place.get((r, t, h), -1) for h in heaps.tolist()], np.int64)
                own = np.flatnonzero((spot >= 0) & (weight > 0))
                b, y = bins[inside[own]], label[inside[own]]
                for j in range(width):
                    at = spot[own] * size + (j * BINS + b[:, j].astype(np.int64)) * 2 + y
                    np.add.at(total, at, weight[own])
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["at", "part"])

    parts = cells.df.mapInArrow(work, "at bigint, part double").groupBy("at").agg(F.sum("part").alias("part")).toPandas()
    out = np.zeros(len(nodes) * size)
    out[parts["at"]] = parts["part"]
    return out.reshape(len(nodes), width, BINS, 2)


TREES = "run bigint, tree bigint, heap binary, feature binary, cut binary, value binary"


def _tree_row(run: int, tree: int, heap, feature, cut, value) -> tuple:
    kinds = (np.int64, np.int8, np.uint8, np.int32)
    return (run, tree, *[np.asarray(a).astype(kind).tobytes() for a, kind in zip((heap, feature, cut, value), kinds)])


def _nodes(part: pd.DataFrame) -> tuple[np.ndarray, ...]:
    kinds = (("heap", np.int64), ("feature", np.int8), ("cut", np.uint8), ("value", np.int32))
    return tuple(np.concatenate([np.frombuffer(b, kind) for b in part[c]]) for c, kind in kinds)


def _top(nodes: tuple[np.ndarray, ...], depth: int) -> tuple[np.ndarray, ...]:
    """The nodes of a tree down to a depth."""
    heap, feature, cut, value = (a[nodes[0] < 1 << (depth + 1)] for a in nodes)
    return heap, np.where(heap < 1 << depth, feature, -1), cut, value


def _spread(df: DataFrame, most: int, keys: list[str]) -> DataFrame:
    """By key into a set number of partitions: little data but much work, which would else be drawn together. There are more
    partitions than keys, so that few hold two, up to a bound."""
    return df.repartition(max(1, min(4 * most, 32 * df.sparkSession.sparkContext.defaultParallelism)), *keys)


def _grown(part: tuple[np.ndarray, ...], families: list[list[int]], runs: list[Run], trees: Iterable[int], heap: int = ROOT):
    """``run, tree`` and nodes of trees grown from these cells, for each family of runs together."""
    bins, label, group, copies = part
    keys = cell_keys(bins, label, group)
    bins, label, cell = cells_of(bins, label)
    for t in trees:
        weight = np.bincount(cell, row_weights(keys, t, copies), len(label)).astype(np.int64)
        own = np.flatnonzero(weight)
        for family in families:
            members = [r for r in family if t < runs[r].trees]
            if members:
                for r, nodes in zip(members, grow_together(bins[own], label[own], weight[own], t, [runs[r] for r in members], heap)):
                    yield r, t, nodes


def _families(runs: list[Run], these: Iterable[int]) -> dict[tuple[int, ...], list[list[int]]]:
    """By groups learnt from the runs that grow side by side."""
    same: dict[tuple[int, ...], dict[int, list[int]]] = {}
    for r in these:
        same.setdefault(runs[r].groups, {}).setdefault(runs[r].tried, []).append(r)
    return {groups: [*own.values()] for groups, own in same.items()}


def _chunks(families: list[list[int]], runs: list[Run]) -> list[range]:
    most = max(runs[r].trees for family in families for r in family)
    return [range(t, min(most, t + CHUNK)) for t in range(0, most, CHUNK)]


def _limit(spark: SparkSession, limit: int | None) -> int:
    """Most cells of a node that one task finishes, eight times the session's rows per task unless given: a cell takes few bytes."""
    return limit or max(1, 8 * rows_per_task(spark))


def grow_all(cells: Cells, runs: list[Run], limit: int) -> DataFrame:
    """The written trees of all runs, in parts, by run and tree."""
    spark, width = cells.df.sparkSession, len(cells.cols)
    sizes = [cells.size(run.groups) for run in runs]
    tops = _tops(cells, runs, sizes, limit)
    same = _families(runs, [r for r in range(len(runs)) if sizes[r] <= limit])
    whole = [(families, trees, ROOT) for families in same.values() for trees in _chunks(families, runs)]
    below = [([[r]], range(t, t + 1), h) for (r, t), nodes in tops.items() for h, f, _, _ in nodes if f == -2]
    jobs, known = [*whole, *below], {key: _tree_of(nodes) for key, nodes in tops.items()}
    number_of = {(r, t, h): len(whole) + i for i, ([[r]], (t,), h) in enumerate(below)}

    def deal(batches):
        for batch in batches:
            bins, label, number, copies = _read(batch, width)
            keys, records = cell_keys(bins, label, number), []
            for (r, t), splits in known.items():
                inside = np.flatnonzero(np.isin(number, runs[r].groups))
                inside = inside[row_weights(keys[inside], t, copies[inside]) > 0]
                heaps = _heaps(splits, bins[inside])
                for g, h in sorted(set(zip(number[inside].tolist(), heaps.tolist()))):
                    if (r, t, h) in number_of:
                        own = inside[(heaps == h) & (number[inside] == g)]
                        records.append((number_of[r, t, h], g, *_bytes(bins[own], label[own], copies[own])))
            for k in range(0, len(records), 64):
                yield _packed(["job", "of", "bins", "labels", "copies"], records[k : k + 64])

    def finish(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        families, trees, heap = jobs[key[0]]
        out = [_tree_row(r, t, *nodes) for r, t, nodes in _grown(_rows_of(part, width), families, runs, trees, heap)]
        return pd.DataFrame(out, columns=["run", "tree", "heap", "feature", "cut", "value"])

    dealt = dealt_cells(cells, [runs[families[0][0]].groups for families, _, _ in whole])
    if below:
        dealt = dealt.unionByName(_spread(cells.df.mapInArrow(deal, DEALT), len(below), ["job"]))
    trees = dealt.groupBy("job").applyInPandas(finish, TREES)
    upper = [_tree_row(r, t, *zip(*[n for n in nodes if n[1] != -2])) for (r, t), nodes in tops.items()]
    if upper:
        trees = trees.unionByName(spark.createDataFrame([(a, b, *map(bytearray, c)) for a, b, *c in upper], TREES))
    return materialise(trees, "trees")


SUMS = "pair bigint, slice bigint, point bigint, labels binary, times binary, sums binary"


def search_scores(rows: DataFrame, group: str, cols: list[str], tasks: list[tuple[int, dict, list[int], int]], limit: int | None = None, times: str | None = None) -> DataFrame:
    """``block, point, label, predicted_probability`` of held-out rows under many forests; with ``times`` one row for those
    of equal label and score, and their number in that column.

    A task is (point, settings, groups learnt from, group tested). A task whose groups hold no rows scores nothing.
    """
    cells, limit = cells_table(rows, group, cols), _limit(rows.sparkSession, limit)
    runs, run_of = runs_of([(p, g) for _, p, g, _ in tasks], cells.counts, len(cols))
    # (run, group tested) -> point, trees and depth of each task that it serves
    served: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
    for (point, params, _, tested), r in zip(tasks, run_of):
        served.setdefault((r, tested), []).append((point, params.get("n_estimators", 100), _depth(params)))
    pairs = sorted(served)
    trees_of = {point: params.get("n_estimators", 100) for point, params, _, _ in tasks}

    def add_up(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        pair, _, point = key
        total = sum(np.frombuffer(b, np.int64) for b in part["sums"])
        # The chunk of the first trees, which all tasks have, brings labels and numbers of rows.
        label, copies = (np.frombuffer(next(b for b in part[c] if b), kind) for c, kind in (("labels", np.uint8), ("times", np.int64)))
        if times:
            alike, cell = np.unique(2 * total + label, return_inverse=True)
            total, label, copies = alike >> 1, alike & 1, np.bincount(cell, copies).astype(np.int64)
        rows = {"label": label.astype(np.float64), "predicted_probability": total / (trees_of[point] * float(ONE))}
        rows = {**rows, times: copies} if times else {c: np.repeat(v, copies) for c, v in rows.items()}
        return pd.DataFrame({"block": np.int32(pairs[pair][1]), "point": np.int32(point), **rows})

    fits = [cells.size(runs[r].groups) <= limit and cells.size([tested]) <= limit for r, tested in pairs]
    found = _scored_at_once(cells, runs, served, [i for i, own in enumerate(fits) if own], pairs)
    if not all(fits):
        found = found.unionByName(_scored_by_join(cells, runs, served, [i for i, own in enumerate(fits) if not own], pairs, limit))
    scores = "block int, point int, label double, predicted_probability double" + (f", {times} bigint" if times else "")
    # Written: areas read the scores more than once, and trees are not to be grown again for that.
    return materialise(found.groupBy("pair", "slice", "point").applyInPandas(add_up, scores), "scores")


def _scored_at_once(cells: Cells, runs: list[Run], served: dict, these: list[int], pairs: list[tuple[int, int]]) -> DataFrame:
    """Sums of the trees' values for held-out cells that are sent along with the cells learnt from. No tree is kept."""
    width, jobs = len(cells.cols), []
    for tested in sorted({pairs[i][1] for i in these}):
        place = {pairs[i][0]: i for i in these if pairs[i][1] == tested}
        for groups, families in _families(runs, place).items():
            jobs += [(groups, tested, families, trees, place) for trees in _chunks(families, runs)]

    def score(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        groups, tested, families, trees, place = jobs[key[0]]
        names = ["pair", "slice", "point", "labels", "times", "sums"]
        learnt, held = part[part["of"].isin(groups)], part[part["of"] == tested]
        if not len(learnt) or not len(held):
            return pd.DataFrame(columns=names)
        bins, label, _, copies = _rows_of(held, width)
        bins, label, cell = cells_of(bins, label)  # in the same order in every chunk
        copies = np.bincount(cell, copies, len(label)).astype(np.int64)
        sums: dict[tuple[int, int], np.ndarray] = {}
        for r, t, nodes in _grown(_rows_of(learnt, width), families, runs, trees):
            own = [task for task in served[r, tested] if t < task[1]]
            values = Tree.of(*nodes).values(bins, [task[2] for task in own]) if own else {}
            for point, _, depth in own:
                sums[r, point] = sums.get((r, point), 0) + values[depth].astype(np.int64)
        told = (label.astype(np.uint8).tobytes(), copies.tobytes()) if trees.start == 0 else (b"", b"")
        return pd.DataFrame([(place[r], 0, point, *told, total.tobytes()) for (r, point), total in sums.items()], columns=names)

    return dealt_cells(cells, [(*groups, tested) for groups, tested, *_ in jobs]).groupBy("job").applyInPandas(score, SUMS)


def _scored_by_join(cells: Cells, runs: list[Run], served: dict, these: list[int], pairs: list[tuple[int, int]], limit: int) -> DataFrame:
    """As ``_scored_at_once``, for runs whose trees grow in parts: held-out cells meet the written trees in slices of
    ``SLICE`` cells, of ``limit`` if that is less, on average."""
    width = len(cells.cols)
    used = sorted({pairs[i][0] for i in these})
    trees = grow_all(cells, [runs[r] for r in used], limit)
    largest = max((cells.sizes.get(pairs[i][1], 0) for i in these), default=0)
    slices = max(1, -(-largest // min(SLICE, limit)))

    def deal(batches):
        for batch in batches:
            bins, label, number, copies = _read(batch, width)
            part = ((cell_keys(bins, label, number).view(np.uint64) >> np.uint64(1)) % np.uint64(slices)).astype(np.int64)
            records = []
            for i in these:
                r, tested = pairs[i]
                for s in np.unique(part[number == tested]).tolist():
                    own = (number == tested) & (part == s)
                    packed = _bytes(bins[own], label[own], copies[own])
                    records += [(i, c, s, tested, *packed) for c in range(-(-runs[r].trees // SCORED))]
            for k in range(0, len(records), 64):
                yield _packed(["pair", "chunk", "slice", "of", "bins", "labels", "copies"], records[k : k + 64])

    def score(key: tuple, grown: pd.DataFrame, part: pd.DataFrame) -> pd.DataFrame:
        names = ["pair", "slice", "point", "labels", "times", "sums"]
        if not len(grown) or not len(part):
            return pd.DataFrame(columns=names)
        pair, _, s = key
        bins, label, _, copies = _rows_of(part, width)
        bins, label, cell = cells_of(bins, label)  # in the same order in every chunk
        copies = np.bincount(cell, copies, len(label)).astype(np.int64)
        sums = {task: np.zeros(len(label), np.int64) for task in served[pairs[pair]]}
        for t, nodes in grown.groupby("tree"):
            own = [task for task in sums if t < task[1]]
            values = Tree.of(*_nodes(nodes)).values(bins, [task[2] for task in own])
            for task in own:
                sums[task] += values[task[2]]
        out = [(pair, s, task[0], label.astype(np.uint8).tobytes(), copies.tobytes(), total.tobytes()) for task, total in sums.items()]
        return pd.DataFrame(out, columns=names)

    keys = ["pair", "chunk", "slice"]
    uses = F.array(*[F.struct(F.lit(i).cast("bigint").alias("pair"), F.lit(used.index(pairs[i][0])).cast("bigint").alias("of")) for i in these])
    placed = trees.withColumn("use", F.explode(F.filter(uses, lambda u: u["of"] == F.col("run")))).select(
        F.col("use.pair").alias("pair"), F.floor(F.col("tree") / SCORED).cast("bigint").alias("chunk"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(slices - 1).cast("bigint"))).alias("slice"), "tree", "heap", "feature", "cut", "value",
    )
    most = sum(-(-runs[pairs[i][0]].trees // SCORED) for i in these) * slices
    dealt = cells.df.mapInArrow(deal, "pair bigint, chunk bigint, slice bigint, of bigint, bins binary, labels binary, copies binary")
    met = _spread(placed, most, keys).groupBy(*keys).cogroup(_spread(dealt, most, keys).groupBy(*keys))
    return met.applyInPandas(score, SUMS)


# ---------------------------------------------------------------- models


@dataclass(frozen=True)
class Forest:
    """A fitted forest: the mean of its trees' class shares; 0.5 without trees."""

    cols: list[str]
    cuts: list[list[float]]
    trees: list[Tree]
    depth: int
    kind: str = "forest"

    def scores_of(self, x: np.ndarray) -> np.ndarray:
        if not self.trees:
            return np.full(len(x), 0.5)
        bins = binned(x, self.cuts)
        total = np.zeros(len(x), np.int64)
        for tree in self.trees:
            total += tree.values(bins, [self.depth])[self.depth]
        return total / (len(self.trees) * float(ONE))

    def probability(self) -> Column:
        @pandas_udf("double")
        def scored(*x: pd.Series) -> pd.Series:
            return pd.Series(self.scores_of(np.stack([c.to_numpy(float) for c in x], 1)))

        return scored(*[F.col(c).cast("double") for c in self.cols])

    def save(self, spark: SparkSession, path: str) -> None:
        head = json.dumps({"cols": self.cols, "cuts": self.cuts, "depth": self.depth})
        spark.createDataFrame([(head,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/head")
        parts = [
            (i, bytearray(t.feature.astype(np.int8).tobytes()), bytearray(t.cut.astype(np.uint8).tobytes()), bytearray(t.value.astype(np.int32).tobytes()), bytearray(t.left.astype(np.int64).tobytes()))
            for i, t in enumerate(self.trees)
        ]
        spark.createDataFrame(parts, "tree int, feature binary, cut binary, value binary, child binary").write.mode("overwrite").parquet(f"{path}/trees")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "Forest":
        head = json.loads(spark.read.text(f"{path}/head").first()[0])
        found = spark.read.parquet(f"{path}/trees").orderBy("tree").collect()
        kinds = (("feature", np.int8), ("cut", np.uint8), ("value", np.int32), ("child", np.int64))
        trees = [Tree(*[np.frombuffer(bytes(r[c]), kind).astype(np.int64) for c, kind in kinds]) for r in found]
        return Forest(head["cols"], head["cuts"], trees, head["depth"])


def fit_forests(rows: DataFrame, group: str, cols: list[str], tasks: list[Task], limit: int | None = None) -> list[Forest]:
    """One forest a task. Their trees are collected: ask for the models that are wanted, not for those of a search."""
    cells = cells_table(rows, group, cols)
    runs, run_of = runs_of(tasks, cells.counts, len(cols))
    trees = grow_all(cells, runs, _limit(rows.sparkSession, limit))
    grown: dict[int, list[tuple]] = {}
    for (r, _), part in trees.toPandas().groupby(["run", "tree"]):
        grown.setdefault(int(r), []).append(_nodes(part))
    wanted = [(grown.get(r, [])[: p.get("n_estimators", 100)], _depth(p)) for (p, _), r in zip(tasks, run_of)]
    return [Forest(list(cols), cells.cuts, [Tree.of(*_top(nodes, depth)) for nodes in own], depth) for own, depth in wanted]
