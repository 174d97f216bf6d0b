"""Near-duplicate vectors by an epsilon grid order join.

Unit vectors with a cosine of at least t are at most eps = sqrt(2 - 2t) apart, and no projection puts them farther
apart. Vectors are projected on the leading principal axes, sorted by their grid cells of width eps along these axes, and
cut into blocks of consecutive vectors. Two blocks meet only if their boxes are within eps; inside, the two
sequences are halved again and again, and halves with distant boxes are skipped. What is left is compared by cosine in double
precision.

Equal vectors are one entry first, whatever their number. A pair of blocks gives link counts and local roots, at most
one row per vector, never the links themselves. Their connected components are the result.

Cases: vectors that are NULL, zero, not finite or of another than the most common length link with nothing: no links, their own component. Repeated
rows are copies. A NULL id stays NULL and is never a component's smallest unless there is no other. An empty table gives an empty result;
labels and other columns play no part.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from augury.llm.components import components
from augury.llm.jaccard import local_roots
from augury.llm.vectors import dimension, dots, matrix, packed
from augury.session import materialise

THRESHOLD = 0.95
AXES = 8  # leading principal axes that order and prune
MEETING_AXES = 3  # of these, axes whose cells bring blocks together
BLOCK, LEAF = 4096, 256


def units(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def principal_axes(vectors: DataFrame, d: int, axes: int) -> np.ndarray:
    """d x axes: leading axes of all usable unit vectors. Partitions add up their products first."""

    def work(batches):
        total = np.zeros((d + 1, d))
        for batch in batches:
            x, _ = matrix(batch.column("vector"), d)
            if len(x):
                u = units(x)
                total[:d] += u.T @ u
                total[d] += u.sum(axis=0)
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(total.ravel())], names=["i", "j", "x"])

    rows = vectors.select("vector").mapInArrow(work, "i int, j int, x double").groupBy("i", "j").agg(F.sum("x").alias("x")).toPandas()
    total = np.zeros((d + 1, d))
    total[rows["i"], rows["j"]] = rows["x"]
    n = max(1e-9, np.trace(total[:d]))  # unit vectors: the squares add up to their number
    spread = total[:d] / n - np.outer(total[d], total[d]) / n**2
    return np.linalg.eigh(spread)[1][:, ::-1][:, :axes]


def far(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], eps: float) -> bool:
    """Boxes (low, high) more than eps apart."""
    gap = np.maximum(0.0, np.maximum(a[0] - b[1], b[0] - a[1]))
    return float(gap @ gap) > eps * eps


def join_intervals(a, b, ya, yb, eps: float, threshold: float, same: bool, out: list) -> None:
    """Appends the linked pairs of two sequences of unit vectors in grid order; ya, yb: their projections."""
    stack = [(0, len(a), 0, len(b))]
    while stack:
        i0, i1, j0, j1 = stack.pop()
        if i1 <= i0 or j1 <= j0 or (same and j1 <= i0 + 1):
            continue
        pa_, pb_ = ya[i0:i1], yb[j0:j1]
        if far((pa_.min(axis=0), pa_.max(axis=0)), (pb_.min(axis=0), pb_.max(axis=0)), eps):
            continue
        if i1 - i0 <= LEAF and j1 - j0 <= LEAF:
            cos = a[i0:i1] @ b[j0:j1].T
            i, j = np.nonzero(cos >= threshold - 1e-9)
            near = np.flatnonzero(np.abs(cos[i, j] - threshold) < 1e-9)
            if len(near):  # so close to the threshold that the order of the sums matters
                good = np.ones(len(i), bool)
                good[near] = dots(a[i0 + i[near]], b[j0 + j[near]]) >= threshold
                i, j = i[good], j[good]
            i, j = i + i0, j + j0
            if same:
                i, j = i[i < j], j[i < j]
            out.append((i, j))
            continue
        im, jm = (i0 + i1) // 2 if i1 - i0 > LEAF else i1, (j0 + j1) // 2 if j1 - j0 > LEAF else j1
        stack += [(i0, im, j0, jm), (i0, im, jm, j1), (im, i1, j0, jm), (im, i1, jm, j1)]


def _grid_ordered(entries: DataFrame, d: int, axes: np.ndarray, eps: float, block: int) -> DataFrame:
    """Blocks of vectors in grid order: ``low, high`` (box), ``hs, n, x`` (binaries)."""
    p = axes.shape[1]

    def place(batches):
        for batch in batches:
            x = np.stack([np.frombuffer(v, np.float64) for v in batch.column("x").to_pylist()]) if batch.num_rows else np.zeros((0, d))
            cells = np.floor((units(x) @ axes) / eps).astype(np.int32) if len(x) else np.zeros((0, p), np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.FixedSizeListArray.from_arrays(pa.array(cells.ravel(), pa.int32()), p).cast(pa.list_(pa.int32()))], names=["h", "n", "x", "cell"])

    placed = entries.select("h", "n", "x").mapInArrow(place, "h binary, n long, x binary, cell array<int>")
    placed = materialise(placed, "cells")
    parts = max(1, -(-placed.count() // (4 * block)))
    sorted_ = placed.repartitionByRange(parts, "cell", "h").sortWithinPartitions("cell", "h")

    def cut(batches):
        rows = []
        for batch in batches:
            rows += zip(batch.column("h").to_pylist(), batch.column("n").to_pylist(), batch.column("x").to_pylist())
            while len(rows) >= block:
                yield one(rows[:block])
                rows = rows[block:]
        if rows:
            yield one(rows)

    def one(rows):
        x = np.stack([np.frombuffer(r[2], np.float64) for r in rows])
        y = units(x) @ axes
        frame = {"low": [y.min(axis=0).tolist()], "high": [y.max(axis=0).tolist()], "hs": [b"".join(r[0] for r in rows)], "n": [packed(np.array([r[1] for r in rows], np.int64))], "x": [packed(x)]}
        return pa.RecordBatch.from_pydict(frame)

    return sorted_.mapInArrow(cut, "low array<double>, high array<double>, hs binary, n binary, x binary")


def links(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD, axes: int = AXES, block: int = BLOCK) -> DataFrame:
    """``id, n_links, component_id`` of every row."""
    rows = vectors.select(F.col(id).alias("id"), F.col(vector).alias("vector"))
    d = dimension(rows, "vector")
    eps = float(np.sqrt(2 - 2 * threshold)) + 1e-7
    basis = principal_axes(rows, d, min(axes, d)) if d else np.zeros((0, 0))

    def keyed(batches):
        for batch in batches:
            x, at = matrix(batch.column("vector"), d)
            h, xs = [None] * batch.num_rows, [None] * batch.num_rows
            for k, v in zip(at.tolist(), x + 0.0):  # -0.0 becomes 0.0
                xs[k] = v.tobytes()
                h[k] = hashlib.blake2b(xs[k], digest_size=16).digest()
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(h, pa.binary()), pa.array(xs, pa.binary())], names=["id", "h", "x"])

    known = materialise(rows.mapInArrow(keyed, rows.select("id").schema.add("h", "binary").add("x", "binary")), "vectors")
    entries = materialise(known.where("h is not null").groupBy("h").agg(F.min("id").alias("first_id"), F.count("*").alias("n"), F.first("x").alias("x")), "entries")

    blocks = _grid_ordered(entries, d, basis, eps, block).withColumn("block", F.monotonically_increasing_id())
    blocks = materialise(blocks, "blocks")
    boxes = blocks.select("block", "low", "high")
    reach = min(MEETING_AXES, basis.shape[1]) if d else 0

    def cells(more: int):
        """The cells of the first axes that a box touches, or comes within ``more`` cells of."""
        out = F.array(F.array().cast("array<long>"))
        for k in range(reach):
            first, last = F.floor(F.col("low")[k] / eps) - more, F.floor(F.col("high")[k] / eps) + more
            out = F.flatten(F.transform(out, lambda done: F.transform(F.sequence(first, last), lambda c: F.concat(done, F.array(c)))))  # noqa: B023
        return F.explode(out)

    left = boxes.select("block", "low", "high", cells(0).alias("cell")).toDF("a", "low_a", "high_a", "cell")
    right = boxes.select("block", "low", "high", cells(1).alias("cell")).toDF("b", "low_b", "high_b", "cell")
    gap = lambda x, y: F.greatest(F.lit(0.0), x - y)
    apart = F.zip_with(F.zip_with("low_a", "high_b", gap), F.zip_with("low_b", "high_a", gap), lambda x, y: F.greatest(x, y))
    distance = F.aggregate(apart, F.lit(0.0), lambda s, v: s + v * v)
    pairs = left.join(right, "cell").where((F.col("a") <= F.col("b")) & (distance <= eps * eps)).select("a", "b").distinct()
    data = blocks.select("block", "hs", "n", "x")
    pairs = pairs.join(data.toDF("a", "hs_a", "n_a", "x_a"), "a").join(data.toDF("b", "hs_b", "n_b", "x_b"), "b")

    def work(batches):
        for batch in batches:
            for row in batch.to_pylist():
                a, b = (units(np.frombuffer(row[f"x_{s}"], np.float64).reshape(-1, d)) for s in "ab")
                n_a, n_b = (np.frombuffer(row[f"n_{s}"], np.int64).astype(np.float64) for s in "ab")
                same = row["a"] == row["b"]
                found: list = []
                join_intervals(a, b, a @ basis, b @ basis, eps, threshold, same, found)
                i = np.concatenate([np.zeros(0, np.int64), *(f[0] for f in found)])
                j = np.concatenate([np.zeros(0, np.int64), *(f[1] for f in found)])
                hs = [row["hs_a"][k : k + 16] for k in range(0, len(row["hs_a"]), 16)]
                near = np.bincount(i, n_b[j], len(a))
                if same:
                    near += np.bincount(j, n_a[i], len(a))
                else:
                    near = np.r_[near, np.bincount(j, n_a[i], len(b))]
                    hs += [row["hs_b"][k : k + 16] for k in range(0, len(row["hs_b"]), 16)]
                    j = j + len(a)
                root = local_roots(len(hs), i, j)
                out = np.flatnonzero(near > 0)
                frame = pd.DataFrame({"h": [hs[k] for k in out], "root": [hs[k] for k in root[out]], "links": near[out].astype(np.int64)})
                yield pa.RecordBatch.from_pandas(frame, schema=pa.schema([("h", pa.binary()), ("root", pa.binary()), ("links", pa.int64())]), preserve_index=False)

    found = materialise(pairs.mapInArrow(work, "h binary, root binary, links long"), "links")
    near = found.groupBy("h").agg(F.sum("links").alias("near"))
    group = components(found.select(F.col("h").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "h")
    texts = entries.select("h", "n", "first_id").join(near, "h", "left").join(group, "h", "left")
    texts = materialise(texts.select("h", "n", "first_id", F.coalesce("near", F.lit(0)).alias("near"), F.coalesce("root", "h").alias("root")), "found")
    heads = texts.groupBy("root").agg(F.min("first_id").alias("component_id"))
    texts = texts.join(heads, "root").select("h", (F.col("near") + F.col("n") - 1).alias("links"), "component_id")
    return known.select("id", "h").join(texts, "h", "left").select(
        "id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("links").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id")
    )
