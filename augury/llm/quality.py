"""Quality classification by co-training on two views.

The content view is the text: hashed words, letter case, punctuation, repetition, lines and blanks. The metadata view is
what is known without reading it: source, language and given length, alone and in pairs. Each view has a logistic
classifier. In every round both classifiers score all unlabelled documents on Spark; the ``EXCHANGED`` distinct ones of the whole table that
each is surest of, in the labelled classes' proportions, join the labelled set of the other. At the end each view's log-odds are
calibrated on labelled documents that were held back, and a logistic combination of both scores all documents.

Bounded are the labelled documents learnt from (``LABELLED``, chosen by hash, twice that at most) and those exchanged in a
round; every unlabelled document is a candidate, at every size. Features are extracted once and written.

Cases: a NULL or empty text has no words and is scored from what is left; NULL source, language and length are values of
their own; contradicting labels of one document count as separate examples; labels that are NULL are left out; without labels of both kinds every score
is the share of good labels, or 0.5. Rows that are alike in all columns used are one candidate and get equal scores; of
equally sure ones the smaller hash of these columns goes first; ids play no part, and rows without an id are candidates too;
other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from augury.llm.common import hashed_sample, slices, small_batches, spread, starts_of
from augury.session import materialise

LABELLED = 4000  # bound of the labelled rows the classifiers are fitted to
EXCHANGED = 200  # documents that each classifier labels in a round
ROUNDS = 5
WORD_CELLS, META_CELLS = 1 << 15, 1 << 10
UNIT = 1_000_000
WORDS_KEPT = 200_000
OWN_CELLS = 128  # content cells that are not words


class Cells(dict):
    """Word to feature cell, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > WORDS_KEPT:
            self.clear()
        at = self[word] = zlib.crc32(word) % (WORD_CELLS - OWN_CELLS) + OWN_CELLS
        return at


@dataclass
class Rows:
    """Sparse rows: cells and values of row k are at[k]..at[k + 1]."""

    at: np.ndarray
    cell: np.ndarray
    value: np.ndarray

    def pick(self, rows: np.ndarray) -> "Rows":
        sizes = np.diff(self.at)[rows]
        take = spread(self.at[:-1][rows], sizes)
        return Rows(starts_of(sizes), self.cell[take], self.value[take])

    def dot(self, w: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0.0], np.cumsum(self.value * w[self.cell])])
        return total[self.at[1:]] - total[self.at[:-1]]

    def grad(self, d: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(self.cell, self.value * np.repeat(d, np.diff(self.at)), n)


def content(texts: list[str], cells: Cells) -> Rows:
    """Square roots of word shares, and in the first cells a few shares of characters and words and the form of the page."""
    at, cell, value = [0], [], []
    for t in texts:
        raw = t.encode("utf-8", "surrogatepass")
        words = raw.split()
        n = max(1, len(words))
        ids, counts = np.unique(np.fromiter((cells[w] for w in words), np.int64, len(words)), return_counts=True)
        size = max(1, len(raw))
        upper = len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
        marks = len(raw) - len(raw.translate(None, b"!?#$%&*|<>{}[]=_~^\\/"))
        digits = len(raw) - len(raw.translate(None, b"0123456789"))
        shape = [1.0, upper / size, marks / size, digits / size, len(ids) / n, min(2.0, size / n / 10), float(len(words) == 0)]
        lines = t.count("\n") + 1
        grade = [int(min(15, 40 * marks / size)), 16 + int(min(15, 20 * upper / size)), 32 + int(min(15, 15 * len(ids) / n))]
        grade += [48 + min(15, lines.bit_length()), 64 + min(15, (len(t) // lines).bit_length()), 80 + min(20, 20 * t.count(" ") // max(1, len(t)))]
        cell += [np.arange(len(shape)), np.array([8 + g for g in grade]), ids]
        value += [np.array(shape), np.ones(len(grade)), 2 * np.sqrt(counts / n)]
        at.append(at[-1] + len(shape) + len(grade) + len(ids))
    return Rows(np.array(at), np.concatenate([*cell, np.zeros(0, np.int64)]), np.concatenate([*value, np.zeros(0)]))


def metadata(sources: list, langs: list, sizes: list) -> Rows:
    """Hashed source, language and step of the given length, alone and in pairs."""
    rows = []
    for source, lang, size in zip(sources, langs, sizes):
        step = None if size is None else int(abs(size)).bit_length()
        names = ["bias", f"source {source}", f"lang {lang}", f"length {step}", f"both {source} {lang}", f"longer {source} {step}"]
        rows.append([zlib.crc32(x.encode("utf-8", "surrogatepass")) % META_CELLS for x in names])
    n = len(rows[0]) if rows else 0
    return Rows(np.arange(len(rows) + 1) * n, np.array(rows, np.int64).ravel(), np.ones(len(rows) * n))


def logistic(x: Rows, y: np.ndarray, weight: np.ndarray, n: int, rounds: int = 60, rate: float = 0.5, decay: float = 1e-4) -> np.ndarray:
    w, past = np.zeros(n), np.full(n, 1e-8)
    total = max(1e-9, weight.sum())
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x.dot(w), -30, 30)))
        g = x.grad(weight * (p - y) / total, n) + decay * w
        past += g * g
        w -= rate * g / np.sqrt(past)
    return w


@dataclass
class Model:
    """Weights of both views, their calibrations (slope, offset), and the weights of (content, metadata, 1)."""

    content: np.ndarray
    metadata: np.ndarray
    calibration: np.ndarray
    combination: np.ndarray

    def scores(self, x: Rows, m: Rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probability of good quality from the content, from the metadata, and from both."""
        z = np.column_stack([x.dot(self.content), m.dot(self.metadata)]) * self.calibration[:, 0] + self.calibration[:, 1]
        both = np.clip(np.column_stack([z, np.ones(len(z))]) @ self.combination, -30, 30)
        z = np.clip(z, -30, 30)
        return 1 / (1 + np.exp(-z[:, 0])), 1 / (1 + np.exp(-z[:, 1])), 1 / (1 + np.exp(-both))


def dense_logistic(z: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 25) -> np.ndarray:
    """Newton steps for a few columns; positive slopes are not forced."""
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w))
        w -= np.linalg.solve(h, z.T @ (p - y) + ridge * w)
    return w


@dataclass
class Examples:
    """Rows in both views with their labels: 1 good, 0 bad."""

    views: tuple[Rows, Rows]
    label: np.ndarray


def joined(a: Rows, b: Rows) -> Rows:
    return Rows(np.concatenate([a.at, a.at[-1] + b.at[1:]]), np.concatenate([a.cell, b.cell]), np.concatenate([a.value, b.value]))


Surest = Callable[[list[np.ndarray], int, int], list[Examples]]


def co_train(known: Examples, held: np.ndarray, surest: Surest, rounds: int = ROUNDS, exchanged: int = EXCHANGED) -> Model:
    """``held`` rows are kept for calibration. ``surest(weights, good, bad)``: for each view so many new documents that it is
    surest of, with its labels; they join what the other view learns from at half the weight."""
    flat = np.array([[1.0, 0.0], [1.0, 0.0]])
    y, free = known.label, ~held
    share = y.mean() if len(y) else 0.5
    if len(np.unique(y[free])) < 2:
        odds = np.log(max(share, 1e-3) / max(1 - share, 1e-3))
        return Model(np.zeros(WORD_CELLS), np.zeros(META_CELLS), flat, np.array([0.0, 0.0, odds]))
    rows = np.flatnonzero(free)
    learnt = [known.views[v].pick(rows) for v in (0, 1)]
    truth, sure = [y[rows], y[rows]], [np.ones(len(rows)), np.ones(len(rows))]

    def fit(v: int) -> np.ndarray:
        t = truth[v]
        weight = np.where(t == 1, 0.5 / max(1, (t == 1).sum()), 0.5 / max(1, (t == 0).sum()))
        return logistic(learnt[v], t, weight * sure[v], (WORD_CELLS, META_CELLS)[v])

    weights = [fit(0), fit(1)]
    for _ in range(rounds):
        good = int(exchanged * share)
        for v, new in enumerate(surest(weights, good, exchanged - good)):
            other = 1 - v
            learnt[other] = joined(learnt[other], new.views[other])
            truth[other] = np.concatenate([truth[other], new.label])
            sure[other] = np.concatenate([sure[other], np.full(len(new.label), 0.5)])
        weights = [fit(0), fit(1)]
    back = np.flatnonzero(held)
    if len(np.unique(y[back])) < 2:
        back = rows
    z = np.column_stack([known.views[v].pick(back).dot(weights[v]) for v in (0, 1)])
    one = np.ones((len(z), 1))
    calibration = np.array([dense_logistic(np.column_stack([z[:, v : v + 1], one]), y[back]) for v in (0, 1)])
    z = z * calibration[:, 0] + calibration[:, 1]
    return Model(weights[0], weights[1], calibration, dense_logistic(np.column_stack([z, one]), y[back]))


_COLUMNS = ["text", "source", "lang", "n_chars"]


def _views(docs: DataFrame) -> DataFrame:
    """The columns of both views, NULL where the table has none."""
    have = set(docs.columns)
    kinds = {"text": "string", "source": "string", "lang": "string", "n_chars": "long"}
    return docs.select("*", *[(F.col(c) if c in have else F.lit(None)).cast(kinds[c]).alias(f"__{c}") for c in _COLUMNS])


FEATURES = "xc array<int>, xv array<float>, mc array<int>, mv array<float>"


def extracted(docs: DataFrame, id: str = "doc_id") -> DataFrame:
    """``id``, ``key`` (a hash of the columns used) and the features of both views of every document."""
    small_batches(docs)
    wanted = [f"__{c}" for c in _COLUMNS]
    rows = _views(docs).select(F.col(id).cast("long").alias("__id"), F.xxhash64(*wanted).alias("__key"), *wanted)

    def work(batches):
        cells = Cells()
        for batch in slices(batches, "__text", UNIT):
            parts = []
            for r in _features(batch, cells):
                at = pa.array(r.at, pa.int32())
                parts += [pa.ListArray.from_arrays(at, pa.array(r.cell, pa.int32())), pa.ListArray.from_arrays(at, pa.array(r.value, pa.float32()))]
            yield pa.RecordBatch.from_arrays([batch.column("__id"), batch.column("__key"), *parts], names=["id", "key", "xc", "xv", "mc", "mv"])

    return rows.mapInArrow(work, f"id long, key long, {FEATURES}")


def rows_in(table: pa.Table | pa.RecordBatch) -> tuple[Rows, Rows]:
    """The features of both views."""
    out = []
    for c in "xm":
        lists, values = (x.combine_chunks() if isinstance(x := table[c + k], pa.ChunkedArray) else x for k in "cv")
        sizes = np.array(lists.value_lengths().to_numpy(zero_copy_only=False), np.int64)
        out.append(Rows(starts_of(sizes), lists.flatten().to_numpy().astype(np.int64), values.flatten().to_numpy().astype(np.float64)))
    return out[0], out[1]


def surest_of(features: DataFrame, labels: DataFrame, seen: list[int], weights: list[np.ndarray], good: int, bad: int) -> DataFrame:
    """``view, label, key`` of the distinct documents without a label that each view is surest of, over the whole table.

    ``seen``: keys exchanged before, a bounded number. A view names a document good only above even odds, bad only below.
    """

    def work(batches):
        for batch in batches:
            # Rounded, so that the odds of like rows are equal wherever they lie in a batch.
            z = [pa.array(np.round(r.dot(w), 9)) for r, w in zip(rows_in(batch), weights)]
            yield pa.RecordBatch.from_arrays([batch["id"], batch["key"], *z], names=["id", "key", "z0", "z1"])

    odds = features.mapInArrow(work, "id long, key long, z0 double, z1 double")
    fresh = odds.where(~F.col("key").isin(seen)) if seen else odds
    fresh = fresh.join(labels.select("id").distinct(), "id", "left_anti").groupBy("key").agg(F.min("z0").alias("z0"), F.min("z1").alias("z1"))
    fresh = materialise(fresh, "odds")
    parts = []
    for v in (0, 1):
        z = F.col(f"z{v}")
        for label, rows, order, n in ((1, fresh.where(z > 0), z.desc(), good), (0, fresh.where(z < 0), z.asc(), bad)):
            parts.append(rows.orderBy(order, "key").limit(n).select(F.lit(v).alias("view"), F.lit(label).alias("label"), "key"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def learn(docs: DataFrame, labels: DataFrame, id: str = "doc_id", quality: str = "quality", labelled: int = LABELLED, exchanged: int = EXCHANGED, rounds: int = ROUNDS) -> Model:
    """Co-trains on a hashed sample of the labelled documents and, round by round, on the surest ones of all the others."""
    features = materialise(extracted(docs, id), "features")
    known = labels.where(F.col(quality).isNotNull()).select(F.col(id).cast("long").alias("id"), F.col(quality).cast("double").alias("y"))
    # At most 2 * labelled rows are broadcast; repeated rows teach once, so the bound holds for the result too.
    picked = F.broadcast(hashed_sample(known.where("id is not null").distinct(), labelled, "id"))
    got = features.join(picked, "id").dropDuplicates(["id", "y"]).withColumn("draw", F.xxhash64(F.lit("quality"), "id"))
    got = got.toArrow().combine_chunks().sort_by([("draw", "ascending"), ("y", "ascending"), ("key", "ascending")])
    seen: list[int] = []

    def surest(weights: list[np.ndarray], good: int, bad: int) -> list[Examples]:
        # 2 * exchanged rows at most.
        chosen = surest_of(features, known, seen, weights, good, bad).toPandas()
        seen.extend(sorted(set(chosen["key"].tolist()) - set(seen)))
        keys = features.sparkSession.createDataFrame([(k,) for k in sorted(set(chosen["key"].tolist()))], "key long")
        rows = features.join(F.broadcast(keys), "key").dropDuplicates(["key"]).toArrow().combine_chunks().sort_by("key")
        views, at = rows_in(rows), rows["key"].to_numpy()
        out = []
        for v in (0, 1):
            own = chosen[chosen["view"] == v]
            where = np.searchsorted(at, own["key"].to_numpy())
            out.append(Examples((views[0].pick(where), views[1].pick(where)), own["label"].to_numpy().astype(float)))
        return out

    return co_train(Examples(rows_in(got), got["y"].to_numpy()), got["draw"].to_numpy() % 4 == 0, surest, rounds, exchanged)


def _features(batch: pa.RecordBatch, cells: Cells) -> tuple[Rows, Rows]:
    texts = [t or "" for t in batch.column("__text").to_pylist()]
    return content(texts, cells), metadata(*(batch.column(f"__{c}").to_pylist() for c in _COLUMNS[1:]))


def score(docs: DataFrame, model: Model, keep: tuple = ("doc_id",)) -> DataFrame:
    """``keep`` columns, ``quality`` from both views, ``content_score`` and ``metadata_score``, all from 0 to 1."""
    small_batches(docs)
    schema = docs.select(*keep).schema.add("quality", "double").add("content_score", "double").add("metadata_score", "double")

    def work(batches):
        cells = Cells()
        for batch in slices(batches, "__text", UNIT):
            a, b, both = model.scores(*_features(batch, cells))
            yield pa.RecordBatch.from_arrays([*batch.columns[: -len(_COLUMNS)], pa.array(both), pa.array(a), pa.array(b)], names=schema.names)

    return _views(docs).select(*keep, *[f"__{c}" for c in _COLUMNS]).mapInArrow(work, schema)
