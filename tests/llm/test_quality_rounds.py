"""Co-training over the whole table: what is exchanged, against a plain version."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from augury.llm import quality


def table(spark, n=30):
    draw = np.random.default_rng(3)
    words = {1: "house river water garden morning".split(), 0: "click buy free win cash".split()}
    rows = []
    for i in range(n):
        y = int(draw.random() < 0.5)
        text = " ".join(draw.choice(words[y] + ["the", "of"]) for _ in range(12))
        rows.append((i, text, f"s{y}" if i % 4 else "s9", "en", len(text)))
    rows += [rows[-1], rows[-1], (None, rows[-2][1] + " x", "s0", None, None)]
    truth = [int("house" in r[1] or "river" in r[1] or "water" in r[1] or "garden" in r[1]) for r in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long")
    labels = spark.createDataFrame([(i, truth[i]) for i in range(12)] + [(0, None)], "doc_id long, quality int")
    return docs, labels


def test_surest_of_all_rows(spark):
    docs, labels = table(spark)
    features = quality.extracted(docs).cache()
    known = labels.where("quality is not null").select(F.col("doc_id").alias("id"))
    draw = np.random.default_rng(1)
    weights = [draw.standard_normal(quality.WORD_CELLS), draw.standard_normal(quality.META_CELLS)]
    rows = features.toArrow()
    odds = [np.round(r.dot(w), 9) for r, w in zip(quality.rows_in(rows), weights)]
    labelled = {r["id"] for r in known.collect()}
    free = {k: (odds[0][i], odds[1][i]) for i, (k, d) in enumerate(zip(rows["key"].to_pylist(), rows["id"].to_pylist())) if d not in labelled}
    seen = sorted(free)[:2]
    got = {tuple(r) for r in quality.surest_of(features, known, seen, weights, 3, 4).collect()}
    expected = set()
    for v in (0, 1):
        for label, sign, n in ((1, -1, 3), (0, 1, 4)):
            order = sorted((sign * z[v], k) for k, z in free.items() if k not in seen and sign * z[v] < 0)
            expected |= {(v, label, k) for _, k in order[:n]}
    assert got == expected and len(free) == 19  # the repeated row is one candidate, the row without an id is another


def test_a_round_by_hand(spark):
    docs, labels = table(spark)
    taken = []
    plain = quality.surest_of
    def noted(*args):
        out = plain(*args)
        taken.append([tuple(r) for r in out.collect()])
        return out
    try:
        quality.surest_of = noted
        model = quality.learn(docs, labels, exchanged=6, rounds=2)
    finally:
        quality.surest_of = plain
    first, second = ({k for _, _, k in t} for t in taken)
    assert first and not first & second
    # One round written out: fit on the labelled rows, add what the other view is surest of, fit again.
    one = quality.learn(docs, labels, exchanged=6, rounds=1)
    rows = quality.extracted(docs).toArrow()
    x, m = quality.rows_in(rows)
    by_id, by_key = {d: i for i, d in enumerate(rows["id"].to_pylist())}, {k: i for i, k in enumerate(rows["key"].to_pylist())}
    truth = {r["doc_id"]: r["quality"] for r in labels.where("quality is not null").collect()}
    hashes = {r["doc_id"]: r["h"] for r in labels.select("doc_id", F.xxhash64(F.lit("quality"), "doc_id").alias("h")).collect()}
    learnt = [(by_id[d], truth[d], 1.0) for d in sorted(truth, key=lambda d: hashes[d]) if hashes[d] % 4 != 0]
    fitted = []
    for v, view, size in ((0, x, quality.WORD_CELLS), (1, m, quality.META_CELLS)):
        own = learnt + [(by_key[k], label, 0.5) for w, label, k in taken[0] if w != v]
        at, y, sure = (np.array(c) for c in zip(*own))
        share = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
        fitted.append(quality.logistic(view.pick(at), y.astype(float), share * sure, size))
    assert np.allclose(one.content, fitted[0], atol=1e-6) and np.allclose(one.metadata, fitted[1], atol=1e-6)
    assert len(model.content) == quality.WORD_CELLS


def test_a_rare_source_is_learnt(spark):
    """No labelled document has the source; the content view names its documents, and the metadata view learns it."""
    docs, labels = table(spark, 60)
    rare = docs.where("doc_id >= 12").withColumn("source", F.when(F.col("text").rlike("click|cash|free"), "rare").otherwise(F.col("source")))
    model = quality.learn(docs.where("doc_id < 12").unionByName(rare), labels, exchanged=30, rounds=2)
    plain = quality.learn(docs.where("doc_id < 12").unionByName(rare), labels, rounds=0)
    cell = quality.metadata(["rare"], [None], [None]).cell[1]
    assert plain.metadata[cell] == 0 and model.metadata[cell] < 0
