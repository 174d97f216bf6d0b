"""The stages on awkward rows, and the whole run against its parts."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from augury.llm import bpe, jaccard, langid, mixing, pii
from augury.session import materialise


def test_stages_on_awkward_rows(spark, tricky):
    docs = tricky
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        after = materialise(stage(spark, docs, ""), "stage")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert after.columns == docs.columns and [f.dataType for f in after.schema] == [f.dataType for f in docs.schema]
        else:
            assert after.columns == ["doc_id", "lang", "source", "n_tokens", "ids"]
        assert after.count() > 0
        docs = after


def test_stages_on_nothing(spark, nothing):
    docs = nothing
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        assert docs.count() == 0


def test_run_against_plain_python(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = sorted((r["doc_id"], r["n_tokens"], bytes(r["ids"])) for r in corpus_pipeline.run(spark, sf).collect())
    shares, _ = langid.proportions(langid.learn(docs), [r["text"] for r in docs.orderBy("doc_id").collect()])
    n_letters = lambda t: sum(map(str.isalpha, t or ""))
    rows = [
        r for r, s in zip(docs.orderBy("doc_id").collect(), shares)
        if 0 < n_letters(r["text"]) < corpus_pipeline.FEW_LETTERS or (n_letters(r["text"]) and s.sum() >= corpus_pipeline.LEAST_SCORE)
    ]
    known = {r["doc_id"] for r in rows}
    classes = {r["id"]: r["class_id"] for r in jaccard.classes(docs.where(F.col("doc_id").isin(list(known)))).collect()}
    rows = [r for r in rows if classes[r["doc_id"]] == r["doc_id"]]
    field = pii.learn(spark.createDataFrame(rows, docs.schema))
    texts = [pii.mask(r["text"], x) for r, x in zip(rows, pii.find([r["text"] for r in rows], field))]
    masked = spark.createDataFrame([(r["doc_id"], t, r["source"]) for r, t in zip(rows, texts)], "doc_id long, text string, source string")
    copies = {r["id"]: r["copies"] for r in mixing.mix(masked, importance=mixing.length_importance()).collect()}
    vocab = bpe.vocabulary(bpe.default_path())
    expected = []
    for r, ids in zip(rows, vocab.encode(texts)):
        expected += [(r["doc_id"], len(ids), ids.astype("<u4").tobytes())] * copies[r["doc_id"]]
    assert got == sorted(expected)
