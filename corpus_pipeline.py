"""The corpus pipeline over ``documents``: each stage's result is written and read again as the next one's input.

Every stage but the last returns the columns of its input. NULLs, empty texts, repeated rows, empty tables and extra columns are
handled as the operators say; the stages keep whole rows, whatever columns they have.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from augury.llm import bpe, jaccard, langid, mixing, pii
from augury.session import materialise

LEAST_SCORE = 0.3  # proportion of all languages together below which a text counts as noise
FEW_LETTERS = 60  # with fewer the proportion says too little to reject a text
ORACLE_SQL = None  # language models, the field and the tokenizer are beyond SQL; tests compare with brute force


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one or more languages. Texts without letters go, and those of ``FEW_LETTERS`` and more that are mostly noise."""
    found = langid.identify(docs, langid.learn(docs), keep=(F.struct("*").alias("__doc"),))
    known = F.aggregate(F.map_values("langs"), F.lit(0.0), lambda total, share: total + share)
    few = F.col("n_letters").between(1, FEW_LETTERS - 1)
    return found.where(few | ((F.col("n_letters") > 0) & (known >= LEAST_SCORE))).select("__doc.*")


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: the one with the smallest id."""
    return jaccard.keep_one(docs)


def masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; a given number of characters follows the new text."""
    found = pii.tag(docs, pii.learn(docs), keep=(F.struct("*").alias("__doc"),), masked=True)
    new = {"text": F.col("masked"), "n_chars": F.when(F.col("__doc.n_chars").isNotNull(), F.length("masked").cast("long")) if "n_chars" in docs.columns else None}
    return found.select(*[new[c].alias(c) if c in new else F.col("__doc")[c].alias(c) for c in docs.columns])


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    return mixing.take(docs, mixing.mix(docs, importance=mixing.length_importance()))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, lang, source, n_tokens, ids`` of every document of the mix."""
    return bpe.encode(docs, keep=("doc_id", "lang", "source"))


STAGES = [
    ("language ID", known_language),
    ("n-gram Jaccard join", one_of_each),
    ("PII", masked),
    ("mixing", mixed),
    ("BPE", encoded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, "pipeline")
    return docs
