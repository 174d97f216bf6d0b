"""The language stage rejects noise, not mixtures or short texts."""

from __future__ import annotations

import random

from augury.llm import langid
from corpus_pipeline import FEW_LETTERS, LEAST_SCORE, known_language

ALPHABETS = {"aa": "abcdef", "bb": "ghijkl", "cc": "mnopqr", "dd": "stuvwx"}


def prose(draw, lang, n):
    return " ".join("".join(draw.choice(ALPHABETS[lang]) for _ in range(5)) for _ in range(n))


def test_mixtures_and_short_texts_stay(spark):
    draw = random.Random(5)
    rows = [(f"{lang}{k}", prose(draw, lang, 200), lang) for lang in ALPHABETS for k in range(5)]
    mixture = " ".join(prose(draw, lang, 100) for lang in ALPHABETS)
    noise = " ".join("".join(chr(draw.randint(0x4E00, 0x9FFF)) for _ in range(6)) for _ in range(100))
    short = "".join(chr(draw.randint(0x4E00, 0x9FFF)) for _ in range(FEW_LETTERS - 10))
    rows += [("mixture", mixture, None), ("short", short, None), ("none", "12 !!", None), ("null", None, None), ("noise", noise, None)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, lang string")
    shares, letters = langid.proportions(langid.learn(docs), [mixture, short])
    assert shares[0].max() < LEAST_SCORE < shares[0].sum() and shares[1].max() < LEAST_SCORE and 0 < letters[1] < FEW_LETTERS
    kept = {r["doc_id"] for r in known_language(spark, docs, "").collect()}
    assert kept == {r[0] for r in rows} - {"none", "null", "noise"}
