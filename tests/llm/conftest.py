from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, h string, rank int, spans string, score double"


def rows_with_everything():
    """NULLs in every column, empty and long texts, ties, repeated rows, and columns named like those that operators add."""
    draw = random.Random(4)
    words = {"en": "the of and to with there over little house water under".split(), "de": "der die und nicht haus wasser über klein straße auch".split()}

    def prose(lang, n):
        return " ".join(draw.choice(words[lang]) + draw.choice(["", "", "s", "er", "en"]) for _ in range(n))

    texts = [(prose(lang, draw.randint(5, 80)), lang) for lang in ("en", "de") for _ in range(14)]
    near = prose("en", 120)
    texts += [(near, "en"), (near + " tail", "en"), (near.replace("the", "THE", 1), "en"), (near, "en")]
    texts += [("", "en"), (None, "de"), (" \t\n", None), ("12345 !!", "en"), ("a b", "en"), ("a  b", "en"), ("naïve wörd\x00 end", None)]
    texts += [("mail a.b@mail.example.com or +1 (743) 555-3824, ip 10.0.0.1, card 4465758382889437", "en")]
    texts += [(prose("en", 30_000), "en"), ("x" * 3000, "en"), ("ab" * 1500, "de"), ("<|endoftext|> it's we'll '' 's\n\n  end ", "en")]
    rows = []
    for k, (t, lang) in enumerate(texts):
        rows.append((k, t, lang, ["s1", "s2", None][k % 3], None if k % 5 == 0 else len(t or ""), 7, "clash", 1, "clash", 0.5))
    rows += [rows[3], rows[3], (None, prose("en", 40), "en", "s1", 9, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None)]
    return rows


@pytest.fixture(scope="session")
def tricky(spark):
    return spark.createDataFrame(rows_with_everything(), SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def sample(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
