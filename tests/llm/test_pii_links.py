"""Labels carried along links: planted mentions, clean documents, message passing against enumeration."""

from __future__ import annotations

import numpy as np
import pytest

from augury.llm import pii


@pytest.fixture(scope="module")
def field():
    kinds = [lambda k: f"+1 ({200 + k}) 555-{1000 + k}", lambda k: f"+44 20 7946 {1000 + k}", lambda k: f"a{k}@mail.example.com", lambda k: f"10.0.{k}.7"]
    return pii.fit([f"call {kinds[k % 4](k)} today or order {88_000_000 + 17 * k}, not {k} or {1000 + k}" for k in range(240)])


def spans(field, text):
    return [(pii.KINDS[k], text[a:b], base) for k, a, b, base in pii.find([text], field)[0]]


def test_one_clear_mention_settles_the_bare_ones(field):
    text = "write to +1 (743) 555-3824 or 17435553824, " + "some other words " * 40 + "then 743-555-3824 and at last 17435553824 again"
    assert spans(field, text) == [("phone", "+1 (743) 555-3824", True)] + [("phone", t, False) for t in ("17435553824", "743-555-3824", "17435553824")]
    before = "dial 17435553824 which is +1 (743) 555-3824 in full"
    assert spans(field, before)[0] == ("phone", "17435553824", False)
    spaced = "ring +44 20 7946 1234 or 442079461234"
    assert spans(field, spaced)[-1] == ("phone", "442079461234", False)


def test_many_mentions_of_one_value(field):
    text = "+1 (743) 555-3824 " + "and then 17435553824 " * 200
    assert len(spans(field, text)) == 201


@pytest.mark.parametrize("text", ["order 17435553824 and again 17435553824", "+1 743 555 2024 came in 2024 with 2024 items", "99 of 100 in 1999, 12345678 twice 12345678", ""])
def test_nothing_is_added_without_a_clear_mention(field, text):
    assert not [s for s in spans(field, text) if not s[2]]


def test_links_join_values_not_forms():
    text = "+1 (743) 555-3824 x 17435553824 y 3824 z 3824 MAIL@a.b mail@a.b."
    g = pii.graph_of([text], [pii.base_spans(text)])
    words = [text[a:b] for a, b in zip(g.start, g.end)]
    assert {(words[a], words[b]) for a, b in g.skip} == {("555-3824", "17435553824")}  # the two addresses are neighbours


def enumerated(field, g):
    n, k = len(g.text), field.unary.shape[1]
    unary, p = field.unary[g.cells].sum(axis=1), np.zeros((n, k))
    for labels in np.ndindex(*[k] * n):
        if any(f and f != a for f, a in zip(g.fixed, labels)):
            continue
        w = sum(unary[i, a] for i, a in enumerate(labels) if not g.fixed[i])
        w += sum(field.chain[labels[a], labels[b]] for a, b in g.chain) + sum(field.skip[labels[a], labels[b]] for a, b in g.skip)
        for i, a in enumerate(labels):
            p[i, a] += np.exp(w)
    return p / p.sum(axis=1, keepdims=True)


@pytest.mark.parametrize("skip, close", [([(0, 3)], 1e-6), ([(0, 2), (2, 4)], 0.05)])
def test_message_passing_with_skip_links(skip, close):
    draw = np.random.default_rng(8)
    k, n = len(pii.KINDS) + 1, 5
    even = lambda s: (lambda a: s * (a + a.T))(draw.standard_normal((k, k)))
    field = pii.Field(draw.standard_normal((pii.CELLS, k)) / 2, even(0.2), even(0.2) + np.eye(k))
    chain = [(0, 1), (1, 2)] if len(skip) == 1 else [(0, 1), (1, 2), (2, 3), (3, 4)]  # a tree, then two loops
    g = pii.Graph(np.zeros(n, int), np.arange(n), np.arange(n), draw.integers(0, pii.CELLS, (n, pii.FEATURES)), np.array([0, 0, 0, 2, 0]), np.array(chain), np.array(skip))
    assert np.abs(pii.marginals(field, g, tolerance=1e-9) - enumerated(field, g)).max() < close


def test_masks_take_the_added_spans(spark, field):
    docs = spark.createDataFrame([(1, "a +1 (743) 555-3824 b 17435553824 c"), (2, "order 17435553824 alone"), (3, None)], "doc_id long, text string")
    got = {r["doc_id"]: r["masked"] for r in pii.tag(docs, field, masked=True).collect()}
    assert got == {1: "a [PHONE] b [PHONE] c", 2: "order 17435553824 alone", 3: None}
