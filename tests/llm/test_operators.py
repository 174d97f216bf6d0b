"""Every text operator on awkward rows, and against brute force."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from math import log10

import numpy as np
import pytest
from pyspark.sql import functions as F

from augury.llm import bpe, jaccard, langid, lm, mixing, pii, quality, suffix
from augury.llm.common import in_fold

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def collected(df):
    return df.select("doc_id", "text", "lang", "source").collect()


# ---------------------------------------------------------------- 2, suffix arrays


def brute_removed(texts, length):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(raw[k : k + length] for raw in raws for k in range(len(raw) - length + 1))
    out = []
    for raw in raws:
        mark = bytearray(len(raw))
        for k in range(len(raw) - length + 1):
            if seen[raw[k : k + length]] > 1:
                mark[k : k + length] = b"\1" * length
        out.append((len(raw), sum(mark), len(re.findall(rb"\x01+", bytes(mark))), hashlib.sha256(bytes(b for b, m in zip(raw, mark) if not m)).hexdigest()))
    return out


def removed(df, **options):
    got = suffix.dedup(df, **options).select("id", "n_bytes", "spans", F.sha2("kept", 256).alias("kept")).collect()
    return sorted((str(r["id"]), r["n_bytes"], sum(s["end"] - s["start"] for s in r["spans"]), len(r["spans"]), r["kept"]) for r in got)


@pytest.mark.parametrize("shard", [4000, 2])
def test_suffix_dedup(tricky, shard):
    rows = [r for r in collected(tricky)]
    expected = brute_removed([r["text"] for r in rows], 200)
    assert removed(tricky, shard=shard) == sorted((str(r["doc_id"]), *e) for r, e in zip(rows, expected))


def test_suffix_dedup_of_nothing(nothing):
    assert removed(nothing) == []


def test_suffix_arrays_and_prefixes():
    draw = np.random.default_rng(0)
    for _ in range(30):
        parts = [bytes(draw.choice([0, 1, 97], draw.integers(1, 50)).astype(np.uint8)) for _ in range(6)]
        shard = suffix.Shard(parts, 16)
        ranked = [[c + 9 for c in shard.data[i : shard.stop[i]]] + [int(np.searchsorted(shard.starts, i, side="right")) - 9] for i in range(len(shard.data))]
        assert shard.array.tolist() == sorted(range(len(ranked)), key=lambda i: ranked[i])
        strings = [bytes(shard.data[i : i + 16]) for i in shard.strings()]
        assert shard.repeated().tolist() == [strings.count(s) > 1 for s in strings]
        other = suffix.Shard([parts[0], b"q" * 20], 16)
        assert shard.found_in(other).tolist() == [s in parts[0] for s in strings]


# ---------------------------------------------------------------- 3, language model


def test_base_scores_and_model(tricky):
    rows = collected(tricky)
    held = lambda r: r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2
    lower = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    tokens = lambda r: [*WORD.findall((r["text"] or "").translate(lower)), "\n"]
    counts = Counter(w for r in rows if not held(r) for w in tokens(r))
    n, v = sum(counts.values()), len(counts)
    expected = sorted((str(r["doc_id"]), held(r), len(t := tokens(r)), sum(counts[w] > 0 for w in t), n, round(sum(log10((counts[w] + 1) / (n + v + 1)) for w in t), 6)) for r in rows)
    got = lm.score(tricky, in_fold("doc_id", 7, 2)).collect()
    assert sorted((str(r[0]), r[1], r[2], r[3], r[4], round(r[5], 6)) for r in got) == expected
    assert all(np.isfinite(r["score"]) and r["score"] < 0 for r in got)


def test_model_of_nothing(nothing):
    assert lm.score(nothing, in_fold("doc_id", 7, 2)).collect() == []


def test_windows_score_each_id_once_and_agree_with_one_pass():
    draw = np.random.default_rng(1)
    sizes = np.array([0, 3, 16, 17, 40])
    ids = draw.integers(0, 50, sizes.sum())
    model = lm.train(ids, sizes, np.bincount(ids, minlength=50).astype(float), 5.0, steps=20)
    index, text = lm.windows(lm.sequences(ids, sizes, 50)[2])
    scored = index[:, lm.WINDOW :]
    assert sorted(scored[scored >= 0].tolist()) == list(range(sizes.sum() + len(sizes)))
    x, target, _ = lm.sequences(ids, sizes, 50)
    z, f, _ = lm.forward(model.w, model.row_of[x], index)
    softmax = lambda z: z - np.log(np.exp(z).sum(axis=-1, keepdims=True))
    member = np.einsum("abi,gij->abgj", f, model.w["member"]) + model.w["member_b"]
    logp = (softmax(z)[..., None] + softmax(member)).reshape(*z.shape[:2], -1)
    want = np.maximum(scored, 0)
    each = np.take_along_axis(logp, model.class_of[target[want]][..., None], -1)[..., 0] + model.share[target[want]]
    total = np.bincount(text, np.where(scored >= 0, each, 0).sum(axis=1), len(sizes)) / lm.LN10
    assert np.allclose(model.log10(ids, sizes), total, rtol=1e-4)


def test_gradients():
    draw = np.random.default_rng(2)
    ids, sizes = draw.integers(0, 30, 40), np.array([40])
    model = lm.train(ids, sizes, np.bincount(ids, minlength=30).astype(float), 1.0, steps=1)
    w = {k: v.astype(np.float64) for k, v in model.w.items()}
    x, _, seq = lm.sequences(ids, sizes, 30)
    index, _ = lm.windows(seq)
    rows = model.row_of[x]
    want = model.class_of[draw.integers(0, 31, index[:, lm.WINDOW :].size)]
    weight = draw.random(len(want))

    def loss():
        z, f, state = lm.forward(w, rows, index, keep=True)
        z, f = z.reshape(-1, lm.GROUPS), f.reshape(-1, lm.WIDTH)
        softmax = lambda z: z - np.log(np.exp(z).sum(axis=-1, keepdims=True))
        group, place, row = want // lm.MEMBERS, want % lm.MEMBERS, np.arange(len(want))
        member = np.einsum("ni,nij->nj", f, w["member"][group]) + w["member_b"][group]
        return -(weight * (softmax(z)[row, group] + softmax(member)[row, place])).sum(), z, f, state

    _, z, f, state = loss()
    dz, df, g_member, g_bias = lm.choice_gradients(w, z, f, want, weight)
    shape = (len(index), lm.WINDOW, -1)
    grads = lm.backward(w, state, dz.reshape(shape), df.reshape(shape)) | {"member": g_member, "member_b": g_bias}
    group = int(want[0] // lm.MEMBERS)
    for name in w:
        at = (rows[5], 3) if name == "embed" else tuple(draw.integers(0, s) for s in w[name].shape)
        at = (group, *at[1:]) if name.startswith("member") else at
        step, kept = 1e-5, w[name][at]
        w[name][at] = kept + step
        up = loss()[0]
        w[name][at] = kept - step
        down = loss()[0]
        w[name][at] = kept
        assert np.isclose((up - down) / (2 * step), grads[name][at], rtol=1e-3, atol=1e-5), name


def test_subword_scores_are_a_distribution():
    model = lm.train(np.array([1, 2, 1, 3]), np.array([2, 2]), np.array([0.0, 2, 1, 1, 0]), 2.0, steps=5)
    one = [10 ** model.log10(np.array([i]), np.array([1]))[0] for i in range(5)]
    empty = 10 ** model.log10(np.zeros(0, np.int64), np.array([0]))[0]
    assert 0 < empty + sum(one) < 1.0001


# ---------------------------------------------------------------- 5, personal data

PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def plain_spans(text):
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == 0 or (kind == 1 and all(int(x) <= 255 for x in m.group().split("."))) or (kind == 2 and 13 <= len(digits) <= 19 and pii.luhn(digits)) or (kind == 3 and 9 <= len(digits) <= 15):
                out.append((kind, m.start(), m.end()))
    return out


def test_base_spans_are_those_of_the_patterns():
    draw = np.random.default_rng(3)
    pieces = [*"0123456789" * 2, ".", "-", "+", " ", "@", "(", ")", "a.b", "x", "1.2.3.4", "+1 (743) 555-3824", "4465758382889437", "é"]
    for _ in range(4000):
        text = "".join(draw.choice(pieces, draw.integers(0, 40)))
        assert pii.base_spans(text) == plain_spans(text), text
    assert pii.base_spans("9" * 50_000 + "@" * 50_000) == []


def test_field_adds_what_patterns_miss_and_keeps_what_they_find():
    texts = [f"call +1 ({200 + k}) 555-{1000 + k} today and a{k}@mail.example.com, not {k} or {1000 + k}" for k in range(200)]
    field = pii.fit(texts)
    text = "call +1 (523) 555-1055 now or dial (523) 555-1055 later, item 7 of 1234"
    found = pii.find([text, "only 12 words and 3456 more", ""], field)
    assert [(pii.KINDS[k], text[a:b], base) for k, a, b, base in found[0]] == [("phone", "+1 (523) 555-1055", True), ("phone", "(523) 555-1055", False)]
    assert found[1:] == [[], []]


def test_message_passing_is_exact_on_chains():
    draw = np.random.default_rng(5)
    k, n = 5, 4
    field = pii.Field(draw.standard_normal((pii.CELLS, k)), (lambda a: a + a.T)(draw.standard_normal((k, k))), np.zeros((k, k)))
    cells = draw.integers(0, pii.CELLS, (n, pii.FEATURES))
    chain = np.column_stack([np.arange(n - 1), np.arange(1, n)])
    graph = pii.Graph(np.zeros(n, int), np.arange(n), np.arange(n), cells, np.zeros(n, int), chain, np.zeros((0, 2), int))
    unary = field.unary[cells].sum(axis=1)
    p = np.zeros((n, k))
    for labels in np.ndindex(*[k] * n):
        weight = np.exp(sum(unary[i, a] for i, a in enumerate(labels)) + sum(field.chain[a, b] for a, b in zip(labels, labels[1:])))
        for i, a in enumerate(labels):
            p[i, a] += weight
    assert np.allclose(pii.marginals(field, graph, tolerance=1e-9), p / p.sum(axis=1, keepdims=True), atol=1e-6)


def test_tagged_rows(tricky, nothing):
    field = pii.learn(tricky)
    got = pii.tag(tricky, field, masked=True)
    by_id = {r["doc_id"]: r for r in got.collect()}
    for r in collected(tricky):
        base = [(pii.KINDS.index(s["kind"]), s["start"], s["end"]) for s in by_id[r["doc_id"]]["spans"] if s["base"]] if r["doc_id"] is not None else []
        if r["doc_id"] is not None:
            assert base == plain_spans(r["text"] or "")
            assert (by_id[r["doc_id"]]["masked"] is None) == (r["text"] is None)
    assert "a.b@mail" not in " ".join(r["masked"] or "" for r in by_id.values())
    assert got.count() == tricky.count()
    assert pii.tag(nothing, pii.learn(nothing)).collect() == []


# ---------------------------------------------------------------- 6, BPE


def test_ids_are_the_librarys(tricky, nothing):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.default_path())
    coded = bpe.encode(tricky, keep=("doc_id", "text"), decoded=True).collect()
    assert len(coded) == tricky.count()
    for r in coded:
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert np.frombuffer(r["ids"], "<u4").tolist() == ids and r["n_tokens"] == len(ids)
        assert r["decoded"] == library.decode(ids, skip_special_tokens=False)
    again = bpe.decode(bpe.encode(tricky, keep=("doc_id", "text")), keep=("text",)).collect()
    assert all(r["decoded"] == (r["text"] or "") for r in again)
    assert bpe.encode(nothing).collect() == []


def test_ids_of_odd_characters_and_cut_texts():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.default_path())
    draw = np.random.default_rng(6)
    pieces = ["a", "e", " ", "  ", "\n", "'", "'s", "'re", "''", "é", "ß", "中", "23", "²", "!", "　", " the", "<|endoftext|>", "😀", "aaaa", "\x00", "\x85", "\x1c"]
    texts = ["".join(draw.choice(pieces, draw.integers(0, 25))) for _ in range(3000)]
    vocab = bpe.vocabulary(bpe.default_path())
    assert [x.tolist() for x in vocab.encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    long = "".join(draw.choice(pieces, 20_000))
    kept, bpe.UNIT = bpe.UNIT, 500
    try:
        assert np.concatenate(list(vocab.encode(list(bpe.cut(long))))).tolist() == library.encode(long, add_special_tokens=False).ids
    finally:
        bpe.UNIT = kept


# ---------------------------------------------------------------- 7, mixing


def test_mix(tricky, nothing):
    decided = mixing.mix(tricky, importance=mixing.length_importance()).collect()
    rows = Counter((r["doc_id"], r["source"], len(WORD.findall(r["text"] or ""))) for r in collected(tricky))
    assert {(r["id"], r["source"], r["size"]): r["n_rows"] for r in decided} == dict(rows)
    by_source: dict = {}
    for r in decided:
        assert r["taken"] == r["copies"] * r["size"] <= 2 * r["size"]
        by_source.setdefault(r["source"], []).append(r)
    total = sum(k[2] * n for k, n in rows.items())
    assert np.isclose(sum(x[0]["target"] for x in by_source.values()), 1.5 * total)
    for x in by_source.values():
        taken, largest = sum(r["taken"] * r["n_rows"] for r in x), max(r["size"] * r["n_rows"] for r in x)
        assert x[0]["target"] <= 2 * x[0]["source_size"] and abs(taken - x[0]["target"]) <= largest
    again = mixing.mix(tricky.repartition(5), importance=mixing.length_importance()).collect()
    assert sorted(map(str, decided)) == sorted(map(str, again))
    mixed = mixing.take(tricky, mixing.mix(tricky, importance=mixing.length_importance()))
    assert mixed.columns == tricky.columns and mixed.count() == sum(r["copies"] * r["n_rows"] for r in decided)
    assert mixing.mix(nothing).collect() == [] and mixing.take(nothing, mixing.mix(nothing)).collect() == []


def test_targets_fill_up(spark):
    sizes = {"a": 10, "b": 1000, "c": 1000, "d": 5, None: 50}
    got = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    weight = dict(zip(["a", "b", "c", "d", None], [5, 2, 1, 5, 2]))
    full: set = set()
    while True:  # in rounds, as the rule is told
        left = 1.5 * sum(sizes.values()) - sum(2 * sizes[s] for s in full)
        level = left / sum(w for s, w in weight.items() if s not in full)
        more = {s for s in sizes if s not in full and level * weight[s] > 2 * sizes[s]}
        if not more:
            break
        full |= more
    assert got == pytest.approx({s: 2 * sizes[s] if s in full else level * weight[s] for s in sizes})


def test_draws_follow_the_inclusion_odds(spark):
    """Over many seeds every document is taken about target / size times."""
    docs = spark.createDataFrame([(k, " ".join(["w"] * 10), "s") for k in range(12)] + [(99, " ".join(["w"] * 120), "t")], "doc_id long, text string, source string")
    total = Counter()
    for seed in range(12):
        for r in mixing.mix(docs, weights=(1, 2), share=1.0, seed=seed).where("source = 's'").collect():
            total[r["id"]] += r["copies"]
    assert sum(total.values()) == 12 * 8 and max(total.values()) <= 12 and min(total.values()) >= 3


# ---------------------------------------------------------------- 8, Jaccard join


def brute_links(rows):
    sets = []
    for r in rows:
        w = WORD.findall(r["text"] or "")
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    n = len(rows)
    near = [[i != j and bool(sets[i]) and len(sets[i] & sets[j]) / max(1, len(sets[i] | sets[j])) >= 0.8 for j in range(n)] for i in range(n)]
    label = list(range(n))
    while (new := [min([label[i]] + [label[j] for j in range(n) if near[i][j]]) for i in range(n)]) != label:
        label = new
    heads = {c: min((r["doc_id"] for r, x in zip(rows, label) if x == c and r["doc_id"] is not None), default=None) for c in label}
    return [(heads[c], sum(x)) for c, x in zip(label, near)]


@pytest.mark.parametrize("block", [2048, 1])
def test_jaccard_classes(tricky, nothing, block):
    rows = collected(tricky)
    expected = sorted((str(r["doc_id"]), str(c), n) for r, (c, n) in zip(rows, brute_links(rows)))
    got = jaccard.classes(tricky, block=block).collect()
    assert sorted((str(r["id"]), str(r["class_id"]), r["n_links"]) for r in got) == expected
    assert jaccard.classes(nothing).collect() == []


def test_one_of_each_class_stays(tricky):
    kept = jaccard.keep_one(tricky)
    assert kept.columns == tricky.columns
    rows = collected(tricky)
    classes = brute_links(rows)
    wordless = sum(not WORD.findall(r["text"] or "") for r in rows)
    alone = sum(n == 0 and bool(WORD.findall(r["text"] or "")) for r, (_, n) in zip(rows, classes))
    linked = len({c for c, n in classes if n})
    assert kept.count() == wordless + alone + linked


def test_pruning_drops_only_what_is_unlikely():
    for n in (20, 40, 140):
        least = jaccard.least_matches(n, 0.8, 1e-6)
        x = (np.arange(200_000) + 0.5) / 200_000
        for m in (least - 1, least):
            density = x**m * (1 - x) ** (n - m)
            assert ((density[x >= 0.8].sum() / density.sum()) >= 1e-6) == (m >= least)


# ---------------------------------------------------------------- 10, language ID


def test_languages(tricky, nothing):
    model = langid.learn(tricky)
    got = langid.identify(tricky, model).collect()
    truth = {r["doc_id"]: r for r in collected(tricky)}
    for r in got:
        t = truth[r["doc_id"]]["text"] if r["doc_id"] is not None else None
        if r["doc_id"] is not None:
            assert (r["lang_pred"] == "und") == (not re.search(r"[^\W\d_]", t or ""))
        assert 0 <= r["score"] <= 1
        if r["doc_id"] is not None and r["doc_id"] < 28:
            assert r["lang_pred"] == truth[r["doc_id"]]["lang"]
    empty = langid.learn(nothing)
    assert langid.identify(nothing, empty).collect() == []
    assert {r["lang_pred"] for r in langid.identify(tricky, empty).collect()} == {"und"}


def test_two_languages_are_both_selected(sample):
    model = langid.learn(sample)
    texts = {lang: t for lang, t in ((r["lang"], r["text"]) for r in collected(sample) if len(r["text"] or "") > 1500)}
    shares, _ = langid.proportions(model, [texts["en"][:1200] + " " + texts["de"][:1200], texts["fr"][:1500]])
    en, de, fr = (model.names.index(x) for x in ("en", "de", "fr"))
    assert shares[0, en] > 0.3 and shares[0, de] > 0.3 and shares[1, fr] > 0.9


def test_held_out_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.learn(docs.where(~in_fold("doc_id", 3, 1)))
    found = langid.identify(docs.where(in_fold("doc_id", 3, 1)), model, keep=("lang",)).collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in found]) > 0.95


# ---------------------------------------------------------------- 1, quality


def test_held_out_quality(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = quality.learn(docs, labels.where(~in_fold("doc_id", 3, 1)))
    truth = labels.where(in_fold("doc_id", 3, 1)).select("doc_id", F.col("quality").alias("truth"))
    found = quality.score(docs.join(truth, "doc_id"), model, keep=("truth",)).toPandas()
    assert ((found["quality"] >= 0.5) == (found["truth"] == 1)).mean() > 0.95


def test_quality_of_awkward_rows(spark, tricky, nothing):
    labels = spark.createDataFrame([(k, k % 2) for k in range(0, 30)] + [(3, None), (None, 1), (5, 1), (5, 1)], "doc_id long, quality int")
    got = quality.score(tricky, quality.learn(tricky, labels)).collect()
    assert len(got) == tricky.count() and all(0 <= r["quality"] <= 1 for r in got)
    none = labels.limit(0)
    assert {r["quality"] for r in quality.score(tricky, quality.learn(tricky, none)).collect()} == {0.5}
    assert quality.score(nothing, quality.learn(nothing, none)).collect() == []
    bare = tricky.select("doc_id", "text")
    assert quality.score(bare, quality.learn(bare, labels)).count() == tricky.count()
