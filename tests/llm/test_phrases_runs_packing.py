"""Phrase mining, periodic runs and packing against brute force, and on awkward rows."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from augury.llm import collocation, packing, periodic, queries

# ---------------------------------------------------------------- 11, phrases


def brute_phrases(rows, least, most, share):
    f, totals = Counter(), Counter()
    for text, lang in rows:
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower):
            words = re.findall("[^\x20\x09]+", piece)
            for k in (1, 2, 3):
                f.update((lang or "und", tuple(words[i : i + k])) for i in range(len(words) - k + 1))
            totals[lang or "und"] += len(words)
    out = []
    for (lang, p), a in f.items():
        if len(p) < 2 or a < least:
            continue
        around = [n for (o, q), n in f.items() if o == lang and len(q) == 3 > len(p) and p in (q[:2], q[1:]) and n >= least]
        if any(100 * n >= share * a for n in around):
            continue
        score, k = min((1_000_000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        out.append((lang, -score, -a, " ".join(p).encode(), a, f[lang, p[:k]], f[lang, p[k:]]))
    ranked, place = [], Counter()
    for lang, score, _, phrase, a, left, right in sorted(out):
        place[lang] += 1
        if place[lang] <= most:
            ranked.append((lang, place[lang], phrase.decode(), a, left, right, totals[lang], -score))
    return ranked


def phrase_rows(seed, n):
    draw = random.Random(seed)
    words = [f"w{k}" for k in range(40)] + ["Über", "a\x00b", " ", "<|x|>"]
    rows = []
    for _ in range(n):
        text = ""
        for _ in range(draw.randint(0, 40)):
            text += draw.choice(["new york city", "New York", "of the", *[words[int(draw.paretovariate(1)) % len(words)] for _ in range(3)]])
            text += draw.choice([" ", " ", " ", "\t", "  ", ", ", ".", "\n", "\x0b"])
        rows.append((draw.choice([text, text, None, ""]), draw.choice(["en", "en", "en", "de", None, "und"])))
    return rows + rows[:5] * 4


@pytest.mark.parametrize("seed, least, sample", [(1, 10, 8), (2, 3, 2), (3, 2, 1), (4, 5, 1000)])
def test_phrases(spark, seed, least, sample):
    rows = phrase_rows(seed, 120)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "text string, lang string, n long, phrase string").repartition(5)
    got = [tuple(r) for r in collocation.mine(df, least=least, most=60, sample=sample).collect()]
    assert sorted(got) == sorted(brute_phrases(rows, least, 60, 50))


def test_phrases_in_portions():
    """A task that sends several times; with nothing proposed, words alone are counted, each once."""
    counter, n, buckets = collocation.Counter(collocation.Proposal([]), None), Counter(), set()
    for text, lang in phrase_rows(7, 60):
        counter.read(lang or "und", text or "")
        if counter.total > 200:
            parts = list(counter.counts(16))
            counter.clear()
            for batch in parts:
                for bucket, blob in zip(batch.column("bucket").to_pylist(), batch.column("blob")):
                    buckets.add(bucket)
                    rows = pa.ipc.read_record_batch(blob.as_buffer(), collocation.ROWS).to_pydict()
                    for size, k in zip(rows["size"], rows["n"]):
                        n[size] += k
    assert set(n) == {0, 1} and n[0] == n[1] > 0 and len(buckets) > 8


def test_hashes_and_filters():
    h = collocation.word_hashes("en", [f"w{k}".encode() for k in range(3000)])
    filled = np.zeros(1 << 10, np.uint64)
    at = collocation.bits_of(h[:1000], 16).ravel()
    np.bitwise_or.at(filled, at >> np.uint64(6), np.uint64(1) << (at & np.uint64(63)))
    found = collocation.Proposal([filled]).has(h)
    assert found[:1000].all() and found[1000:].mean() < 0.02
    assert len(np.unique(collocation.joined_hash(h[:-1], h[1:]))) == len(h) - 1
    assert (collocation.joined_hash(h[:-1], h[1:]) != collocation.joined_hash(h[1:], h[:-1])).all()


def test_phrases_of_awkward_rows(tricky, nothing):
    rows = [(r["text"], r["lang"]) for r in tricky.select("text", "lang").collect()]
    assert sorted(tuple(r) for r in collocation.mine(tricky).collect()) == sorted(brute_phrases(rows, 10, 2000, 50))
    assert collocation.mine(nothing).collect() == []


# ---------------------------------------------------------------- 12, runs


def brute_runs(words, least, exponent):
    """Every maximal stretch with a period, by comparing all words a period apart; the smallest period of a stretch."""
    found = {}
    for q in range(1, len(words) // exponent + 1):
        i = 0
        while i + q < len(words):
            if words[i] != words[i + q]:
                i += 1
                continue
            s = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i - s + q >= max(least, exponent * q):
                found.setdefault((s, i - s + q), q)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    return " ".join(w for k, w in enumerate(words) if k not in gone)


def test_runs_of_random_words():
    draw = random.Random(1)
    for _ in range(400):
        docs = []
        for _ in range(draw.randint(1, 4)):
            words = []
            while len(words) < draw.randint(0, 70):
                words += [draw.randint(0, draw.choice([0, 1, 2, 9])) for _ in range(draw.randint(1, 7))] * draw.randint(1, 6)
            docs.append(words)
        least, exponent = draw.choice([(24, 3), (4, 2), (6, 3), (9, 3), (2, 2), (12, 4)])
        at = np.cumsum([0] + [len(d) for d in docs])
        got = periodic.find_runs(np.array([w for d in docs for w in d], np.int64), at, least, exponent)
        assert [tuple(r) for r in got.tolist()] == [(s + a, n, q) for d, a in zip(docs, at.tolist()) for s, n, q in brute_runs(d, least, exponent)]


def test_long_runs_and_nested_ones():
    for ids in (np.zeros(5000, np.int64), np.arange(5000) % 7, np.r_[np.arange(50), np.arange(3000) % 40, np.arange(50)]):
        got = periodic.find_runs(ids, np.array([0, len(ids)]))
        assert [tuple(r) for r in got.tolist()] == brute_runs(ids.tolist(), 24, 3)
    a, b = [0], [0, 1]
    while len(b) < 2000:
        a, b = b, b + a
    assert [tuple(r) for r in periodic.find_runs(np.array(b), np.array([0, len(b)])).tolist()] == brute_runs(b, 24, 3)


def test_positions_in_many_pieces(monkeypatch):
    monkeypatch.setattr(periodic, "CHUNK", 4)
    draw = random.Random(2)
    order = draw.sample(range(300), 300)
    held = periodic.Positions(order[0])
    seen = [order[0]]
    for x in order[1:]:
        before, after = max([y for y in seen if y < x], default=-1), min([y for y in seen if y > x], default=-1)
        assert held.add(x) == (before, after)
        seen.append(x)
    assert list(held) == sorted(order) and held.size == 300 and max(map(len, held.pieces)) <= 8


def repeated(doc_id, text):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


def test_runs_of_awkward_rows(tricky, nothing):
    many = tricky.select("doc_id", "text", "size", "h").unionByName(tricky.select((F.col("doc_id") + 1000).alias("doc_id"), "text", "size", "h"))
    many = many.unionByName(many.select((F.col("doc_id") + 5000).alias("doc_id"), "text", "size", "h"))
    made = queries._with_repeats(many)
    rows = periodic.runs(made, keep=("doc_id",)).collect()
    expected = []
    for r in many.collect():
        words = repeated(r["doc_id"], r["text"])
        runs = brute_runs(words, 24, 3) if len(words) < 3000 else None
        expected.append((str(r["doc_id"]), len(words), runs, None if runs is None else collapsed(words, runs)))
    got = [(str(r["doc_id"]), r["n_words"], None if r["n_words"] >= 3000 else [tuple(x) for x in r["runs"]], None if r["n_words"] >= 3000 else r["collapsed"]) for r in rows]
    assert sorted(got, key=str) == sorted(expected, key=str)
    assert sum(len(e[2] or ()) for e in expected) >= 3
    assert periodic.runs(nothing).collect() == []


# ---------------------------------------------------------------- 13, packing


def one_by_one(lengths, capacity, rule, weights):
    bins = []
    for n in sorted(lengths, reverse=True):
        need, best = np.array([n, 1, n * n]), None
        for k, left in enumerate(bins):
            if (left >= need).all():
                after = (left - need) / capacity
                cost = (np.array(weights) * after * after).sum() if rule == "norm" else (np.array(weights) * (need / capacity) * after).sum()
                best = (cost, k) if best is None or cost < best[0] else best
        if best is None:
            bins.append(capacity.copy())
        bins[best[1] if best else -1] -= need
    return sorted(map(tuple, bins))


def test_plan_is_best_fit_one_by_one():
    draw = random.Random(3)
    for _ in range(250):
        tokens = draw.choice([8, 16, 32])
        lengths = [draw.randint(1, tokens if draw.random() < 0.7 else max(1, tokens // 4)) for _ in range(draw.randint(0, 60))]
        capacity = np.array([tokens, draw.choice([tokens, 3, 5]), draw.choice([tokens**2, tokens**2 + 50])])
        rule, weights = draw.choice([*packing.RULES, ("norm", (1, 1, 1)), ("dot", (1, 1, 1))])
        n, rows = packing.plan(Counter(lengths), tokens, int(capacity[1]), int(capacity[2]), rule, weights)
        held: dict[int, list] = {}
        for length, first, last, sequence, offset in rows:
            for k in range(first, last + 1):
                held.setdefault(sequence + k - first, []).append((offset, length))
        left = []
        for parts in held.values():
            assert [o for o, _ in sorted(parts)] == [sum(x for _, x in sorted(parts)[:k]) for k in range(len(parts))]
            left.append((tokens - sum(x for _, x in parts), int(capacity[1]) - len(parts), int(capacity[2]) - sum(x * x for _, x in parts)))
        assert len(held) == n and sum(map(len, held.values())) == len(lengths)
        assert sorted(left) == one_by_one(lengths, capacity, rule, weights)


def test_plan_refuses_what_cannot_fit():
    with pytest.raises(ValueError):
        packing.plan({5: 1}, 8, attention=24)
    assert packing.plan({}) == (0, [])
    assert packing.best_plan({}) == (0, [])
    assert packing.plan({3: 10**12}, 8)[0] == 5 * 10**11


def test_packing_of_awkward_rows(tricky, nothing):
    import public_tokenizers
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    odd = [(900, "\x85  a​b᠎ c　d \x1c e\x1d\x1ff \xa0 g"), (901, "a  \n\n b\t\tc   <|endoftext|><|endoftext|> d"), (902, "été ½ ²³ १२ 漢字かな 👩‍👩‍👧 ́x"), (903, "x" * 20_000), (904, " " * 9000)]
    df = tricky.select("doc_id", "text", "size").unionByName(tricky.sparkSession.createDataFrame([(*r, 1) for r in odd], "doc_id long, text string, size long"))
    got = packing.pack(df.repartition(3), ids=True).collect()
    expected = Counter()
    for r in df.collect():
        ids = np.array([*coder.encode(r["text"] or "", add_special_tokens=False).ids, 0], "<u4")
        rest = len(ids) % 2048 or 2048
        for k, at in enumerate([0, *range(rest, len(ids), 2048)]):
            part = ids[at : at + (rest if k == 0 else 2048)]
            expected[r["doc_id"], k, at, len(part), zlib.crc32(part.tobytes()), part.tobytes()] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"], bytes(r["ids"])) for r in got) == expected
    held: dict[int, list] = {}
    for r in got:
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in held.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(x for _, x in parts[:k]) for k in range(len(parts))]
        assert sum(x for _, x in parts) <= 2048
    assert len(held) <= -(-sum(r["length"] for r in got) // 2048) + 1
    assert packing.pack(nothing).collect() == []


def test_packing_under_all_capacities(sample):
    with pytest.raises(ValueError):  # a whole piece of 512 tokens costs more attention than a sequence has
        packing.pack(sample, tokens=512, attention=200_000)
    got = packing.pack(sample, tokens=512, documents=3, attention=270_000, rules=[("dot", (1.0, 1.0, 1.0)), ("norm", (1.0, 0.5, 0.5))])
    per = got.groupBy("sequence_id").agg(F.sum("length").alias("t"), F.count("*").alias("d"), F.sum(F.col("length") * F.col("length")).alias("c"))
    worst = per.agg(F.max("t"), F.max("d"), F.max("c")).first()
    assert worst[0] <= 512 and worst[1] <= 3 and worst[2] <= 270_000
    assert got.count() == packing.pieces(sample, tokens=512).count()


def test_phrases_are_written_out_a_few_buckets_at_a_time(monkeypatch):

    C = collocation
    monkeypatch.setattr(C, "WRITTEN", 20)
    rng, counter, expected = random.Random(3), C.Counter(None, None), Counter()
    for i in range(60):
        words, lang = [rng.choice("abcdefgh") * rng.randrange(1, 3) for _ in range(12)], rng.choice(["en", "de"])
        counter.read(lang, " ".join(words))
        expected.update([(lang, 0, "")] * 12 + [(lang, 1, w) for w in words] + [(lang, 2, f"{a} {b}") for a, b in zip(words, words[1:])])
    found, largest = Counter(), 0
    for batch in counter.counts(40):
        parts = [pa.ipc.read_record_batch(b.as_buffer(), C.ROWS).to_pylist() for b in batch.column("blob")]
        assert sum(map(len, parts)) <= 20 or len(parts) == 1
        largest = max(largest, len(parts))
        for r in sum(parts, []):
            found[r["lang"], r["size"], r["phrase"]] += r["n"]
    assert found == expected and largest > 1
