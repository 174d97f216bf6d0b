"""Near-duplicate join on word shingles: MinHash bands, Bayesian pruning, exact verification.

1. Equal texts become one entry by hash. Each entry gets a MinHash signature of its shingles.
2. Entries that agree in a band are tied to the band value's smallest entry: as many ties as entries, never all pairs.
   The connected components of the ties hold all candidate pairs.
3. Within a component all pairs are compared, block by block: a component over the block size is dealt out over tasks
   for pairs of blocks. MinHash values are compared a few at a time; a pair leaves once the posterior probability
   that its similarity reaches the threshold is below the tolerance. What remains is verified on the shingle sets.
4. Tasks give link counts and each entry's local root, at most one row per entry. Components of these are the classes.

A pair at exactly the threshold is missed by the bands with a probability of (1 - 0.8^5)^28 = 1.5e-5, and pruned
with about the tolerance. There is no cap on partners, candidates or group sizes.

Cases: words are maximal runs without blanks and control white space, compared as they are. A text under the shingle
width is one shingle of all its words. NULL and wordless texts link with nothing and are their own class. Repeated
rows are copies like any others. NULL ids are kept, and a class whose ids are all NULL has a NULL id. An empty table
gives an empty result; other columns play no part.
"""

from __future__ import annotations

from functools import cache
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from augury.llm.common import slices, small_batches, spread, starts_of, text_or_empty
from augury.llm.components import components
from augury.session import materialise

WIDTH, THRESHOLD = 5, 0.8
BANDS, ROWS = 28, 5
STEP = 20  # MinHash values compared at a time
TOLERANCE = 1e-6
BLOCK_TEXTS, BLOCK_SHINGLES = 2048, 2_000_000
UNIT = 1_000_000
WORDS_KEPT = 200_000


@cache
def multipliers(n: int) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(11)
    return draw.integers(0, 2**63, n, np.uint64) * np.uint64(2) + np.uint64(1), draw.integers(0, 2**63, n, np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words(dict):
    """Word to 64-bit hash, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > WORDS_KEPT:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(texts: list[str], words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all texts, repeats included, and how many each text has."""
    split = [t.encode("utf-8", "surrogatepass").split() for t in texts]
    n = np.array([len(x) for x in split], np.int64)
    flat = np.fromiter((words[w] for x in split for w in x), np.uint64, int(n.sum()))
    count = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    at = spread(starts_of(n)[:-1], count)
    padded = np.concatenate([flat, np.zeros(width, np.uint64)])
    short = np.repeat(n, count)  # words a shingle may take; fewer than the width in short texts
    out = np.zeros(len(at), np.uint64)
    for k in range(width):
        part = mixed(padded[at + k] + np.uint64(k + 1))
        if k and (n < width).any():
            part = np.where(short > k, part, np.uint64(0))
        out = out * np.uint64(0x9E3779B97F4A7C15) + part
    return mixed(out), count


def signatures(hashes: np.ndarray, count: np.ndarray, n: int) -> np.ndarray:
    """Texts x n smallest hashes, cut to 32 bits; texts without shingles get none."""
    have = np.flatnonzero(count)
    at = starts_of(count[have])[:-1]
    out = np.zeros((len(have), n), np.uint32)
    factor, salt = multipliers(n)
    for k in range(n if len(have) else 0):
        out[:, k] = np.minimum.reduceat((hashes ^ salt[k]) * factor[k], at) >> np.uint64(32)
    return out


def sign(docs: DataFrame, text: str, width: int, bands: int, rows: int) -> DataFrame:
    """``h, sig, bands`` of every text that has words; h is the MD5 of the text."""

    def work(batches):
        words = Words()
        for batch in slices(batches, "text", UNIT):
            found, count = shingles(batch.column("text").to_pylist(), words, width)
            sig = signatures(found, count, bands * rows)
            key = np.zeros((len(sig), bands), np.uint64)
            for j in range(rows):
                key = mixed(key + sig[:, j::rows].astype(np.uint64)) + np.arange(bands, dtype=np.uint64)
            at = pa.array(np.arange(len(sig) + 1) * bands, pa.int32())
            lists = pa.ListArray.from_arrays(at, pa.array(key.view(np.int64).ravel(), pa.int64()))
            ids = batch.select(["id", "h"]).filter(pa.array(count > 0))
            yield pa.RecordBatch.from_arrays([*ids.columns, pa.array([x.tobytes() for x in sig], pa.binary()), lists], names=["id", "h", "sig", "bands"])

    given = docs.select(docs["__id"].alias("id"), hash_of(text).alias("h"), text_or_empty(text).alias("text"))
    return given.mapInArrow(work, given.select("id", "h").schema.add("sig", "binary").add("bands", T.ArrayType(T.LongType())))


def hash_of(text: str):
    return F.unhex(F.md5(F.encode(text_or_empty(text), "UTF-8")))


@cache
def least_matches(n: int, threshold: float, tolerance: float) -> int:
    """Fewest matches among n for which P(similarity >= threshold) is at least the tolerance, from a uniform prior."""
    below = 0.0
    for m in range(n + 1):
        below += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if below >= tolerance:
            return m
    return n + 1


def compare(a_sig, b_sig, a_sets, b_sets, same: bool, threshold: float, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """The linked pairs (i, j); with ``same`` both sides are one block and i < j."""
    n = a_sig.shape[1]
    matches = np.zeros((len(a_sig), len(b_sig)), np.uint8)
    for k in range(min(STEP, n)):
        matches += a_sig[:, k][:, None] == b_sig[:, k][None, :]
    alive = matches >= least_matches(min(STEP, n), threshold, tolerance)
    if same:
        alive &= np.tri(len(a_sig), k=-1, dtype=bool).T
    i, j = np.nonzero(alive)
    seen = matches[i, j].astype(np.int64)
    for at in range(STEP, n, STEP):
        to = min(at + STEP, n)
        for part in range(0, len(i), 1 << 20):
            cut = slice(part, part + (1 << 20))
            seen[cut] += (a_sig[i[cut], at:to] == b_sig[j[cut], at:to]).sum(axis=1)
        stay = seen >= least_matches(to, threshold, tolerance)
        i, j, seen = i[stay], j[stay], seen[stay]
    if not len(i):
        return i, j
    size_a, size_b = np.array([len(x) for x in a_sets]), np.array([len(x) for x in b_sets])
    need_a, need_b = np.unique(i), np.unique(j)
    a_bits, b_bits = bits_of([a_sets[x] for x in need_a], [b_sets[x] for x in need_b])
    at_a, at_b = np.searchsorted(need_a, i), np.searchsorted(need_b, j)
    ok = np.zeros(len(i), bool)
    step = max(1, (1 << 21) // max(1, a_bits.shape[1]))
    for part in range(0, len(i), step):
        cut = slice(part, part + step)
        both = np.bitwise_count(a_bits[at_a[cut]] & b_bits[at_b[cut]]).sum(axis=1, dtype=np.int64)
        ok[cut] = both / (size_a[i[cut]] + size_b[j[cut]] - both) >= threshold
    return i[ok], j[ok]


def bits_of(a_sets: list[np.ndarray], b_sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Bit rows over the shingles that occur on both sides."""
    a_flat, b_flat = np.concatenate(a_sets), np.concatenate(b_sets)
    shared = np.intersect1d(a_flat, b_flat)
    out = []
    for flat, sets in ((a_flat, a_sets), (b_flat, b_sets)):
        row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        at = np.minimum(np.searchsorted(shared, flat), max(0, len(shared) - 1))
        hit = shared[at] == flat if len(shared) else np.zeros(len(flat), bool)
        bits = np.zeros((len(sets), (len(shared) + 63) // 64 or 1), np.uint64)
        np.bitwise_or.at(bits, (row[hit], at[hit] >> 6), np.uint64(1) << (at[hit] & 63).astype(np.uint64))
        out.append(bits)
    return out[0], out[1]


def local_roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest position reachable from each of n by the given pairs."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def links(docs: DataFrame, id: str = "doc_id", text: str = "text", width: int = WIDTH, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, block: int = BLOCK_TEXTS) -> DataFrame:
    """``h, n, first_id, links, class_h, class_id`` of every distinct text with words.

    ``n``: rows with the text; ``links``: other rows within reach, copies included; ``class_h``: the text of the class's smallest id.
    """
    small_batches(docs)
    named = docs.withColumn("__id", F.col(id)).select("__id", text)
    signed = sign(named, text, width, BANDS, ROWS).groupBy("h").agg(
        F.min("id").alias("first_id"), F.count("*").alias("n"), F.first("sig").alias("sig"), F.first("bands").alias("bands")
    )
    signed = materialise(signed, "signed")

    band = signed.select(F.explode("bands").alias("key"), "h")
    shared = materialise(band.groupBy("key").agg(F.min("h").alias("low"), F.max("h").alias("high")).where("low < high").select("key", "low"), "bands")
    ties = band.join(shared, "key").where("h != low").select(F.col("h").alias("a"), F.col("low").alias("b"))
    group = components(ties)

    entries = signed.select("h", "n", "sig").join(group.select(F.col("node").alias("h"), F.col("root").alias("comp")), "h")
    entries = materialise(entries, "entries")
    rows = named.select(hash_of(text).alias("h"), F.col("__id").alias("id"), text_or_empty(text).alias("text"))
    first = signed.select("h", "first_id").join(entries.select("h"), "h", "left_semi")
    rows = rows.join(first, "h").where(F.col("id").eqNullSafe(F.col("first_id"))).select("h", "text")
    sets = materialise(rows.mapInArrow(_sets(width), "h binary, shingles binary, size long").dropDuplicates(["h"]), "shingles")
    entries = entries.join(sets, "h")
    found = materialise(_compared(entries, threshold, tolerance, block), "links")

    per_text = found.groupBy("h").agg(F.sum("links").alias("near"))
    classes = components(found.select(F.col("h").alias("a"), F.col("root").alias("b")))
    texts = signed.select("h", "n", "first_id").join(per_text, "h", "left").join(classes.withColumnRenamed("node", "h"), "h", "left")
    texts = texts.select("h", "n", "first_id", (F.coalesce("near", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("root", "h").alias("root"))
    texts = materialise(texts, "texts")
    best = F.min(F.struct(F.col("first_id").isNull().alias("none"), F.col("first_id").alias("class_id"), F.col("h").alias("class_h")))
    heads = texts.groupBy("root").agg(best.alias("head")).select("root", "head.class_id", "head.class_h")
    return texts.join(heads, "root").drop("root")


def _sets(width: int):
    def work(batches):
        words = Words()
        for batch in slices(batches, "text", UNIT):
            found, count = shingles(batch.column("text").to_pylist(), words, width)
            at = starts_of(count)
            sets = [np.unique(found[a:b]) for a, b in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("h"), pa.array([x.tobytes() for x in sets], pa.binary()), pa.array([len(x) for x in sets], pa.int64())], names=["h", "shingles", "size"])

    return work


def _compared(entries: DataFrame, threshold: float, tolerance: float, block: int) -> DataFrame:
    """``h, root, links`` from each pair of blocks of each component."""
    sizes = entries.groupBy("comp").agg(F.ceil(F.greatest(F.count("*") / F.lit(block), F.sum("size") / F.lit(BLOCK_SHINGLES))).cast("int").alias("blocks"))
    dealt = entries.join(sizes, "comp").withColumn("mine", F.pmod(F.xxhash64("h"), "blocks").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("comp", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), "mine", "h", "n", "sig", "shingles")

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("h", kind="stable", ignore_index=True)
        same = pdf["lo"].iat[0] == pdf["hi"].iat[0]
        sig = np.stack([np.frombuffer(x, np.uint32) for x in pdf["sig"]])
        sets = [np.frombuffer(x, np.uint64) for x in pdf["shingles"]]
        left = np.arange(len(pdf)) if same else np.flatnonzero(pdf["mine"] == pdf["lo"])
        right = left if same else np.flatnonzero(pdf["mine"] != pdf["lo"])
        i, j = compare(sig[left], sig[right], [sets[k] for k in left], [sets[k] for k in right], bool(same), threshold, tolerance)
        i, j = left[i], right[j]
        n = pdf["n"].to_numpy(np.float64)
        count = np.bincount(i, n[j], len(pdf)) + np.bincount(j, n[i], len(pdf))
        out = pd.DataFrame({"h": pdf["h"], "root": pdf["h"].to_numpy()[local_roots(len(pdf), i, j)], "links": count.astype(np.int64)})
        return out[out["links"] > 0]

    return dealt.groupBy("comp", "lo", "hi").applyInPandas(work, "h binary, root binary, links long")


def classes(docs: DataFrame, id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``id, class_id, n_links`` of every row."""
    found = links(docs, id, text, **options).select("h", "links", "class_id")
    rows = docs.select(F.col(id).alias("id"), hash_of(text).alias("h"))
    return rows.join(found, "h", "left").select(
        "id", F.when(F.col("links").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links")
    )


def keep_one(docs: DataFrame, id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` without the others of each class: the one with the smallest id stays, wordless texts all stay."""
    found = links(docs, id, text, **options).select(F.col("h").alias("__h"), F.col("n").alias("__n"), F.col("class_h").alias("__class"), F.col("class_id").alias("__id"))
    rows = docs.select(F.struct("*").alias("__doc"), hash_of(text).alias("__key")).join(found, F.col("__key") == F.col("__h"), "left")
    head = (F.col("__h") == F.col("__class")) & F.col("__doc")[id].eqNullSafe(F.col("__id"))
    rows = rows.where(F.col("__h").isNull() | head)
    alone = rows.where(F.col("__h").isNull() | (F.col("__n") == 1)).select("__doc.*")
    copied = rows.where(F.col("__n") > 1).dropDuplicates(["__h"]).select("__doc.*")
    return alone.union(copied)
