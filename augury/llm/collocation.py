"""Phrase collocations per language, mined by Toivonen's method.

A phrase is frequent if it occurs ``least`` times in its language; all its contiguous parts then are. A sample of the
documents, a fixed share of any input, proposes words and pairs that seem frequent, at a lowered count. One full pass
then counts exactly the proposed phrases and their negative border: every phrase all of whose contiguous parts are
proposed, while it is not. If a phrase of the border turns out frequent, the proposal has failed there: it is widened by
those phrases, and a further pass counts the phrases that have become border or proposal. That goes on until a pass
finds no more; each phrase is counted in one pass alone, over all documents. The result doesn't depend on the sample.

A proposal is handed to the tasks as a Bloom filter of bounded size over hashes of phrases. A phrase it takes for
proposed by mistake is counted too, no more: the filter decides what is counted, never the counts. Tasks count in numpy
over numbered words and send each phrase once per ``PORTION`` words, in one Arrow batch for each bucket of phrases; other
tasks add up whole buckets. A frequent phrase or language costs such a task no more than a row for each sender.

Texts: A-Z is lower-cased; pieces end at ``[.,;:!?\\x0A-\\x0D]``, words are ``[^\\x20\\x09]+``. Cases: NULL and empty
texts have no words; a NULL language is ``und``; repeated rows count each; ids and other columns play no part; an empty
table gives an empty result. Ties are ordered by score, count and phrase, which is unique in a language.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from augury.llm.common import slices, small_batches, text_or_empty
from augury.session import materialise

LEAST = 10  # occurrences of a frequent phrase
LONGEST = 3  # words of a phrase
SAMPLE = 8  # one document in so many proposes
PORTION = 2_000_000  # words that a task counts before it sends
WRITTEN = 150_000  # phrases, or those of one bucket, that are written out as texts at once
LEAST_BITS, MOST_BITS = 16, 28  # size of a proposal's filter: powers of two of bits, 32 MB at most
BREAK, EMPTY = 0, 1  # numbers that stand for the end of a piece and for no word
LOWER = bytes(b"\n"[0] if c in b".,;:!?\n\x0b\x0c\r" else b" "[0] if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))
PARTS = "lang string, size int, phrase string, n bigint, proposed boolean"
ROWS = pa.schema([("lang", pa.string()), ("size", pa.int32()), ("phrase", pa.string()), ("n", pa.int64()), ("proposed", pa.bool_())])


def mixed(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
        return h ^ (h >> np.uint64(33))


def joined_hash(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The hash of two words in this order, from their hashes."""
    with np.errstate(over="ignore"):
        return mixed(left * np.uint64(0x9E3779B97F4A7C15) + mixed(right))


def word_hashes(lang: str, words: list[bytes]) -> np.ndarray:
    import xxhash

    head = lang.encode() + b"\n"
    return np.fromiter((xxhash.xxh3_64_intdigest(head + w) for w in words), np.uint64, len(words))


def bits_of(h: np.ndarray, bits: int) -> np.ndarray:
    """The three bits of each hash in a filter of 2**bits bits, one row each."""
    mask = np.uint64((1 << bits) - 1)
    return np.stack([h & mask, (h >> np.uint64(32)) & mask, mixed(h) & mask])


class Proposal:
    """A set of phrases as filters, each wider than the one before: phrases of any of them are proposed."""

    def __init__(self, filters: list[np.ndarray]):
        self.filters = filters

    def has(self, h: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h), bool)
        for words in self.filters:
            at = bits_of(h, (len(words) * 64).bit_length() - 1)
            out |= ((words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)).astype(bool).all(axis=0)
        return out


class Counter:
    """Numbered words of a portion of texts, and its phrase counts."""

    def __init__(self, new: Proposal | None, old: Proposal | None):
        self.new, self.old = new, old
        self.clear()

    def clear(self) -> None:
        self.next = count(EMPTY + 1).__next__
        self.words: dict[str, dict[bytes, int]] = {}
        self.texts: list[np.ndarray] = []
        self.total, self.n_words = 0, {}

    def read(self, lang: str, text: str) -> None:
        known = self.words.get(lang)
        if known is None:
            known = self.words[lang] = Numbers(self.next)
        words = text.encode().translate(LOWER).replace(b"\n", b" \n ").split(b" ")
        ids = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        ids = ids[ids != EMPTY]
        self.texts.append(ids)
        self.texts.append(np.zeros(1, np.int64))  # ends the text's last piece
        self.total += len(words)
        self.n_words[lang] = self.n_words.get(lang, 0) + int(np.count_nonzero(ids))

    def counts(self, buckets: int) -> Iterator[pa.RecordBatch]:
        """The counts so far by bucket of the phrase's hash, in rows (bucket, blob): a blob is a batch of ``PARTS``.

        Size 0 stands for all words of a language."""
        if not self.texts:
            return
        ids, size, langs = np.concatenate(self.texts), self.next(), list(self.words)
        self.texts = []
        lang_of, hashes, texts = np.zeros(size, np.int32), np.zeros(size, np.uint64), [b""] * size
        for k, lang in enumerate(langs):
            own = [(w, i) for w, i in self.words[lang].items() if i > EMPTY]
            at = np.fromiter((i for _, i in own), np.int64, len(own))
            lang_of[at], hashes[at] = k, word_hashes(lang, [w for w, _ in own])
            for w, i in own:
                texts[i] = w
        words, found = pa.array(texts, pa.binary()).cast(pa.string()), []
        self.words, texts = {}, []

        def add(parts: list[np.ndarray], n: np.ndarray, proposed: np.ndarray, h: np.ndarray, lang: np.ndarray | None = None) -> None:
            """Phrases by the numbers of their words: they become texts a few buckets at a time."""
            numbers = np.zeros((LONGEST, len(n)), np.int32)
            for k, part in enumerate(parts):
                numbers[k] = part
            found.append((lang_of[parts[0]] if parts else lang, np.full(len(n), len(parts), np.int32), numbers, n.astype(np.int64), proposed, (h % np.uint64(buckets)).astype(np.int32)))

        sampling = self.new is None
        here = self.new.has(hashes) if not sampling else np.ones(size, bool)
        here[: EMPTY + 1] = False
        before = self.old.has(hashes) if self.old is not None else np.zeros(size, bool)
        if self.old is None:  # words are counted in the sample and in the first full pass
            n = np.bincount(ids, minlength=size)
            n[: EMPTY + 1] = 0
            at = np.flatnonzero(n)
            add([at], n[at], here[at], hashes[at])
            total = np.array([self.n_words[lang] for lang in langs])
            add([], total, np.ones(len(langs), bool), word_hashes("", [lang.encode() for lang in langs]), np.arange(len(langs), dtype=np.int32))
        at = np.flatnonzero(here[ids[:-1]] & here[ids[1:]])  # pairs both of whose words are proposed
        pair, number, n = np.unique(ids[at] * size + ids[at + 1], return_inverse=True, return_counts=True)
        left, right = pair // size, pair % size
        h = joined_hash(hashes[left], hashes[right])
        known = before[left] & before[right]  # counted in an earlier pass
        proposed = self.new.has(h) if not sampling else np.ones(len(h), bool)
        send = np.flatnonzero(~known)
        del pair
        add([left[send], right[send]], n[send], proposed[send], h[send])
        if not sampling:
            pair_at = np.full(len(ids), -1, np.int64)
            pair_at[at] = np.where(proposed[number], number, -1)
            two = np.flatnonzero((pair_at[:-1] >= 0) & (pair_at[1:] >= 0))  # where two proposed pairs overlap in a word
            if self.old is not None:
                counted_before = known & self.old.has(h)
                two = two[~(counted_before[pair_at[two]] & counted_before[pair_at[two + 1]])]
            triple, n = np.unique(pair_at[two] * size + ids[np.minimum(two + 2, len(ids) - 1)], return_counts=True)
            first, last = triple // size, triple % size
            add([left[first], right[first], last], n, np.ones(len(n), bool), joined_hash(h[first], hashes[last]))
        lang, sizes, numbers, n, proposed, bucket = (np.concatenate(a, axis=-1) for a in zip(*found))
        found.clear()
        if not len(bucket):
            return
        order = np.argsort(bucket, kind="stable")
        ordered, by = bucket[order], pa.array(langs, pa.string())
        starts = np.r_[np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]), len(order)]
        del ids
        x = 0
        while x < len(starts) - 1:
            y = min(x + 64, max(x + 1, int(np.searchsorted(starts, starts[x] + WRITTEN, side="right")) - 1), len(starts) - 1)
            rows = order[starts[x] : starts[y]]
            own = [rows[sizes[rows] == k] for k in range(LONGEST + 1)]
            phrase = [pa.array([""] * len(own[0]), pa.string())]
            phrase += [pc.binary_join_element_wise(*[words.take(pa.array(numbers[j, own[k]])) for j in range(k)], " ") for k in range(1, LONGEST + 1)]
            rows = np.concatenate(own)
            sorted_by = np.argsort(bucket[rows], kind="stable")
            columns = [by.take(pa.array(lang[rows])), pa.array(sizes[rows]), pa.concat_arrays(phrase), pa.array(n[rows]), pa.array(proposed[rows])]
            part = pa.RecordBatch.from_arrays([c.take(pa.array(sorted_by)) for c in columns], schema=ROWS)
            ends = (starts[x : y + 1] - starts[x]).tolist()
            blobs = [part.slice(u, v - u).serialize().to_pybytes() for u, v in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(ordered[starts[x:y]]), pa.array(blobs, pa.binary())], names=["bucket", "blob"])
            x = y


class Numbers(dict):
    """Numbers words as they come; the end of a piece and no word have numbers of their own."""

    def __init__(self, following):
        super().__init__({b"\n": BREAK, b"": EMPTY})
        self.following = following

    def __missing__(self, word: bytes) -> int:
        self[word] = number = self.following()
        return number


def merged(held: list[pa.RecordBatch]) -> pa.Table:
    summed = pa.Table.from_batches(held, ROWS).group_by(["lang", "size", "phrase"], use_threads=False).aggregate([("n", "sum"), ("proposed", "any")])
    return summed.select(["lang", "size", "phrase", "n_sum", "proposed_any"]).rename_columns(ROWS.names)


def counted(texts: DataFrame, new, old, pieces: int, least: int) -> DataFrame:
    """``PARTS`` of the phrases of ``lang, __text`` with ``least`` occurrences, and the words of each language (size 0).

    ``new``, ``old``: broadcast lists of filters, None in the sample, resp. the first pass. Counts of a task travel as
    batches, one for each bucket of phrases, to ``pieces`` tasks that add them up.
    """
    buckets = 8 * pieces

    def count_words(batches):
        counter = Counter(None if new is None else Proposal(new.value), None if old is None else Proposal(old.value))
        for batch in slices(batches, "__text", 4_000_000):
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("__text").to_pylist()):
                counter.read(lang, text)
                if counter.total > PORTION:
                    yield from counter.counts(buckets)
                    counter.clear()
        yield from counter.counts(buckets)

    def add_up(batches):
        held, rows, most = [], 0, 2_000_000
        for batch in batches:
            for blob in batch.column("blob"):
                held.append(pa.ipc.read_record_batch(blob.as_buffer(), ROWS))
                rows += held[-1].num_rows
                if rows > most:
                    held = merged(held).to_batches()
                    rows = sum(b.num_rows for b in held)
                    most = max(most, 2 * rows)
        if held:
            out = merged(held)
            yield from out.filter(pc.or_(pc.greater_equal(out.column("n"), least), pc.equal(out.column("size"), 0))).to_batches(max_chunksize=10_000)

    return texts.mapInArrow(count_words, "bucket int, blob binary").repartition(pieces, "bucket").mapInArrow(add_up, PARTS)


def filter_of(spark: SparkSession, phrases: DataFrame) -> np.ndarray | None:
    """The filter of ``lang, phrase``; None if there are none. Its size is bounded, so it may pass through the driver."""
    n = phrases.count()
    if not n:
        return None
    bits = min(MOST_BITS, max(LEAST_BITS, (16 * n).bit_length()))

    def work(batches):
        filled = np.zeros(1 << (bits - 6), np.uint64)
        for batch in batches:
            for lang in batch.column("lang").unique().to_pylist():
                own = [p.split(" ") for a, p in zip(batch.column("lang").to_pylist(), batch.column("phrase").to_pylist()) if a == lang]
                for size in (1, 2):
                    parts = [p for p in own if len(p) == size]
                    h = word_hashes(lang, [p[0].encode() for p in parts])
                    if size == 2:
                        h = joined_hash(h, word_hashes(lang, [p[1].encode() for p in parts]))
                    at = bits_of(h, bits).ravel()
                    np.bitwise_or.at(filled, at >> np.uint64(6), np.uint64(1) << (at & np.uint64(63)))
        used = np.flatnonzero(filled)
        if len(used):
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(filled[used].view(np.int64))], names=["slot", "bits"])

    slots = phrases.select("lang", "phrase").mapInArrow(work, "slot bigint, bits bigint").groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[slots.column("slot").to_numpy()] = slots.column("bits").to_numpy().view(np.uint64)
    return out


def frequent(df: DataFrame, lang: str = "lang", text: str = "text", least: int = LEAST, sample: int = SAMPLE) -> DataFrame:
    """``lang, size, phrase, n`` of all phrases of up to three words that occur ``least`` times; size 0: the words of a language."""
    spark = df.sparkSession
    small_batches(df)
    texts = df.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), text_or_empty(text).alias("__text"))

    # The share of a phrase's occurrences that the sample is expected to hold, lowered to one in two of them.
    lowered = max(2, least // sample // 2)
    pieces = int(spark.conf.get("spark.sql.shuffle.partitions"))
    drawn = texts.where(F.pmod(F.xxhash64("__text"), F.lit(sample)) == 0)
    seen = materialise(counted(drawn, None, None, pieces, lowered), "proposed")
    n_words = seen.where("size = 0").agg(F.sum("n")).first()[0] or 0
    pieces = max(pieces, -(-n_words * sample // PORTION))
    filters = [f for f in [filter_of(spark, seen.where("size > 0"))] if f is not None]
    old, passes = None, []
    while True:
        new = spark.sparkContext.broadcast(filters)
        passes.append(materialise(counted(texts, new, old, pieces, least), "phrases"))
        failed = filter_of(spark, passes[-1].where(~F.col("proposed") & (F.col("size") < LONGEST)))
        if failed is None:
            break
        old, filters = new, [*filters, failed]
    out = passes[0]
    for more in passes[1:]:
        out = out.unionByName(more)
    return out.drop("proposed")


def _cut(phrase: Column, k: int) -> tuple[Column, Column]:
    """The first ``k`` words, and the rest."""
    words = F.split(phrase, " ", -1)
    return F.array_join(F.slice(words, 1, k), " "), F.array_join(F.slice(words, k + 1, LONGEST), " ")


def mine(df: DataFrame, lang: str = "lang", text: str = "text", least: int = LEAST, most: int = 2000, share: int = 50, sample: int = SAMPLE) -> DataFrame:
    """The ``most`` best phrases of each language: ``lang, rank, phrase, a, l, r, n, score``.

    ``share``: a phrase goes if a longer one around it has at least this percentage of its occurrences.
    """
    spark = df.sparkSession
    found = frequent(df, lang, text, least, sample)
    totals = found.where("size = 0").select("lang", F.col("n").alias("n_words"))
    parts = found.where("size between 1 and 2").select("lang", "phrase", "n")
    whole = found.where("size >= 2").select("lang", "size", "phrase", F.col("n").alias("a"))

    cuts = whole.select("*", F.explode(F.when(F.col("size") == 2, F.array(F.lit(1))).otherwise(F.array(F.lit(1), F.lit(2)))).alias("k"))
    words = F.split("phrase", " ", -1)
    cuts = cuts.select("*", F.array_join(F.slice(words, F.lit(1), F.col("k")), " ").alias("_left"), F.array_join(F.slice(words, F.col("k") + 1, F.lit(LONGEST)), " ").alias("_right"))
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("_left"), F.col("n").alias("l")), ["lang", "_left"])
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("_right"), F.col("n").alias("r")), ["lang", "_right"])
    big = lambda c: F.col(c).cast("decimal(15,0)")
    score = F.expr("(cast(1000000 as decimal(7,0)) * _a * _a) div (_l * _r)")
    cuts = cuts.withColumns({"_a": big("a"), "_l": big("l"), "_r": big("r")}).withColumn("score", score)
    scored = cuts.groupBy("lang", "phrase", "size", "a").agg(F.min_by(F.struct("l", "r", "score"), F.struct("score", "k")).alias("_best"))

    inner = whole.where("size = 3").select("lang", "a", F.explode(F.array(_cut(F.col("phrase"), 2)[0], _cut(F.col("phrase"), 1)[1])).alias("phrase"))
    inner = inner.groupBy("lang", "phrase").agg(F.max("a").alias("_around"))
    scored = scored.join(inner, ["lang", "phrase"], "left").where(F.col("_around").isNull() | (100 * F.col("_around") < share * F.col("a")))
    best = scored.select("lang", "phrase", "a", "_best.*")
    place = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = best.withColumn("rank", F.row_number().over(place).cast("long")).where(F.col("rank") <= most)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("n_words").alias("n"), "score")
