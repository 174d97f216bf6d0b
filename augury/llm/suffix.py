"""Removal of byte strings that occur more than once, by suffix arrays.

1. Anchors. Of the k-grams in a ``LENGTH``-byte string the one with the least hash is its anchor; equal strings have equal
   anchors. Strings with the same anchor start in one run, so a text is a sequence of snippets: a run of starts with
   ``LENGTH - 1`` more bytes. Only snippets whose anchor occurs elsewhere too can hold repeats.
2. Shards. Snippets meet by anchor, equal snippets as one entry with a count. Each shard gets its suffix array by
   Larsson-Sadakane refinement in numpy and its common prefixes by Kasai's method, in step over all snippets. A string repeats
   if it shares ``LENGTH`` bytes with a neighbour in the array, or if its whole snippet occurs twice.
3. Merging. An anchor with more than ``SHARD`` different snippets is cut into shards; every pair of them is merged by
   binary search of the strings of one in the sorted strings of the other.

Equal hashes only bring strings together; what is removed has been compared byte by byte, except that equal snippets and
equal texts are recognised by 128-bit hashes.

Cases: NULL counts as empty. Texts under ``LENGTH`` bytes stay whole. Copies of a text, repeated rows included, are occurrences
elsewhere, so such texts lose everything if they are long enough. Long texts are read in overlapping pieces, so their length
is not limited. NULL ids are kept; an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

import hashlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from augury.llm.common import slices, small_batches, spread, starts_of, text_or_empty
from augury.llm.jaccard import hash_of, mixed
from augury.session import materialise

LENGTH = 200
GRAM = 32
SHARD = 4000  # most snippets of one anchor in a suffix array
CHUNK = 1_500_000  # bytes of snippets put into one suffix array
UNIT = 1_000_000
_POSITION_BITS = 22


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    base = 0x9E3779B97F4A7C15
    out = []
    for factor in (base, pow(base, -1, 1 << 64)):
        steps = np.full(n + 1, factor, np.uint64)
        steps[0] = 1
        out.append(np.cumprod(steps, dtype=np.uint64))
    return out[0], out[1]


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of the ``gram`` bytes from each position."""
    up, down = _powers(1 << max(16, int(len(data)).bit_length()))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return mixed((sums[gram:] - sums[:-gram]) * down[: len(data) - gram + 1])


def snippets(data: np.ndarray, sizes: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text number, first start, number of starts and anchor hash of each run of strings with one anchor.

    ``data``: all texts, one after the other, at most 2^22 bytes.
    """
    nothing = np.zeros(0, np.int64)
    if len(data) < length:
        return nothing, nothing, nothing, nothing
    h = gram_hashes(data, gram)
    place = np.arange(len(h), dtype=np.uint64)
    top = np.uint64((1 << _POSITION_BITS) - 1)
    low = (h & ~top) | (top - place)  # of equal hashes the last counts
    span, left = 1, length - gram + 1
    while span * 2 <= left:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if left > span:
        low = np.minimum(low[: len(low) - (left - span)], low[left - span :])
    anchor = (top - (low & top)).astype(np.int64)
    at = starts_of(sizes)
    inside = np.repeat(at[1:], sizes)[: len(anchor)] - np.arange(len(anchor)) >= length
    start = np.flatnonzero(inside)
    if not len(start):
        return nothing, nothing, nothing, nothing
    anchor = anchor[start]
    text = np.searchsorted(at, start, side="right") - 1
    first = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])])
    count = np.diff(np.r_[first, len(start)])
    return text[first], (start - at[text])[first], count, h[anchor[first]].view(np.int64)


def words_at(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position as one big-endian number; zeros beyond the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    out = np.zeros(len(data), np.uint64)
    for k in range(8):
        out = (out << np.uint64(8)) | padded[k : k + len(data)]
    return out


def suffix_array(data: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and ranks of texts that each end at a separator; ``stop``: the separator of each position's text.

    Separators sort before all bytes and by place, so all suffixes differ. Groups of suffixes with equal first h symbols are
    sorted by the rank h further on, and single ones leave, until none is left.
    """
    n = len(data)
    place = np.arange(n)
    short = stop - place < 8
    key = words_at(data)
    # Below the length of what is left of a text, so that a shorter rest sorts before longer ones with zero bytes.
    rest = np.minimum(stop - place, 8)
    key[short] &= ~((np.uint64(1) << (np.uint64(8) * (8 - rest[short]).astype(np.uint64)).clip(max=np.uint64(63))) - np.uint64(1))
    key[stop == place] = 0
    order = np.lexsort((rest, key))
    same = (key[order][1:] == key[order][:-1]) & (rest[order][1:] == rest[order][:-1])
    head = np.maximum.accumulate(np.where(np.r_[True, ~same], place, 0))
    rank = np.empty(n, np.int64)
    rank[order] = head
    sep = np.flatnonzero(stop == place)
    rank[sep] = np.arange(len(sep))  # the smallest key of all, in order of place
    size = np.bincount(rank, minlength=n)
    active = np.flatnonzero(size[rank] > 1)
    h = 8
    while len(active):
        second = rank[np.minimum(active + h, stop[active])]
        key = rank[active] * np.int64(n) + second
        order = np.argsort(key, kind="stable")
        key, active = key[order], active[order]
        old = rank[active]
        group = np.maximum.accumulate(np.where(np.r_[True, old[1:] != old[:-1]], np.arange(len(old)), 0))
        part = np.maximum.accumulate(np.where(np.r_[True, key[1:] != key[:-1]], np.arange(len(old)), 0))
        rank[active] = old + part - group
        sizes = np.diff(np.r_[np.flatnonzero(np.r_[True, key[1:] != key[:-1]]), len(key)])
        active = active[np.repeat(sizes, sizes) > 1]
        h *= 2
    array = np.empty(n, np.int64)
    array[rank] = place
    return array, rank


def common_prefixes(data: np.ndarray, array: np.ndarray, rank: np.ndarray, starts: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Kasai's common prefix of each suffix with the one before it in the array: going one byte on in a text loses one byte
    at most. All texts are walked side by side."""
    out = np.zeros(len(array), np.int64)
    words = words_at(data)
    lane, at = starts.copy(), np.zeros(len(starts), np.int64)
    ends = stop[starts] if len(starts) else starts
    h = np.zeros(len(starts), np.int64)
    while len(lane):
        going = lane < ends
        lane, ends, h = lane[going], ends[going], h[going]
        if not len(lane):
            break
        r = rank[lane]
        before = array[np.maximum(r - 1, 0)]
        most = np.minimum(ends - lane, stop[before] - before)
        h = np.where(r > 0, np.minimum(np.maximum(h - 1, 0), most), 0)
        todo = np.flatnonzero((r > 0) & (h < most))
        while len(todo):
            differ = words[lane[todo] + h[todo]] ^ words[before[todo] + h[todo]]
            equal = np.full(len(todo), 8)
            wrong = np.flatnonzero(differ)
            equal[wrong] = (63 - np.floor(np.log2(differ[wrong].astype(np.longdouble))).astype(np.int64)) // 8
            h[todo] = np.minimum(h[todo] + equal, most[todo])
            todo = todo[(equal == 8) & (h[todo] < most[todo])]
        out[r] = h
        lane = lane + 1
    return out


class Shard:
    """Snippets with their suffix array."""

    def __init__(self, parts: list[bytes], length: int):
        sizes = np.array([len(p) for p in parts], np.int64)
        self.data = np.frombuffer(b"".join(p + b"\0" for p in parts), np.uint8)
        at = starts_of(sizes + 1)
        self.starts = at[:-1]
        self.stop = np.repeat(at[1:] - 1, sizes + 1)
        self.count = np.maximum(sizes - length + 1, 0)  # strings per snippet
        self.array, self.rank = suffix_array(self.data, self.stop)
        self.words = words_at(self.data)
        self.length = length

    def strings(self) -> np.ndarray:
        """Positions of all strings, snippet by snippet."""
        return spread(self.starts, self.count)

    def repeated(self) -> np.ndarray:
        """For each string, whether it occurs twice in the shard."""
        lcp = np.append(common_prefixes(self.data, self.array, self.rank, self.starts, self.stop), 0)
        r = self.rank[self.strings()]
        return (lcp[r] >= self.length) | (lcp[r + 1] >= self.length)

    def found_in(self, other: "Shard") -> np.ndarray:
        """For each string, whether it is in the other shard, by binary search."""
        mine = self.strings()
        theirs = other.array[other.stop[other.array] - other.array >= other.length]
        low, high = np.zeros(len(mine), np.int64), np.full(len(mine), len(theirs))
        if not len(theirs):
            return np.zeros(len(mine), bool)
        while (open_ := np.flatnonzero(low < high)).size:
            mid = (low[open_] + high[open_]) // 2
            less = self._compare(mine[open_], other, theirs[mid]) > 0
            low[open_[less]] = mid[less] + 1
            high[open_[~less]] = mid[~less]
        hit = low < len(theirs)
        out = np.zeros(len(mine), bool)
        out[hit] = self._compare(mine[hit], other, theirs[low[hit]]) == 0
        return out

    def _compare(self, a: np.ndarray, other: "Shard", b: np.ndarray) -> np.ndarray:
        """-1, 0 or 1 as the strings at a are below, equal to or above those at b."""
        out = np.zeros(len(a), np.int8)
        todo = np.arange(len(a))
        for k in [*range(0, self.length - 7, 8), *([self.length - 8] if self.length % 8 else [])]:
            x, y = self.words[a[todo] + k], other.words[b[todo] + k]
            out[todo] = (x > y).astype(np.int8) - (x < y).astype(np.int8)
            todo = todo[x == y]
        return out


def _runs(flags: np.ndarray) -> list[dict]:
    edge = np.flatnonzero(np.diff(np.r_[0, flags.astype(np.int8), 0]))
    return [{"a": int(a), "b": int(b)} for a, b in zip(edge[::2], edge[1::2])]


def spans(docs: DataFrame, text: str = "text", length: int = LENGTH, gram: int = GRAM, shard: int = SHARD) -> DataFrame:
    """``h, spans`` of the distinct texts that lose something: byte runs [start, end) by start, not touching. h: MD5 of the text.

    Texts with copies are not among them unless they share strings with others: see ``removed``.
    """
    small_batches(docs)
    rows = docs.select(hash_of(text).alias("h"), text_or_empty(text).alias("text"))
    rows = rows.where(F.octet_length("text") >= length)

    def anchors(batches):
        seen: set[bytes] = set()
        for batch in slices(batches, "text", UNIT):
            new = [(h, t.encode("utf-8", "surrogatepass")) for h, t in zip(batch.column("h").to_pylist(), batch.column("text").to_pylist()) if h not in seen and not seen.add(h)]
            if len(seen) > 200_000:
                seen.clear()
            yield from _anchor_rows(new, length, gram)

    found = materialise(rows.mapInArrow(anchors, "h binary, lo int, n int, fp long"), "anchors")
    place = F.xxhash64("h", "lo")
    shared = found.groupBy("fp").agg(F.min(place).alias("x"), F.max(place).alias("y")).where("x < y").select("fp")
    shared = materialise(shared, "shared")
    mine = found.join(shared, "fp").distinct().groupBy("h").agg(F.collect_list(F.struct("lo", "n", "fp")).alias("runs"))
    given = rows.join(materialise(mine, "runs"), "h").select("h", "text", "runs")

    def cut(batches):
        done: set[bytes] = set()  # snippets given out by this task
        before = None
        for batch in slices(batches, "text", UNIT):
            out = []
            for h, t, runs in zip(*(batch.column(c).to_pylist() for c in ("h", "text", "runs"))):
                if h == before:
                    continue  # a copy
                before, raw = h, t.encode("utf-8", "surrogatepass")
                for r in runs:
                    part = raw[r["lo"] : r["lo"] + r["n"] + length - 1]
                    sid = hashlib.blake2b(part, digest_size=16).digest()
                    out.append((sid, h, r["lo"], r["n"], r["fp"], None if sid in done else part))
                    done.add(sid)
            if len(done) > 200_000:
                done.clear()
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out) if out else [[]] * 6, _CUT)], names=["sid", "h", "lo", "n", "fp", "snippet"])

    placed = materialise(given.mapInArrow(cut, "sid binary, h binary, lo int, n int, fp long, snippet binary"), "snippets")
    entries = placed.groupBy("sid").agg(F.count("*").alias("times"), F.first("fp").alias("fp"), F.first("n").alias("n"), F.first("snippet", ignorenulls=True).alias("snippet"))
    entries = materialise(entries, "entries")
    whole = entries.where("times > 1").select("sid", F.array(F.struct(F.lit(0).alias("a"), F.col("n").alias("b"))).alias("runs"))
    per_anchor = entries.groupBy("fp").agg(F.ceil(F.count("*") / F.lit(float(shard))).cast("int").alias("shards"), F.count("*").alias("k")).where("k > 1")
    dealt = entries.join(per_anchor, "fp").withColumn("mine", F.pmod(F.xxhash64("sid"), "shards").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
    dealt = dealt.select("fp", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "sid", "snippet", "times")
    by_task = dealt.repartition("fp", "i", "j").sortWithinPartitions("fp", "i", "j", "sid")
    parts = by_task.mapInArrow(_compare_shards(length), "sid binary, runs array<struct<a:int,b:int>>")

    hits = placed.select("sid", "h", "lo").join(whole.unionByName(parts.where(F.size("runs") > 0)), "sid").select("h", "lo", F.explode("runs").alias("r"))
    bytes_ = hits.select("h", (F.col("lo") + F.col("r.a")).alias("start"), (F.col("lo") + F.col("r.b") + length - 1).alias("end")).distinct()
    return bytes_.groupBy("h").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))


_CUT = [pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]


def _anchor_rows(texts: list[tuple[bytes, bytes]], length: int, gram: int):
    """Anchor runs of (hash, bytes) texts; texts over a work unit in pieces that overlap by a string."""
    pieces = [(h, a, raw[a : a + UNIT + length - 1]) for h, raw in texts for a in range(0, max(1, len(raw) - length + 1), UNIT)]
    group: list = []
    size = 0
    for k, piece in enumerate(pieces):
        group.append(piece)
        size += len(piece[2])
        if size < UNIT and k + 1 < len(pieces):
            continue
        data = np.frombuffer(b"".join(p[2] for p in group), np.uint8)
        text, lo, n, fp = snippets(data, np.array([len(p[2]) for p in group], np.int64), length, gram)
        base = np.array([p[1] for p in group], np.int64)
        hs = [group[t][0] for t in text.tolist()]
        yield pa.RecordBatch.from_arrays([pa.array(hs, pa.binary()), pa.array((lo + base[text]) if len(text) else lo, pa.int32()), pa.array(n, pa.int32()), pa.array(fp, pa.int64())], names=["h", "lo", "n", "fp"])
        group, size = [], 0


def _compare_shards(length: int):
    """Rows sorted by (fp, i, j): whole groups are gathered up to ``CHUNK`` bytes and share a suffix array; strings of
    different anchors can't be equal."""

    def results(sids: list, shard_or_flags, counts) -> pa.RecordBatch:
        at = starts_of(counts)
        runs = [_runs(shard_or_flags[a:b]) for a, b in zip(at[:-1], at[1:])]
        kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
        return pa.RecordBatch.from_arrays([pa.array(sids, pa.binary()), pa.array(runs, kind)], names=["sid", "runs"])

    def one_shard(rows):
        shard = Shard([r["snippet"] for r in rows], length)
        return results([r["sid"] for r in rows], shard.repeated(), shard.count)

    def two_shards(rows):
        sides = [[r for r in rows if (r["mine"] == r["i"]) == first] for first in (True, False)]
        if all(sides):
            a, b = (Shard([r["snippet"] for r in side], length) for side in sides)
            yield results([r["sid"] for r in sides[0]], a.found_in(b), a.count)
            yield results([r["sid"] for r in sides[1]], b.found_in(a), b.count)

    def work(batches):
        chunk, size, group, key = [], 0, [], None

        def close():
            nonlocal chunk, size, group
            if group and group[0]["i"] != group[0]["j"]:
                yield from two_shards(group)
            else:
                chunk += group
                size += sum(len(r["snippet"]) for r in group)
            group = []
            if size > CHUNK:
                yield one_shard(chunk)
                chunk, size = [], 0

        for batch in batches:
            for row in batch.to_pylist():
                at = (row["fp"], row["i"], row["j"])
                if at != key:
                    yield from close()
                    key = at
                group.append(row)
        yield from close()
        if chunk:
            yield one_shard(chunk)

    return work


def dedup(docs: DataFrame, id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``id, n_bytes, spans, kept`` of every row: the removed byte runs, and the remaining bytes as a binary."""
    length = options.get("length", LENGTH)
    found = materialise(spans(docs, text, **options), "spans")
    given = docs.select(F.col(id).alias("id"), hash_of(text).alias("h"), text_or_empty(text).alias("text"))
    copies = materialise(given.groupBy("h").count().where("count > 1").select("h", F.lit(True).alias("copied")), "copies")
    rows = given.join(found, "h", "left").join(copies, "h", "left")
    whole = F.coalesce(F.col("copied") & (F.octet_length("text") >= length), F.lit(False))
    all_of_it = F.array(F.struct(F.lit(0).alias("start"), F.octet_length("text").cast("int").alias("end")))
    rows = rows.select("id", "text", F.when(whole, all_of_it).otherwise(F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>"))).alias("spans"))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def work(batches):
        for batch in slices(batches, "text", UNIT):
            sizes, cuts, kept = [], [], []
            for t, parts in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
                raw = t.encode("utf-8", "surrogatepass")
                merged: list[dict] = []
                for p in sorted(parts, key=lambda p: p["start"]):
                    if merged and p["start"] <= merged[-1]["end"]:
                        merged[-1]["end"] = max(merged[-1]["end"], p["end"])
                    else:
                        merged.append(dict(p))
                at = [0, *(x for p in merged for x in (p["start"], p["end"])), len(raw)]
                sizes.append(len(raw))
                cuts.append(merged)
                kept.append(b"".join(raw[a:b] for a, b in zip(at[::2], at[1::2])))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sizes, pa.int64()), pa.array(cuts, kind), pa.array(kept, pa.binary())], names=["id", "n_bytes", "spans", "kept"])

    schema = rows.select("id", F.lit(0).cast("long").alias("n_bytes"), F.col("spans").cast("array<struct<start:bigint,end:bigint>>"), F.lit(None).cast("binary").alias("kept")).schema
    return rows.mapInArrow(work, schema)
