"""Periodic runs in word sequences, by uniting suffix classes in the order of falling common prefixes.

A run is a stretch of consecutive words with smallest period q, of a given least length and exponent, that no
neighbouring word extends. Texts without two equal stretches of the shortest useful common prefix are set aside by a
rolling hash; the others are sorted together, as suffixes whose classes never cross texts: ranks of doubled length, of
which only those that still tie are sorted again. Neighbours in the suffix order are then united by falling common
prefix, as in Kruskal's algorithm, with a union-find whose classes are ordered sets of positions, the smaller entered
into the larger. Two positions that become neighbours in a set share exactly the prefix of that step; where their
distance is no more than it, they seed a run: the pair is a run's first, unless the words before are equal too. The
distance is the smallest period, for with a smaller one a position between them would have joined earlier.

Words are ``[^\\x20\\x09-\\x0D]+``. Cases: NULL and empty texts have no words and no runs; rows are independent, so
repeated rows, NULL or repeated ids and other columns change nothing; an empty table gives an empty result. Equal
runs can't occur: start and period tell runs apart, and they come in this order. A text of any length is worked on
whole, in one task; memory is some 150 bytes a word of it.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from augury.llm.common import slices, small_batches, starts_of

LEAST = 24  # words of a run
EXPONENT = 3  # least length as a multiple of the period
UNIT = 2_000_000  # bytes of text worked on at a time
CHUNK = 1024  # positions in one piece of an ordered set
RUN = "struct<start:bigint,length:bigint,period:bigint>"
MIX = np.uint64(0x9E3779B97F4A7C15)


def shortest_prefix(least: int, exponent: int) -> int:
    """The least common prefix of a run's start and the same word one period on."""
    return min(max(least - q, (exponent - 1) * q) for q in range(1, max(2, least + 1)))


class Positions:
    """An ordered set of positions in pieces of bounded length."""

    __slots__ = ("pieces", "lasts", "size")

    def __init__(self, at: int):
        self.pieces, self.lasts, self.size = [[at]], [at], 1

    def __iter__(self):
        return chain.from_iterable(self.pieces)

    def add(self, at: int) -> tuple[int, int]:
        """Enter a new position; returns the one before and the one after, -1 where there is none."""
        lasts = self.lasts
        k = bisect_left(lasts, at) if len(lasts) > 1 else 0
        k -= k == len(lasts)
        piece = self.pieces[k]
        j = bisect_left(piece, at)
        before = piece[j - 1] if j else (lasts[k - 1] if k else -1)
        after = piece[j] if j < len(piece) else (self.pieces[k + 1][0] if k + 1 < len(lasts) else -1)
        piece.insert(j, at)
        lasts[k] = piece[-1]
        self.size += 1
        if len(piece) > 2 * CHUNK:
            self.pieces[k : k + 1] = [piece[:CHUNK], piece[CHUNK:]]
            insort(lasts, piece[CHUNK - 1])
        return before, after


def suffix_order(symbols: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """All suffixes in order, and per k the rank of each position among stretches of 2**k symbols (equal: same rank).

    No two suffixes may be equal up to their end, as is so where the last symbol occurs once.
    """
    n = len(symbols)
    slot = np.arange(n)
    order = np.argsort(symbols, kind="stable")
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    opens = np.r_[True, symbols[order][1:] != symbols[order][:-1]]
    rank[order] = np.maximum.accumulate(np.where(opens, slot, 0))
    levels, step = [rank.astype(np.int32)], 1
    tied = order[~(opens & np.r_[opens[1:], True])]
    while len(tied):
        old, ahead = rank[tied], rank[np.minimum(tied + step, n)]
        by = np.argsort(old * (n + 1) + ahead + 1, kind="stable")
        at, old, ahead = tied[by], old[by], ahead[by]
        first = np.r_[True, old[1:] != old[:-1]]
        k = slot[: len(at)]
        place = old + k - np.maximum.accumulate(np.where(first, k, 0))
        opens = first | np.r_[True, ahead[1:] != ahead[:-1]]
        order[place] = at
        rank[at] = place[np.maximum.accumulate(np.where(opens, k, 0))]
        tied = at[~(opens & np.r_[opens[1:], True])]
        step *= 2
        levels.append(rank.astype(np.int32))
    return order, levels


def common_prefixes(order: np.ndarray, levels: list[np.ndarray], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Neighbours in the suffix order with a common prefix of at least ``least`` symbols, and that prefix's length."""
    base = least.bit_length() - 1
    if base >= len(levels):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    same = np.flatnonzero(levels[base][order[:-1]] == levels[base][order[1:]])
    i, j = order[same], order[same + 1]
    length = np.zeros(len(i), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        length += (levels[k][i + length] == levels[k][j + length]).astype(np.int64) << k
    keep = length >= least
    return i[keep], j[keep], length[keep]


def seeds(i: np.ndarray, j: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Rows (position, later position, common prefix) of positions that become neighbours at a distance within it."""
    used, number = np.unique(np.r_[i, j], return_inverse=True)
    at = used.tolist()
    parent = list(range(len(at)))
    sets: list = list(at)  # a single position, or an ordered set of several
    fall = np.argsort(-length, kind="stable")
    found: list[tuple[int, int, int]] = []
    a_of, b_of = number[: len(i)][fall].tolist(), number[len(i) :][fall].tolist()
    for a, b, common in zip(a_of, b_of, length[fall].tolist()):
        while parent[a] != a:
            parent[a] = a = parent[parent[a]]
        while parent[b] != b:
            parent[b] = b = parent[parent[b]]
        large, small = sets[a], sets[b]
        if (1 if isinstance(large, int) else large.size) < (1 if isinstance(small, int) else small.size):
            a, b, large, small = b, a, small, large
        if isinstance(large, int):
            large = sets[a] = Positions(large)
        parent[b], sets[b] = a, None
        # Entered in order: a position before x is final, one after it only if no other of the smaller set lies between.
        entering, last = ([small] if isinstance(small, int) else list(small)), -1
        for x, following in zip(entering, entering[1:] + [-1]):
            before, after = large.add(x)
            if before != last and before >= 0 and x - before <= common:
                found.append((before, x, common))
            if after >= 0 and after - x <= common and (following < 0 or after < following):
                found.append((x, after, common))
            last = x
    return np.array(found, np.int64).reshape(-1, 3)


def find_runs(ids: np.ndarray, text_at: np.ndarray, least: int = LEAST, exponent: int = EXPONENT) -> np.ndarray:
    """Rows (start, length, period) by start and period: the runs of word numbers, within texts that start at ``text_at``."""
    prefix = shortest_prefix(least, exponent)
    text_of = np.repeat(np.arange(len(text_at) - 1), np.diff(text_at))
    active = np.unique(repeating(ids, text_of, text_at, prefix))
    if not len(active):
        return np.zeros((0, 3), np.int64)
    inside = np.isin(text_of, active)
    where = np.flatnonzero(inside)
    # Classes of one text come before those of the next, so equal words of different texts are different symbols.
    symbols = text_of[where] * (int(ids.max()) + 1) + ids[where]
    found = seeds(*common_prefixes(*suffix_order(symbols), prefix))
    start, period = found[:, 0], found[:, 1] - found[:, 0]
    length = found[:, 2] + period
    keep = (length >= least) & (length >= exponent * period)
    start, period, length = start[keep], period[keep], length[keep]
    first = (start == 0) | (symbols[start - 1] != symbols[start + period - 1])
    runs = np.stack([where[start], length, period], 1)[first]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def repeating(ids: np.ndarray, text_of: np.ndarray, text_at: np.ndarray, prefix: int) -> np.ndarray:
    """Texts that may hold two equal stretches of ``prefix`` words: all that do, and by chance some that don't."""
    width = 1 << (prefix.bit_length() - 1)
    if len(ids) < width:
        return np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        h, power, step = (ids.astype(np.uint64) + np.uint64(1)) * MIX, MIX | np.uint64(1), 1
        h ^= h >> np.uint64(29)
        while step < width:
            h = h[:-step] * power + h[step:]
            power, step = power * power, step * 2
        h += text_of[: len(h)].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    whole = np.flatnonzero(np.arange(len(h)) + width <= text_at[1:][text_of[: len(h)]])
    h = h[whole]
    order = np.argsort(h)
    same = h[order][1:] == h[order][:-1]
    return text_of[whole[order[1:][same]]]


def runs(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), least: int = LEAST, exponent: int = EXPONENT) -> DataFrame:
    """``keep`` columns, ``n_words``, ``runs`` (start, length, period; by start and period) and ``collapsed`` of every row.

    ``collapsed``: the words joined by one blank, without those that a run repeats after its first period.
    """
    small_batches(df)
    schema = df.select(*keep).schema.add("n_words", "long", False).add("runs", ArrayType(StructType([StructField(c, LongType()) for c in ("start", "length", "period")])), False).add("collapsed", "string", False)
    kind = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def work(batches):
        for batch in slices(batches, "__text", UNIT):
            words = [(t or "").encode().split() for t in batch.column("__text").to_pylist()]
            sizes = np.fromiter(map(len, words), np.int64, len(words))
            text_at = starts_of(sizes)
            number: dict[bytes, int] = defaultdict(count().__next__)
            ids = np.fromiter(map(number.__getitem__, chain.from_iterable(words)), np.int64, int(text_at[-1]))
            found = find_runs(ids, text_at, least, exponent)
            of = np.searchsorted(text_at, found[:, 0], side="right") - 1
            dropped = np.zeros(len(ids) + 1, np.int32)
            np.add.at(dropped, found[:, 0] + found[:, 2], 1)
            np.add.at(dropped, found[:, 0] + found[:, 1], -1)
            kept = np.cumsum(dropped)[:-1] == 0
            for k in np.unique(of).tolist():
                words[k] = [words[k][p] for p in np.flatnonzero(kept[text_at[k] : text_at[k + 1]]).tolist()]
            offsets = pa.array(starts_of(np.bincount(of, minlength=len(words))).astype(np.int32))
            values = pa.StructArray.from_arrays([pa.array(found[:, 0] - text_at[of]), pa.array(found[:, 1]), pa.array(found[:, 2])], fields=list(kind))
            columns = [*batch.columns[:-1], pa.array(sizes), pa.ListArray.from_arrays(offsets, values), pa.array([b" ".join(w).decode() for w in words], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return df.select(*keep, df[text].cast("string").alias("__text")).mapInArrow(work, schema)
