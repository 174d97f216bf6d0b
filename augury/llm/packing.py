"""Vector best-fit packing of token sequences, the longest first.

A piece takes three things of a sequence: tokens, one of the documents it may hold, and attention cost (the square of
the piece's length). Pieces are placed from the longest down, each into the open sequence that fits it best under all
three capacities: the one with the smallest weighted norm of what would be left (rule ``norm``), or the smallest
weighted dot product of the piece's demand and what is left (rule ``dot``), the oldest of equals; where none fits, a
new sequence opens.

Pieces of one length are alike, and so are sequences with the same history. So the choice is made for counts: the
histogram of lengths, at most ``tokens`` rows at any corpus size, is packed as intervals of alike sequences. A piece
length fills the sequences of the best interval, each with as many of its pieces as fit, and splits the interval where
the pieces run out; that is what one piece at a time would do, for a sequence left smaller fits better. The resulting
plan says which pieces of a length, by number, go to which sequences at which offset; its rows follow from
the lengths and capacities, not from the number of documents. Spark tokenises, numbers the pieces of each length (per
task, then by running sums over tasks) and places them by the plan. Several rules may be tried on the histogram; the
plan with the fewest sequences holds.

Documents: ids of the text and an end id. Only longer ones than a sequence are cut, into whole sequences' lengths, the
first piece being the shorter one. Cases: a NULL text is empty and becomes the end id alone; NULL and repeated ids and
repeated rows are packed row by row; ties follow the order of lengths and of sequence numbers; an empty table gives an
empty result; other columns play no part. Which of two equally long pieces gets which place depends on the input's
files and order of rows.
"""

from __future__ import annotations

import base64
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from augury.llm.common import slices, small_batches
from augury.session import materialise

TOKENS = 2048
END = 0
UNIT = 4_000_000  # bytes of text of one Arrow batch
# Rules tried in the contract's query: (rule, weights of tokens, documents and attention cost).
RULES = (("norm", (1.0, 0.0, 0.0)), ("norm", (1.0, 0.05, 0.0)), ("norm", (1.0, 0.0, 0.05)), ("dot", (1.0, 0.05, 0.05)))
PLAN = "length bigint, first bigint, last bigint, sequence bigint, offset bigint"


@cache
def encoder(path: str):
    """The tokenizer of a rank file; texts of special tokens become their ids, as in the library it stands for."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": len(ranks)})


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def cut(n_ids: int, tokens: int) -> list[tuple[int, int]]:
    """Start and length of each piece of a document: the first takes what whole lengths leave."""
    rest = n_ids % tokens or tokens
    return [(0, rest)] + [(at, tokens) for at in range(rest, n_ids, tokens)]


def pieces(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), tokens: int = TOKENS, end: int = END, path: str | None = None, ids: bool = False) -> DataFrame:
    """``keep`` columns and ``piece, start, length, ids_crc32`` of every piece, with ``_task`` and ``_place``: its number among
    the pieces of its length in its task. ``ids`` adds the piece's ids as little-endian unsigned 32-bit integers."""
    small_batches(df)
    schema = df.select(*keep).schema
    for name in ("piece", "_task", "_place"):
        schema = schema.add(name, "integer", False)
    for name in ("start", "length", "ids_crc32"):
        schema = schema.add(name, "long", False)
    schema = schema.add("ids", "binary", False) if ids else schema

    def work(batches):
        coder, task, met = encoder(path or default_path()), TaskContext.get().partitionId(), np.zeros(tokens + 1, np.int64)
        for batch in slices(batches, "__text", UNIT):
            row, piece, place, start, length, crc, raw = [], [], [], [], [], [], []
            for k, t in enumerate(batch.column("__text").to_pylist()):
                own = np.append(coder.encode_to_numpy(t or "", allowed_special="all"), np.uint32(end)).astype("<u4")
                for p, (at, n) in enumerate(cut(len(own), tokens)):
                    data = own[at : at + n].tobytes()
                    row.append(k), piece.append(p), place.append(met[n]), start.append(at), length.append(n), crc.append(zlib.crc32(data))
                    met[n] += 1
                    if ids:
                        raw.append(data)
            taken = pa.RecordBatch.from_arrays(batch.columns[:-1], names=schema.names[: len(keep)]).take(pa.array(row, pa.int32()))
            columns = [*taken.columns, pa.array(piece, pa.int32()), pa.array([task] * len(row), pa.int32()), pa.array(place, pa.int32())]
            columns += [pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(raw, pa.binary())] if ids else columns, names=schema.names)

    return df.select(*keep, df[text].cast("string").alias("__text")).mapInArrow(work, schema)


class Open:
    """Intervals of alike sequences that may still take something: first number, how many, and what each has left."""

    def __init__(self):
        self.n = 0
        self.first, self.count = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.left = np.zeros((1024, 3), np.int64)

    def add(self, first: int, count: int, left: np.ndarray) -> None:
        if self.n == len(self.first):
            self.first, self.count, self.left = (np.concatenate([x, np.zeros_like(x)]) for x in (self.first, self.count, self.left))
        self.first[self.n], self.count[self.n], self.left[self.n] = first, count, left
        self.n += 1

    def close(self, smallest: int) -> None:
        """Forget the intervals that can't take even the smallest piece."""
        left = self.left[: self.n]
        keep = np.flatnonzero((left[:, 0] >= smallest) & (left[:, 1] >= 1) & (left[:, 2] >= smallest * smallest))
        for x in (self.first, self.count, self.left):
            x[: len(keep)] = x[keep]
        self.n = len(keep)

    def best(self, demand: np.ndarray, capacity: np.ndarray, rule: str, weights: np.ndarray) -> int:
        left = self.left[: self.n]
        fits = np.flatnonzero((left >= demand).all(axis=1))
        if not len(fits):
            return -1
        after = (left[fits] - demand) / capacity
        cost = (weights * after * after).sum(1) if rule == "norm" else (weights * (demand / capacity) * after).sum(1)
        tied = fits[cost == cost.min()]
        return int(tied[np.argmin(self.first[tied])])


def plan(
    counts: dict[int, int], tokens: int = TOKENS, documents: int | None = None, attention: int | None = None,
    rule: str = "norm", weights: tuple[float, float, float] = (1.0, 0.0, 0.0),
) -> tuple[int, list[tuple[int, int, int, int, int]]]:
    """The number of sequences, and rows (length, first piece, last piece, first sequence, offset): pieces of one length in
    a row go to sequences in a row, all at the same offset. ``documents``, ``attention``: capacities, by default what
    ``tokens`` implies."""
    capacity = np.array([tokens, tokens if documents is None else documents, tokens * tokens if attention is None else attention], np.int64)
    if rule not in ("norm", "dot"):
        raise ValueError(f"no rule {rule}")
    weigh, open_, sequences, rows = np.array(weights, float), Open(), 0, []
    lengths = sorted((n for n, c in counts.items() if c), reverse=True)
    for n in lengths:
        demand, todo, done = np.array([n, 1, n * n], np.int64), counts[n], 0
        if (demand > capacity).any():
            raise ValueError(f"a piece of {n} tokens is over a capacity of a whole sequence")
        open_.close(lengths[-1])
        while done < todo:
            k = open_.best(demand, capacity, rule, weigh)
            fresh = k < 0
            first, room, left = (sequences, todo, capacity) if fresh else (int(open_.first[k]), int(open_.count[k]), open_.left[k].copy())
            # A sequence that took one piece fits the next of its length best, until it is full.
            each = min(int((left // demand).min()), todo - done)
            number = min(room, (todo - done) // each)
            for j in range(each):
                rows.append((n, done + j * number, done + (j + 1) * number - 1, first, int(tokens - left[0]) + j * n))
            done += number * each
            if fresh:
                sequences += number
                open_.add(first, number, left - each * demand)
            else:
                if number < room:
                    open_.add(first + number, room - number, left)
                open_.count[k], open_.left[k] = number, left - each * demand
    return sequences, rows


def best_plan(counts: dict[int, int], tokens: int = TOKENS, documents: int | None = None, attention: int | None = None, rules=RULES) -> tuple[int, list]:
    """The plan with the fewest sequences of those by ``rules``, the first of equals; none is tried beyond one that can't be bettered."""
    least = -(-sum(n * c for n, c in counts.items()) // tokens)
    best = None
    for rule, weights in rules:
        made = plan(counts, tokens, documents, attention, rule, weights)
        best = made if best is None or made[0] < best[0] else best
        if best[0] == least:
            break
    return best


def placed(spark: SparkSession, cut_up: DataFrame, rows: list[tuple[int, int, int, int, int]], tokens: int = TOKENS) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to the pieces, by their number ``_number`` among those of their length."""
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    span = np.int64(1) << 40
    shared = spark.sparkContext.broadcast((table[:, 0] * span + table[:, 1], table))
    schema = cut_up.drop("_number").schema.add("sequence_id", "long", False).add("offset", "long", False)

    def work(batches):
        keys, table = shared.value
        for batch in batches:
            length, number = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "_number"))
            at = np.searchsorted(keys, length * span + number, side="right") - 1
            columns = [batch.column(k) for k, c in enumerate(batch.schema.names) if c != "_number"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(table[at, 3] + number - table[at, 1]), pa.array(table[at, 4])], names=schema.names)

    return cut_up.mapInArrow(work, schema)


def pack(
    df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), tokens: int = TOKENS, documents: int | None = None,
    attention: int | None = None, rules=RULES, end: int = END, path: str | None = None, ids: bool = False,
) -> DataFrame:
    """``keep`` columns and ``piece, start, length, ids_crc32, sequence_id, offset`` of every piece, ``ids`` too if asked for."""
    cut_up = materialise(pieces(df, text, keep, tokens, end, path, ids), "pieces")
    # One row per task and length, however many documents a length has.
    per_task = materialise(cut_up.groupBy("length", "_task").agg((F.max("_place") + 1).cast("long").alias("_n")), "lengths")
    counts = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    _, rows = best_plan(counts, tokens, documents, attention, rules)
    earlier = Window.partitionBy("length").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    base = materialise(per_task.select("length", "_task", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base")), "bases")
    numbered = cut_up.join(base, ["length", "_task"]).withColumn("_number", F.col("_base") + F.col("_place"))
    out = placed(df.sparkSession, numbered.select(*cut_up.drop("_task", "_place").columns, "_number"), rows, tokens)
    return out.select(*keep, "piece", "start", "length", "ids_crc32", *(["ids"] if ids else []), "sequence_id", "offset")
