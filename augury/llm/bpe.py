"""Byte-level BPE encoding and decoding by batched numpy merge rounds.

A batch of texts is one flat array of code points. Class changes give the word boundaries for all texts at once; the
bytes of all words not met before form one flat array of symbols. Each round finds every word's lowest-ranked adjacent
pair, by binary search over the sorted pair keys, and merges its occurrences; only pairs beside a merge are looked up
again. Finished words leave the array and are kept for later texts.

Texts: NULL counts as empty and gives no ids. Rows are independent: repeated rows, NULL or repeated ids and other
columns change nothing. Texts longer than a work unit are cut between a visible character and white space, where a
word always ends, so their length is not limited.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from augury.llm.common import SPACE, char_classes, code_points, slices, small_batches, spread, starts_of

UNIT = 400_000  # code points worked on at a time
WORDS_KEPT = 150_000
NONE = np.iinfo(np.int64).max
# The endings split off after an apostrophe, in the order tried.
ENDINGS = ["s", "t", "re", "ve", "m", "ll", "d"]


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in vocabulary files: itself where printable, else 256 on."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


class Vocabulary:
    """Tokens, sorted pair keys and the words encoded so far."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ids = spec["model"]["vocab"]
        symbols = byte_symbols()
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec.get("added_tokens", [])):
            raise ValueError("added tokens that take in their surroundings are not supported")
        self.size = max([*ids.values(), *special.values()]) + 1
        texts = [b""] * self.size
        for token, i in ids.items():
            texts[i] = bytes(symbols[c] for c in token) if all(c in symbols for c in token) else token.encode()
        for token, i in special.items():
            texts[i] = token.encode()
        self.bytes = np.frombuffer(b"".join(texts), np.uint8)
        self.byte_at = starts_of(np.array([len(t) for t in texts]))
        self.of_byte = np.zeros(256, np.int64)
        for c, b in symbols.items():
            self.of_byte[b] = ids[c]
        pairs = [p.split(" ") if isinstance(p, str) else p for p in spec["model"]["merges"]]
        left = np.array([ids[a] for a, _ in pairs], np.int64)
        right = np.array([ids[b] for _, b in pairs], np.int64)
        made = np.array([ids[a + b] for a, b in pairs], np.int64)
        keys = left * self.size + right
        order = np.argsort(keys)
        self.keys, self.rank, self.made = keys[order], order.astype(np.int64), made[order]
        self.special = special
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {t.encode(): k for k, t in enumerate(self.special)}
        self.ids = np.array(list(self.special.values()), np.uint32)
        self.id_at = np.arange(len(self.special) + 1, dtype=np.int64)

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged symbol of each pair; rank NONE for pairs that never merge."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], NONE), self.made[at]

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, one after the other, and how many each has. Words aren't empty."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        sym = self.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), sizes)
        rank, made = np.full(len(sym), NONE), np.zeros(len(sym), np.int64)  # of the pair that starts at each symbol

        def refresh(at: np.ndarray) -> None:
            at = at[(at >= 0) & (at < len(sym) - 1)]
            inside = word[at] == word[at + 1]
            rank[at[~inside]] = NONE
            at = at[inside]
            rank[at], made[at] = self.look_up(sym[at], sym[at + 1])

        refresh(np.arange(len(sym) - 1))
        done_word, done_sym = [], []
        while len(sym):
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            low = np.minimum.reduceat(rank, first)
            low_of = np.repeat(low, np.diff(np.r_[first, len(sym)]))
            ended = low_of == NONE
            if ended.any():
                done_word.append(word[ended])
                done_sym.append(sym[ended])
                stay = ~ended
                sym, word, rank, made, low_of = sym[stay], word[stay], rank[stay], made[stay], low_of[stay]
                if not len(sym):
                    break
            at = np.flatnonzero(rank == low_of)
            close = np.diff(at) == 1
            if close.any():  # a pair of equal symbols, repeated: from the left, every second one
                run = np.maximum.accumulate(np.where(np.r_[True, ~close], np.arange(len(at)), 0))
                at = at[(np.arange(len(at)) - run) % 2 == 0]
            sym[at] = made[at]
            stay = np.ones(len(sym), bool)
            stay[at + 1] = False
            at = at - np.arange(len(at))
            sym, word, rank, made = sym[stay], word[stay], rank[stay], made[stay]
            rank[at] = NONE
            refresh(np.unique(np.r_[at - 1, at]))
        word = np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        return np.concatenate(done_sym)[order].astype(np.uint32), np.bincount(word, minlength=len(words))

    def number_words(self, words: list[bytes]) -> np.ndarray:
        """The number of each word among the known ones, after encoding those that are new."""
        if len(self.known) > WORDS_KEPT:
            self.forget()
        new = list(dict.fromkeys(w for w in words if w not in self.known))
        if new:
            ids, counts = self.merge(new)
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
            self.ids = np.concatenate([self.ids, ids])
            self.id_at = np.concatenate([self.id_at, self.id_at[-1] + np.cumsum(counts)])
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text."""
        for unit in _units(texts):
            parts, fixed, of_text = [], [], []
            for k, text in enumerate(unit):
                for j, part in enumerate(self.split.split(text) if self.split else [text]):
                    if part:
                        parts.append(part)
                        fixed.append(j % 2 == 1)
                        of_text.append(k)
            if not parts:
                yield from (np.zeros(0, np.uint32) for _ in unit)
                continue
            words, per_part = words_of(parts, fixed)
            number = self.number_words(words)
            counts = np.diff(self.id_at)[number]
            ids = self.ids[spread(self.id_at[number], counts)]
            per_text = np.zeros(len(unit), np.int64)
            np.add.at(per_text, np.repeat(np.array(of_text), per_part), counts)
            at = starts_of(per_text)
            yield from (ids[a:b] for a, b in zip(at[:-1], at[1:]))

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; bytes that are no UTF-8 become replacement characters."""
        ids = ids.astype(np.int64)
        lengths = self.byte_at[ids + 1] - self.byte_at[ids]
        return self.bytes[spread(self.byte_at[ids], lengths)].tobytes().decode("utf-8", "replace")


def _units(texts: list[str]) -> Iterator[list[str]]:
    unit, size = [], 0
    for t in texts:
        if unit and size + len(t) > UNIT:
            yield unit
            unit, size = [], 0
        unit.append(t)
        size += len(t)
    if unit:
        yield unit


def cut(text: str) -> Iterator[str]:
    """Pieces of a long text that are encoded on their own: each ends where a visible character meets white space."""
    edge = re.compile(r"\S(?=\s)")
    while len(text) > 2 * UNIT and (m := edge.search(text, UNIT)):
        yield text[: m.end()]
        text = text[m.end() :]
    yield text


def words_of(parts: list[str], fixed: list[bool]) -> tuple[list[bytes], np.ndarray]:
    """UTF-8 words of non-empty parts in order, and how many each part has; a fixed part is one word.

    A word is a run of letters, of numbers or of other visible characters with one blank before it, an English ending
    after an apostrophe, or white space up to the blank that belongs to the next word.
    """
    joined = "".join(parts)
    cp = code_points(joined)
    kind = char_classes()[cp]
    part_at = starts_of(np.array([len(p) for p in parts]))
    opens = np.zeros(len(cp) + 1, bool)
    opens[part_at] = True
    begin = opens.copy()
    begin[1:-1] |= kind[1:] != kind[:-1]
    space = kind == SPACE
    last = np.flatnonzero(space[:-1] & ~space[1:] & ~opens[1:-1])  # white space right before a visible character
    begin[last] = True
    begin[last[cp[last] == ord(" ")] + 1] = False
    quotes = np.flatnonzero((cp == ord("'")) & begin[:-1])
    if len(quotes):
        padded = np.r_[cp, 0, 0]
        stop = part_at[np.searchsorted(part_at, quotes, side="right")]
        for ending in ENDINGS:
            n = len(ending)
            fits = quotes + n < stop
            for j, c in enumerate(ending):
                fits &= padded[quotes + 1 + j] == ord(c)
            at = quotes[fits]
            for j in range(1, n + 1):
                begin[at + j] = False
            begin[at + n + 1] = True
    for k in np.flatnonzero(fixed):
        begin[part_at[k] + 1 : part_at[k + 1]] = False
    starts = np.flatnonzero(begin)  # the end included
    width = 1 + (cp >= 0x80).astype(np.int64) + (cp >= 0x800) + (cp >= 0x10000)
    byte_at = starts_of(width)[starts].tolist()
    raw = joined.encode("utf-8", "surrogatepass")
    words = [raw[a:b] for a, b in zip(byte_at[:-1], byte_at[1:])]
    return words, np.diff(np.searchsorted(starts, part_at))


@cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), path: str | None = None, decoded: bool = False) -> DataFrame:
    """``keep`` columns, ``n_tokens`` and ``ids`` of every row: ids as little-endian unsigned 32-bit integers in a binary.

    ``decoded`` adds the text that the ids decode to. ``path``: the vocabulary file on every executor.
    """
    small_batches(df)
    schema = df.select(*keep).schema.add("n_tokens", "long", False).add("ids", "binary", False)
    if decoded:
        schema = schema.add("decoded", "string", False)

    def work(batches):
        vocab = vocabulary(path or default_path())
        for batch in slices(batches, "__text", 2 * UNIT):
            texts = [t or "" for t in batch.column("__text").to_pylist()]
            if max(map(len, texts)) > 2 * UNIT:
                each = [np.concatenate(list(vocab.encode(list(cut(t))))) for t in texts]
            else:
                each = list(vocab.encode(texts))
            columns = [*batch.columns[:-1], pa.array([len(x) for x in each], pa.int64()), pa.array([x.astype("<u4").tobytes() for x in each], pa.binary())]
            if decoded:
                columns.append(pa.array([vocab.decode(x) for x in each], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return df.select(*keep, df[text].cast("string").alias("__text")).mapInArrow(work, schema)


def decode(df: DataFrame, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",), path: str | None = None) -> DataFrame:
    """``keep`` columns and ``decoded``, the text of a binary column of little-endian ids; NULL ids give an empty text."""
    schema = df.select(*keep).schema.add("decoded", "string", False)

    def work(batches):
        vocab = vocabulary(path or default_path())
        for batch in slices(batches, "__ids", 2 * UNIT):
            texts = [vocab.decode(np.frombuffer(x or b"", "<u4")) for x in batch.column("__ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=schema.names)

    return df.select(*keep, df[ids].alias("__ids")).mapInArrow(work, schema)
