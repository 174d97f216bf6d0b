"""Language identification by multilingual mixture inference.

A text is a bag of letter trigrams drawn from a mixture of languages and of noise, which gives all trigrams the same
chance. Expectation-maximisation estimates the proportions from the trigram likelihoods of each language. Then the
least language leaves the set as long as the penalised likelihood (a price per language that grows with the
logarithm of the number of letters) gets no worse. The largest remaining proportion is the prediction.

Cases: a NULL text, a text without letters, and any text when nothing could be learnt give ``und`` with score 0.
Repeated rows get equal results; NULL labels are not learnt from; ids and other columns play no part.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from augury.llm.common import LETTER, char_classes, slices, small_batches, starts_of

GRAM_BITS = 16
UNKNOWN = "und"
UNIT = 1_000_000  # bytes of text worked on at a time


@dataclass
class Languages:
    """``chance[g, l]``: of trigram cell g in language l; the last column is noise."""

    names: list[str]
    chance: np.ndarray


def grams_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The trigram cell around each letter of all texts, and how many letters each text has."""
    lower = [t.lower() for t in texts]
    joined = " " + " ".join(lower) + " "
    cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = char_classes()[cp] == LETTER
    cp = np.where(letter, cp, 0)
    at = np.flatnonzero(letter)
    h = cp[at - 1] * np.uint32(0x9E3779B1) + cp[at] * np.uint32(0x85EBCA77) + cp[at + 1] * np.uint32(0xC2B2AE3D)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    edges = 1 + starts_of(np.array([len(t) + 1 for t in lower]))
    return (h >> np.uint32(32 - GRAM_BITS)).astype(np.int64), np.diff(np.searchsorted(at, edges))


def count_grams(docs: DataFrame, lang: str = "lang", text: str = "text") -> DataFrame:
    """``lang, gram, n`` over all labelled texts. Partitions add up their own counts before the shuffle."""

    def work(batches):
        counts: dict[str, np.ndarray] = {}
        for batch in slices(batches, "text", UNIT):
            by_lang: dict[str, list[str]] = {}
            for name, t in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                by_lang.setdefault(name, []).append(t)
            for name, texts in by_lang.items():
                if name not in counts:
                    counts[name] = np.zeros(1 << GRAM_BITS, np.int64)
                counts[name] += np.bincount(grams_of(texts)[0], minlength=1 << GRAM_BITS)
            if len(counts) > 64:
                yield from _rows(counts)
                counts = {}
        yield from _rows(counts)

    small_batches(docs)
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(work, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _rows(counts: dict[str, np.ndarray]):
    for name, n in counts.items():
        gram = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(gram), pa.string()), pa.array(gram, pa.int32()), pa.array(n[gram], pa.int64())], names=["lang", "gram", "n"])


def learn(docs: DataFrame, lang: str = "lang", text: str = "text", most_languages: int = 500) -> Languages:
    """Trigram chances per language from all labelled texts.

    What comes to the driver has at most 65,536 cells per language; more than ``most_languages`` is an error.
    """
    counts = count_grams(docs, lang, text).limit((most_languages << GRAM_BITS) + 1).toPandas()
    if counts["lang"].nunique() > most_languages:
        raise ValueError(f"more than {most_languages} languages")
    return from_counts(counts)


def from_counts(counts, smoothing: float = 0.05) -> Languages:
    names = sorted(counts["lang"].unique())
    n = np.zeros((1 << GRAM_BITS, len(names)))
    column = counts["lang"].map({k: i for i, k in enumerate(names)}).to_numpy(np.int64)
    n[counts["gram"].to_numpy(np.int64), column] = counts["n"].to_numpy(np.float64)
    n += smoothing
    n /= n.sum(axis=0)
    return Languages(names, np.column_stack([n, np.full(len(n), 1.0 / len(n))]))


def proportions(model: Languages, texts: list[str], rounds: int = 15, price: float = 4.0, noise: float = 0.02) -> tuple[np.ndarray, np.ndarray]:
    """Shares (texts x languages, noise left out) after selection, and letters per text.

    A short estimate over all languages decides which texts need more than their single best language.
    """
    cells, letters = grams_of(texts)
    k = len(model.names)
    out = np.zeros((len(texts), k))
    have = np.flatnonzero(letters)
    if not len(have) or not k:
        return out, letters
    key = np.sort((np.repeat(np.arange(len(have)), letters[have]) << GRAM_BITS) | cells)
    new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    n = np.diff(np.r_[new, len(key)]).astype(np.float32)
    doc, gram = key[new] >> GRAM_BITS, key[new] & ((1 << GRAM_BITS) - 1)
    chance = model.chance[gram].astype(np.float32) * np.float32(1 << GRAM_BITS)  # relative to noise
    total = letters[have].astype(np.float64)
    cost = price * np.log(total + 1)
    at = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    alone = np.add.reduceat(np.log((1 - noise) * chance[:, :k] + np.float32(noise)) * n[:, None], at, axis=0, dtype=np.float64)
    best = alone.argmax(axis=1)
    share = np.full((len(have), k + 1), (1 - noise) / k)
    share[:, k] = noise
    share, fit = _mixture(chance, n, doc, share, max(4, rounds // 3), total)
    mixed = fit - alone.max(axis=1) > cost
    single = np.flatnonzero(~mixed)
    if len(single):
        rows = ~mixed[doc]
        place = np.cumsum(~mixed) - 1
        two = np.column_stack([chance[rows, best[doc[rows]]], chance[rows, k]])
        pair, _ = _mixture(two, n[rows], place[doc[rows]], np.tile([1 - noise, noise], (len(single), 1)), 4, total[single])
        out[have[single], best[single]] = pair[:, 0]
    active = np.flatnonzero(mixed)
    if len(active):
        rows = mixed[doc]
        place = np.cumsum(mixed) - 1
        out[have[active]] = _select(chance[rows], n[rows], place[doc[rows]], share[active], total[active], cost[active], rounds)
    return out, letters


def _select(chance, n, doc, share, total, cost, rounds):
    """Backward selection: drop the least language of each text while its penalised likelihood gets no worse."""
    k = share.shape[1] - 1
    share, fit = _mixture(chance, n, doc, share, rounds, total)
    size = np.full(len(share), k)
    kept = np.ones((len(share), k), bool)
    score = fit - cost * size
    open_ = np.arange(len(share))
    while len(open_ := open_[size[open_] > 1]):
        weakest = np.where(kept[open_], share[open_, :k], np.inf).argmin(axis=1)
        rows = np.zeros(len(share), bool)
        rows[open_] = True
        place = np.cumsum(rows) - 1
        rows = rows[doc]
        trial = share[open_].copy()
        trial[np.arange(len(open_)), weakest] = 0
        trial /= np.maximum(trial.sum(axis=1, keepdims=True), 1e-300)
        trial, fit = _mixture(chance[rows], n[rows], place[doc[rows]], trial, max(4, rounds // 3), total[open_])
        better = fit - cost[open_] * (size[open_] - 1) >= score[open_]
        weakest, trial, fit, open_ = weakest[better], trial[better], fit[better], open_[better]
        size[open_] -= 1
        share[open_], score[open_] = trial, fit - cost[open_] * size[open_]
        kept[open_, weakest] = False
    return share[:, :k]


def _mixture(chance, n, doc, share, rounds, total):
    """Expectation-maximisation for all texts at once, and the likelihoods of the shares it ends with."""
    at = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    share = share.astype(np.float32)
    for _ in range(rounds):
        part = chance * share[doc]
        part *= (n / np.maximum(part.sum(axis=1), np.float32(1e-30)))[:, None]
        share = (np.add.reduceat(part, at, axis=0) / total[:, None]).astype(np.float32)
    mix = np.einsum("ij,ij->i", chance, share[doc])
    fit = np.add.reduceat(n * np.log(np.maximum(mix, np.float32(1e-30))), at, dtype=np.float64)
    return share, fit


def identify(docs: DataFrame, model: Languages, text: str = "text", keep: tuple[str | Column, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, ``lang_pred``, ``score`` (its proportion), ``n_letters`` and ``langs``, the selected set with shares."""
    small_batches(docs)
    schema = docs.select(*keep).schema
    for name, kind in (("lang_pred", T.StringType()), ("score", T.DoubleType()), ("n_letters", T.LongType()), ("langs", T.MapType(T.StringType(), T.DoubleType()))):
        schema = schema.add(name, kind)

    def work(batches):
        names = np.array([*model.names, UNKNOWN], dtype=object)
        for batch in slices(batches, "__text", UNIT):
            shares, letters = proportions(model, [t or "" for t in batch.column("__text").to_pylist()])
            best = shares.argmax(axis=1) if model.names else np.zeros(len(letters), np.int64)
            score = shares.max(axis=1) if model.names else np.zeros(len(letters))
            pred = np.where((letters > 0) & (score > 0), names[best], UNKNOWN)
            text_no, lang_no = np.nonzero(shares > 0)
            at = np.searchsorted(text_no, np.arange(len(letters) + 1))
            langs = pa.MapArray.from_arrays(pa.array(at, pa.int32()), pa.array(names[lang_no].tolist(), pa.string()), pa.array(shares[text_no, lang_no], pa.float64()))
            columns = [pa.array(pred.tolist(), pa.string()), pa.array(np.clip(score, 0, 1), pa.float64()), pa.array(letters, pa.int64()), langs]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], names=schema.names)

    return docs.select(*keep, docs[text].cast("string").alias("__text")).mapInArrow(work, schema)
