"""Personal data: fixed patterns, and a skip-chain conditional random field that adds what they miss.

The patterns find e-mail addresses, IP addresses, payment cards and phone numbers. The field then labels every token
that has a digit or an at sign: neighbours in the text are linked, and so is each token with the next one in the document
that is equal or ends with the same seven digits, and with the first such one under a pattern match, however far away.
Loopy message passing brings the labels of linked tokens together, so that one clear mention settles the unclear ones. It
ends when no message changes any more; its bound grows with the number of mentions of one value. Tokens within pattern
matches keep the label found there; other tokens become spans if one kind has nearly all of the probability.

Weights are fitted by pseudo-likelihood to the pattern matches in a bounded sample of documents. A number that no pattern
matches counts as none there, so the links could not be learnt from it: half of the matches are repeated further on
in a form that no pattern knows (bare digits, or without the plus sign), with the label of the clear mention, and as many
unmatched numbers with none. Only the link tells the two apart.

Cases: a NULL or empty text has no spans; without any sample the features weigh nothing and nothing is added; rows are
independent, so repeated rows get equal results, and ids and other columns play no part.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from augury.llm.common import hashed_sample, slices, small_batches, starts_of

KINDS = ["email", "ip", "card", "phone"]
UNIT = 1_000_000
SAMPLE_DOCUMENTS = 1500  # bound of the rows the weights are fitted to
SAMPLE_CHARS = 50_000  # longer documents are not fitted to; all are searched
CELLS = 4096  # of hashed features
FEATURES = 8  # of each token
SURE = 0.9
ALIKE = 2.0  # prior mean of the log potential for equal labels on alike tokens; data move it where they have such tokens
ENDING = 7  # digits at the end that make two numbers alike
TOLERANCE = 1e-4  # largest change of a message at which message passing ends
SPANS = "array<struct<kind:string,start:long,end:long,base:boolean>>"

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# Cards, phones and IP addresses lie within runs of these characters, each run from its first digit or plus sign.
_NUMERIC = re.compile(r"\+?[0-9][0-9\x20().-]{5,}")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_DIGITS = re.compile(r"[0-9]+")
_LETTERS = re.compile(r"[^\W\d_]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of all pattern matches, by kind and start."""
    found = []
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            end = m.end()
            found.append((0, start, end))
            at = text.find("@", end)
        else:
            at = text.find("@", at + 1)
    ips, cards, phones = [], [], []
    for run in _NUMERIC.finditer(text):
        a, part = run.start(), run.group()
        if part.count(".") >= 3:
            for m in _IP.finditer(part):
                if all(len(x := p.lstrip("0")) < 4 and int(x or 0) <= 255 for p in m.group().split(".")):
                    ips.append((1, a + m.start(), a + m.end()))
        if len(part) >= 13:
            for m in _CARD.finditer(part):
                if m.end() - m.start() >= 13 and 13 <= len(d := _NOT_DIGIT.sub("", m.group())) <= 19 and luhn(d):
                    cards.append((2, a + m.start(), a + m.end()))
        if part[0] == "+" and (m := _PHONE.match(part)) and 9 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
            phones.append((3, a + m.start(), a + m.end()))
    return found + ips + cards + phones


def tokens_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text number, start, end and running number of each token with a digit or an at sign."""
    joined = " ".join(texts) + " "
    cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    white = (cp == 32) | ((cp >= 9) & (cp <= 13))
    edge = np.diff(np.r_[True, white].astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    marks = starts_of(((cp >= 48) & (cp <= 57)) | (cp == 64))
    number = np.flatnonzero(marks[end] > marks[start])
    at = starts_of(np.array([len(t) + 1 for t in texts]))
    text = np.searchsorted(at, start[number], side="right") - 1
    return text, start[number] - at[text], end[number] - at[text], number


def shape(token: str) -> str:
    return _DIGITS.sub(lambda m: f"<{min(len(m.group()), 20)}>", _LETTERS.sub("a", token))


def features(tokens: list[str], near: list[bool]) -> list[list[int]]:
    """Cells of the features of each token: its form, its digits and the forms beside it. near[k]: next to token k - 1."""
    forms = [shape(t)[:40] for t in tokens]
    out = []
    for k, t in enumerate(tokens):
        digits = _NOT_DIGIT.sub("", t) if len(t) < 200 else ""
        names = [
            "bias",
            "f" + forms[k],
            f"n{min(len(digits), 20)}",
            f"c{int(13 <= len(digits) <= 19 and luhn(digits))}{int(len(digits) == len(t))}",
            f"@{t.count('@') == 1}{'.' in t.partition('@')[2]}",
            f".{min(t.count('.'), 4)}{t[0] == '+'}{'(' in t}",
            "p" + (forms[k - 1] if near[k] else "-"),
            "q" + (forms[k + 1] if k + 1 < len(tokens) and near[k + 1] else "-"),
        ]
        out.append([zlib.crc32(x.encode("utf-8", "surrogatepass")) % CELLS for x in names])
    return out


@dataclass
class Graph:
    """The tokens of many texts with their links."""

    text: np.ndarray
    start: np.ndarray
    end: np.ndarray
    cells: np.ndarray  # tokens x features
    fixed: np.ndarray  # 0 none, else 1 + kind of the pattern match over the token
    chain: np.ndarray  # pairs of tokens next to each other
    skip: np.ndarray  # pairs of distant tokens that are alike


def covered(g: Graph, n_texts: int, spans: list[list[tuple[int, int, int]]]) -> np.ndarray:
    """1 + kind of the first span over each token, 0 where there is none."""
    fixed = np.zeros(len(g.text), np.int64)
    at = np.searchsorted(g.text, np.arange(n_texts + 1))
    for k, found in enumerate(spans):
        a, b = at[k], at[k + 1]
        for kind, s, e in found:
            i, j = a + np.searchsorted(g.end[a:b], s, side="right"), a + np.searchsorted(g.start[a:b], e, side="left")
            fixed[i:j] = np.where(fixed[i:j] == 0, kind + 1, fixed[i:j])
    return fixed


def graph_of(texts: list[str], spans: list[list[tuple[int, int, int]]]) -> Graph:
    text, start, end, number = tokens_of(texts)
    words = [texts[t][a:b] for t, a, b in zip(text.tolist(), start.tolist(), end.tolist())]
    near = np.r_[False, (np.diff(number) == 1) & (np.diff(text) == 0)] if len(text) else np.zeros(0, bool)
    cells = np.array(features(words, near.tolist()), np.int64).reshape(len(words), FEATURES)
    bare = Graph(text, start, end, cells, np.zeros(len(words), np.int64), np.zeros((0, 2), np.int64), np.zeros((0, 2), np.int64))
    fixed, at = covered(bare, len(texts), spans), np.searchsorted(text, np.arange(len(texts) + 1))
    chain = np.flatnonzero(near)
    value = [value_of(w) for w in words]
    for k, found in enumerate(spans):  # the last token of a match stands for the whole number
        for _, s, e in found:
            i = at[k] + np.searchsorted(start[at[k] : at[k + 1]], e, side="left") - 1
            value[i] = value_of(texts[k][s:e])
    keys = list(zip(text.tolist(), value))
    clear: dict[tuple[int, str], int] = {}
    for k in np.flatnonzero(fixed).tolist():
        clear.setdefault(keys[k], k)
    last: dict[tuple[int, str], int] = {}
    skip = set()
    for k, key in enumerate(keys):
        if key[1]:
            for j in (last.get(key, k), clear.get(key, k)):
                if j != k and not (abs(j - k) == 1 and near[max(j, k)]):
                    skip.add((min(j, k), max(j, k)))
            last[key] = k
    return Graph(text, start, end, cells, fixed, np.column_stack([chain - 1, chain]), np.array(sorted(skip), np.int64).reshape(-1, 2))


def value_of(token: str) -> str:
    """What two mentions of one value have in common: the last digits of a long number, else the word itself. A short
    number without any other character says too little: empty."""
    if "@" not in token and len(digits := _NOT_DIGIT.sub("", token)) >= ENDING:
        return digits[-ENDING:]
    word = token.strip("[]<>,;:!?.\"'*#$%&").lower()
    return "" if word.isdigit() else word


@dataclass
class Field:
    """unary: feature cells x labels; chain, skip: symmetric label potentials. Label 0: no personal data."""

    unary: np.ndarray
    chain: np.ndarray
    skip: np.ndarray


def repeated(text: str, spans: list[tuple[int, int, int]]) -> tuple[str, list[tuple[int, int, int]]]:
    """The text with every other value mentioned again at its end, in a form that no pattern matches, and the spans of those
    that are personal data. Equal texts are treated alike."""
    parts, size, hidden = [text], len(text), []

    def mention(form: str, kind: int | None) -> None:
        nonlocal size
        if kind is not None:
            hidden.append((kind, size + 4, size + 4 + len(form)))
        parts.append(f" or {form} and")
        size += len(form) + 8

    for kind, start, end in spans:
        whole = text[start:end]
        turn = zlib.crc32(whole.encode("utf-8", "surrogatepass")) % 4
        form = _NOT_DIGIT.sub("", whole) if turn == 0 else whole.lstrip("+")
        if turn < 2 and "@" not in whole and form and not base_spans(f" or {form} and"):
            mention(form, kind)
    for token in text.split():
        digits = _NOT_DIGIT.sub("", token) if len(token) < 40 else ""
        if len(digits) >= ENDING and "@" not in token and zlib.crc32(digits.encode()) % 2 and not base_spans(token) and not any(digits in _NOT_DIGIT.sub("", text[a:b]) for _, a, b in spans):
            mention(digits, None)
    return "".join(parts), hidden


def fit(texts: list[str], rounds: int = 150, rate: float = 0.3, decay: float = 1e-3, link_decay: float = 1e-5) -> Field:
    """Pseudo-likelihood of the labels: every token given its features and its neighbours' labels."""
    k = len(KINDS) + 1
    field = Field(np.zeros((CELLS, k)), np.zeros((k, k)), ALIKE * np.eye(k))
    spans = [base_spans(t) for t in texts]
    more = [repeated(t, s) for t, s in zip(texts, spans)]
    texts = [t for t, _ in more]
    g = graph_of(texts, spans)
    n = len(g.text)
    if not n:
        return field
    label = np.eye(k)[np.maximum(g.fixed, covered(g, len(texts), [hidden for _, hidden in more]))]
    beside = [np.zeros((n, k)), np.zeros((n, k))]
    for links, sums in zip((g.chain, g.skip), beside):
        np.add.at(sums, links[:, 0], label[links[:, 1]])
        np.add.at(sums, links[:, 1], label[links[:, 0]])
    weights = [field.unary, field.chain, field.skip]
    prior = [w.copy() for w in weights]
    past = [np.full_like(w, 1e-8) for w in weights]
    flat = g.cells.ravel()
    for _ in range(rounds):
        z = field.unary[g.cells].sum(axis=1) + beside[0] @ field.chain + beside[1] @ field.skip
        p = np.exp(z - z.max(axis=1, keepdims=True))
        d = (p / p.sum(axis=1, keepdims=True) - label) / n
        unary = np.column_stack([np.bincount(flat, np.repeat(d[:, j], g.cells.shape[1]), CELLS) for j in range(k)])
        steps = [unary, beside[0].T @ d, beside[1].T @ d]
        for w, step, sq, mean in zip(weights, steps, past, prior):
            step = step + (decay if w is field.unary else link_decay) * (w - mean)
            if w is not field.unary:
                step = (step + step.T) / 2
            sq += step * step
            w -= rate * step / np.sqrt(sq)
    return field


def most_rounds(g: Graph) -> int:
    """A bound for message passing that grows with the longest row of linked tokens."""
    longest = [1]
    for links in (g.chain, g.skip):
        ends = np.zeros(len(g.text), np.int64)
        for a, b in links[np.argsort(links[:, 0], kind="stable")].tolist():
            ends[b] = max(ends[b], ends[a] + 1)
        longest.append(int(ends.max(initial=0)))
    return 50 + 4 * max(longest)


def marginals(field: Field, g: Graph, tolerance: float = TOLERANCE, damp: float = 0.5) -> np.ndarray:
    """Label probabilities of all tokens by loopy message passing; tokens under a pattern match keep its label."""
    n, k = len(g.text), field.unary.shape[1]
    unary = field.unary[g.cells].sum(axis=1) if n else np.zeros((0, k))
    seen = g.fixed > 0
    unary[seen] = -50.0
    unary[seen, g.fixed[seen]] = 50.0
    links = np.concatenate([g.chain, g.skip])
    both = np.concatenate([links, links[:, ::-1]])
    bond = np.concatenate([np.repeat(w[None], len(x), axis=0) for w, x in ((field.chain, g.chain), (field.skip, g.skip))] * 2)
    back = (np.arange(len(both)) + len(links)) % max(1, len(both))
    message = np.zeros((len(both), k))
    for _ in range(most_rounds(g) if len(both) else 0):
        belief = unary.copy()
        np.add.at(belief, both[:, 1], message)
        out = (belief[both[:, 0]] - message[back])[:, :, None] + bond
        top = out.max(axis=1)
        out = top + np.log(np.exp(out - top[:, None, :]).sum(axis=1))
        step = (1 - damp) * (out - out.max(axis=1, keepdims=True) - message)
        message = message + step
        if np.abs(step).max() < tolerance:
            break
    np.add.at(unary, both[:, 1], message)
    p = np.exp(unary - unary.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def added_spans(field: Field, texts: list[str], spans: list[list[tuple[int, int, int]]]) -> list[list[tuple[int, int, int]]]:
    """Spans of the tokens that the field labels and no pattern covers; labelled neighbours make one span."""
    g = graph_of(texts, spans)
    p = marginals(field, g)
    label = np.where((p.max(axis=1) >= SURE) & (g.fixed == 0), p.argmax(axis=1), 0) if len(p) else np.zeros(0, np.int64)
    near = set(g.chain[:, 1].tolist())
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    chosen = np.flatnonzero(label).tolist()
    before = -2
    for i in chosen:
        t, kind, a, b = int(g.text[i]), int(label[i]) - 1, int(g.start[i]), int(g.end[i])
        word = texts[t][a:b]
        inner = "" if "(" in word and ")" in word else "()"
        a += len(word) - len(word.lstrip("[<\"'" + inner))
        b -= len(word) - len(word.rstrip("]>\"',;:!?.*#$%&" + inner))
        if b <= a:
            continue
        if before == i - 1 and i in near and label[before] == label[i] and KINDS[kind] == "phone":
            out[t][-1] = (kind, out[t][-1][1], b)
        else:
            out[t].append((kind, a, b))
        before = i
    return out


def find(texts: list[str], field: Field) -> list[list[tuple[int, int, int, bool]]]:
    """(kind, start, end, by pattern) of every text, by kind and start."""
    base = [base_spans(t) for t in texts]
    more = added_spans(field, texts, base)
    return [sorted([*((*s, True) for s in b), *((*s, False) for s in m)]) for b, m in zip(base, more)]


def learn(docs: DataFrame, text: str = "text", id: str = "doc_id", documents: int = SAMPLE_DOCUMENTS, most_chars: int = SAMPLE_CHARS) -> Field:
    """Fit to about ``documents`` texts that have numbers or at signs, twice that at most, chosen by hash."""
    t = F.col(text).cast("string")
    rows = docs.where(t.rlike("@|[0-9]{3}") & (F.length(t) <= most_chars)).select(t.alias("text"), F.col(id).alias("id"))
    return fit(sorted(r[0] for r in hashed_sample(rows, documents, "id", "text").select("text").collect()))


def tag(docs: DataFrame, field: Field, text: str = "text", keep: tuple[str | Column, ...] = ("doc_id",), masked: bool = False) -> DataFrame:
    """``keep`` columns and ``spans`` (0-based code points, end exclusive); ``masked`` adds the text with each span replaced."""
    small_batches(docs)
    schema = docs.select(*keep).select("*", F.lit(None).cast(SPANS).alias("spans")).schema
    if masked:
        schema = schema.add("masked", "string")

    def work(batches):
        for batch in slices(batches, "__text", UNIT):
            given = batch.column("__text").to_pylist()
            texts = [t or "" for t in given]
            found = find(texts, field)
            cells = [[{"kind": KINDS[k], "start": a, "end": b, "base": base} for k, a, b, base in x] for x in found]
            columns = [*batch.columns[:-1], pa.array(cells, schema_type)]
            if masked:
                columns.append(pa.array([None if g is None else mask(t, x) for g, t, x in zip(given, texts, found)], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    schema_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))
    return docs.select(*keep, docs[text].cast("string").alias("__text")).mapInArrow(work, schema)


def mask(text: str, spans: list[tuple[int, int, int, bool]]) -> str:
    """Each span becomes its kind in brackets; overlapping spans become one, named after the first."""
    out, at = [], 0
    for start, end, kind in sorted((a, -b, k) for k, a, b, _ in spans):
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = max(at, -end)
    return "".join([*out, text[at:]])


def joined(spans: str, only_base: bool) -> Column:
    """kind:start:end, comma-joined."""
    rows = F.filter(spans, lambda s: s["base"]) if only_base else F.col(spans)
    return F.concat_ws(",", F.transform(rows, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
