"""Small helpers the corpus operators share."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

WORD = r"[^\x20\x09-\x0D]+"
LETTER, NUMBER, SPACE = 1, 2, 3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(id_column: str | Column, n: int) -> Column:
    """crc32 of the id as text, mod n; NULL ids have no remainder."""
    return F.crc32(F.encode(F.col(id_column).cast("string") if isinstance(id_column, str) else id_column, "UTF-8")) % n


def in_fold(id_column: str | Column, n: int, k: int) -> Column:
    """True where the remainder is k; False for NULL ids."""
    return F.coalesce(fold(id_column, n) == k, F.lit(False))


def text_or_empty(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def small_batches(df: DataFrame) -> None:
    """Arrow batches of at most 1,000 rows in this session: whole texts are handed to Python, two tasks to an executor."""
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > 1000:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def hashed_sample(df: DataFrame, n: int, *key: str) -> DataFrame:
    """About ``n`` rows, twice that at most, chosen by a hash of ``key``: the same ones in every run.

    The count comes first, so that no task sends more than its part of the sample to the driver.
    """
    share = min(1.0, n / max(1, df.count()))
    space = 1 << 62
    return df.where(F.pmod(F.xxhash64(*key), F.lit(space)) < F.lit(min(space - 1, int(share * space)))).limit(2 * n) if share < 1 else df


def slices(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most_bytes`` of text at most; one longer text makes a batch of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + most_bytes, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


@cache
def char_classes() -> np.ndarray:
    """Per code point: LETTER, NUMBER, SPACE or 0 for the rest, by Unicode property."""
    import regex

    every = "".join(map(chr, range(0x110000)))
    out = np.zeros(len(every), np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
        for m in regex.finditer(pattern, every):
            out[m.start() : m.end()] = kind
    return out


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def starts_of(lengths: np.ndarray) -> np.ndarray:
    """Offsets of consecutive pieces, the total last."""
    out = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All positions of the pieces [start, start + length), piece after piece."""
    total = int(lengths.sum())
    at = starts_of(lengths)
    return np.arange(total, dtype=np.int64) - np.repeat(at[:-1] - starts, lengths)
