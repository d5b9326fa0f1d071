"""Helpers that several operators share: Arrow slices, word spans, hashing, written tables."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from evenhand.operators.sizes import cut_lineage

# White space between words, as Java and Python patterns.
WORD = r"[^\x20\x09-\x0D]+"
# Text bytes that one vectorised step works on; a longer document makes a step of its own.
SLICE_BYTES = 1 << 20


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder, so that a lost executor costs no recomputation of what is above."""
    return cut_lineage(df)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A given table, for a query; its rows will travel in small batches."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def word_count(text: Column) -> Column:
    """The number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


# Rows of an Arrow batch between Spark and its Python workers. Spark's default of 10,000 holds some 35 MB of documents, on both sides.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """For queries and pipelines: pass documents to Python workers in batches of a few megabytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def give_back() -> None:
    """Return memory that was freed to the system, as far as the C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


_HELD: list[Any] = []


def hold(keeper: Any = None) -> None:
    """Let ``keeper`` remember things from task to task in this worker; what another operator remembered goes (``forget()``)."""
    for other in _HELD:
        if other is not keeper:
            other.forget()
    _HELD[:] = [] if keeper is None else [keeper]


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES, keeper: Any = None) -> Iterator[pa.RecordBatch]:
    """The batches again, cut where ``column`` holds about ``limit`` bytes; a single row may be longer.

    Memory that Arrow keeps for later goes back at the end: a worker that waits for its next task shares its executor with others.
    """
    hold(keeper)
    for batch in batches:
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        total = np.cumsum(sizes)
        start = 0
        while start < batch.num_rows:
            before = total[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(total, before + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
    give_back()


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one byte array, and the offsets of the rows (one more than rows); null counts as empty."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    if texts.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8, int(offsets[-1] - offsets[0]), int(offsets[0]))
    return data, offsets - offsets[0]


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """The bytes with A-Z in lower case."""
    return _LOWER[data]


_NOT_ALPHANUMERIC = np.ones(256, bool)
_NOT_ALPHANUMERIC[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = False


def alphanumeric_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same as ``word_spans`` for runs of ASCII letters and digits."""
    return word_spans(data, offsets, _NOT_ALPHANUMERIC)


def word_spans(data: np.ndarray, offsets: np.ndarray, between: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and for each row the number of words before it (one more than rows)."""
    inner = ~between[data]
    first = np.empty(len(data) + 1, bool)  # a word or a gap begins here, or a row
    first[0] = True
    np.not_equal(inner[1:], inner[:-1], out=first[1:-1])
    first[offsets] = True
    first[-1] = True
    marks = np.flatnonzero(first)
    begins, ends = marks[:-1], marks[1:]
    word = inner[begins] if len(begins) else np.zeros(0, bool)
    begins, ends = begins[word], ends[word]
    return begins, ends, np.searchsorted(begins, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BASE = 0x9E3779B97F4A7C55 | 1
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BLOCK = 1 << 20


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    out[1:] = np.uint64(base % 2**64)
    return np.cumprod(out, dtype=np.uint64)


_POWER: list[np.ndarray] = []


def word_hashes(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every word. Prefix sums of byte codes times powers give it without a loop over words."""
    if not _POWER:
        _POWER.extend((_powers(_BASE, _BLOCK + 1), _powers(pow(_BASE, -1, 2**64), _BLOCK + 1)))
    power, inverse = _POWER
    out = np.empty(len(begins), np.uint64)
    done = 0
    while done < len(begins):
        origin = int(begins[done])
        stop = max(done + 1, int(np.searchsorted(ends, origin + _BLOCK, side="right")))
        if ends[done] - origin > _BLOCK:  # one word longer than a block
            out[done] = _long_word(data[origin : int(ends[done])])
            done += 1
            continue
        span = data[origin : int(ends[stop - 1])]
        sums = np.empty(len(span) + 1, np.uint64)
        sums[0] = 0
        np.cumsum(_BYTE[span] * power[: len(span)], out=sums[1:])
        a, b = begins[done:stop] - origin, ends[done:stop] - origin
        out[done:stop] = (sums[b] - sums[a]) * inverse[a] + (b - a).astype(np.uint64)
        done = stop
    return mix(out)


def _long_word(word: np.ndarray) -> np.uint64:
    power = _POWER[0]
    total, step = 0, 1
    for at in range(0, len(word), _BLOCK):
        part = word[at : at + _BLOCK]
        total = (total + int((_BYTE[part] * power[: len(part)]).sum(dtype=np.uint64)) * step) % 2**64
        step = step * pow(_BASE, _BLOCK, 2**64) % 2**64
    return np.uint64((total + len(word)) % 2**64)


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """A hash for the ``width`` consecutive words that begin at each word (fewer at the end: the result is shorter)."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    factor = np.uint64(0xD6E8FEB86659FD93)
    for j in range(width):
        out *= factor
        out += words[j : j + n]
    return mix(out)
