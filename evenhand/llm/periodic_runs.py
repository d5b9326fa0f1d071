"""Periodic runs of words by block convolution.

A run is a stretch of consecutive words with smallest period q (words q apart are equal), at least ``least`` words and ``times`` periods long,
that neither neighbouring word extends. All documents of a step stand one behind the other, each followed by a mark that occurs nowhere else, so no
run leaves its document.

1. Blocks. At the dyadic scales L = 8, 16, 32, ... the words are cut into blocks of L. A run of period q in [L, 2L) (below 16 for the first scale) has more
   than 2L - 2 words ahead of its last period, so it holds a whole block and that block's next occurrence, q words on.
2. Convolution. The sum of squared differences of word numbers between a block and every place of the window that follows it (distances L to 2L - 1) is
   (sum of squares of the block) + (of the place) - 2 * (their product sum); the product sums of all places come from one number-theoretic
   transform, modulo as many primes as the largest possible sum takes. The sum is zero where the block occurs, and only there. Blocks of more than
   ``BLOCK`` words are looked up by their first ``BLOCK`` words, window by window, so a transform's size does not grow with the text.
3. Pruning, exactly: a block can only occur within reach if each of its words does, so a block with a word whose next occurrence is further away is left out; so is
   a block whose window lies within a known run (it would find multiples of the known period).
4. Extension. Each occurrence and its distance seed a stretch, which grows to both sides by a binary search over prefix hashes. Neighbouring blocks
   with the same distance share a seed. Stretches that are long enough are compared word by word at the end. Of several periods of a stretch the least stays.

Time for a text of n words is that of log n scales of transforms, whatever it holds; memory is a few arrays of n numbers.

Defined cases: null, empty and blank texts have no words, no runs and an empty collapsed text; documents are independent of each other, so
rows that repeat or share an id are judged row by row; a null id changes nothing; input columns are kept, those named like the added ones are
replaced. Words are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from evenhand.llm.catalog import register
from evenhand.llm.common import WORD, read, slices, text_bytes, word_hashes, word_spans
from evenhand.llm.rows import replace_columns, schema_with

LEAST = 24
TIMES = 3
FIRST = 8
# Words of a block that one transform looks for.
BLOCK = 1 << 16
# Numbers that one vectorised transform holds.
STEP = 1 << 17
# Primes p with a primitive root g, whose p - 1 is a multiple of 2^25 at least.
PRIMES = ((2013265921, 31), (469762049, 3), (167772161, 3))
BASES = (1540483477, 374761393)
FAR = np.int64(1) << 62
RUNS = "array<struct<start:long,length:long,period:long>>"


def _powers(base: int, n: int, p: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo p, by doubling."""
    out = np.ones(1, np.uint64)
    while len(out) < n:
        out = np.concatenate([out, out * np.uint64(pow(base, len(out), p)) % np.uint64(p)])
    return out[:n]


def transform(x: np.ndarray, p: int, root: int) -> np.ndarray:
    """The number-theoretic transform of every row (a power of two long); ``root`` is an N-th root of unity modulo p."""
    rows, size = x.shape
    table, q = _powers(root, size // 2, p), np.uint64(p)
    x = x.reshape(rows, size, 1)
    while x.shape[1] > 1:
        half = x.shape[1] // 2
        a, b = x[:, :half], x[:, half:]
        out = np.empty((rows, half, 2, x.shape[2]), np.uint64)
        np.remainder(a + b, q, out=out[:, :, 0])
        np.remainder((a + (q - b)) * table[:: len(table) // half, None], q, out=out[:, :, 1])
        x = out.reshape(rows, half, -1)
    return x.reshape(rows, size)


def _product_sums(block: np.ndarray, window: np.ndarray, p: int, g: int) -> np.ndarray:
    """For every row and place d below the block's length: the sum of block[j] * window[d + j] modulo p."""
    m, size = block.shape[1], window.shape[1]
    turned = np.zeros(window.shape, np.uint64)
    turned[:, 0] = block[:, 0]
    turned[:, size - m + 1 :] = block[:, :0:-1]
    root = pow(g, (p - 1) // size, p)
    both = transform(np.concatenate([window, turned]), p, root)
    back = transform(both[: len(block)] * both[len(block) :] % np.uint64(p), p, pow(root, -1, p))
    return back[:, :m] * np.uint64(pow(size, -1, p)) % np.uint64(p)


def zero_mismatches(codes: np.ndarray, starts: np.ndarray, lag: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the ``m`` codes from each start occur ``lag`` to ``lag + m - 1`` places on: (start, distance).

    The last entry of ``codes`` differs from all others and stands for what is behind the end.
    """
    most = int(codes.max()) ** 2 * m
    found: list[tuple[np.ndarray, np.ndarray]] = []
    each = max(1, STEP // (2 * m))
    for at in range(0, len(starts), each):
        own = starts[at : at + each]
        block = codes[own[:, None] + np.arange(m)]
        window = codes[np.minimum(own[:, None] + lag + np.arange(2 * m), len(codes) - 1)]
        zero, bound = np.ones(block.shape, bool), 1
        for p, g in PRIMES:
            b, w = (x % np.uint64(p) for x in (block, window))
            squares = np.cumsum(w * w % np.uint64(p), axis=1)
            there = squares[:, m - 1 : 2 * m - 1].copy()
            there[:, 1:] -= squares[:, : m - 1]
            here = (b * b % np.uint64(p)).sum(axis=1, dtype=np.uint64)[:, None]
            zero &= (there + here) % np.uint64(p) == 2 * _product_sums(b, w, p, g) % np.uint64(p)
            bound *= p
            if bound > most or not zero.any():
                break
        row, place = np.nonzero(zero)
        found.append((own[row], place + lag))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


class _Equal:
    """Tells equal stretches by prefix hashes modulo two primes."""

    def __init__(self, codes: np.ndarray):
        self.n = len(codes)
        self.tables = []
        for (p, _), base in zip(PRIMES, BASES):
            power = _powers(base, self.n + 1, p)
            sums = np.zeros(self.n + 1, np.uint64)
            np.cumsum((codes + np.uint64(1)) % np.uint64(p) * power[:-1] % np.uint64(p), out=sums[1:])
            self.tables.append((np.uint64(p), power, sums % np.uint64(p)))

    def same(self, at: np.ndarray, d: np.ndarray, n: np.ndarray) -> np.ndarray:
        out = np.ones(len(at), bool)
        for p, power, sums in self.tables:
            left = (sums[at + n] + (p - sums[at])) % p * power[d] % p
            out &= left == (sums[at + d + n] + (p - sums[at + d])) % p
        return out

    def after(self, at: np.ndarray, d: np.ndarray) -> np.ndarray:
        """How many places from ``at`` on equal those d further on."""
        n = np.zeros(len(at), np.int64)
        for bit in reversed(range(self.n.bit_length())):
            more = n + (1 << bit)
            fits = np.flatnonzero(at + d + more <= self.n)
            fits = fits[self.same(at[fits], d[fits], more[fits])]
            n[fits] = more[fits]
        return n

    def before(self, at: np.ndarray, d: np.ndarray) -> np.ndarray:
        """How many places before ``at`` equal those d further on."""
        n = np.zeros(len(at), np.int64)
        for bit in reversed(range(self.n.bit_length())):
            more = n + (1 << bit)
            fits = np.flatnonzero(more <= at)
            fits = fits[self.same(at[fits] - more[fits], d[fits], more[fits])]
            n[fits] = more[fits]
        return n


def _seeds(starts: np.ndarray, distances: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First start, last start and distance of blocks that follow each other at one distance."""
    order = np.lexsort((starts, distances))
    b, d = starts[order], distances[order]
    new = np.ones(len(b), bool)
    new[1:] = (d[1:] != d[:-1]) | (b[1:] != b[:-1] + step)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(b))[: len(first)] - 1
    return b[first], b[last], d[first]


def _least_periods(runs: np.ndarray) -> np.ndarray:
    """Rows (start, end, period), one for each stretch: that of its least period."""
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    first = np.ones(len(runs), bool)
    first[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)
    return runs[first]


def find_runs(codes: np.ndarray, reach: np.ndarray, longest: int, least: int = LEAST, times: int = TIMES) -> np.ndarray:
    """Rows (start, end, period) of all runs in ``codes``, by start and period.

    ``reach`` is the distance of each place to the next one with the same code. ``longest``: no run is longer.
    """
    if least < LEAST or times < TIMES:
        raise ValueError(f"runs are found from {LEAST} words and {TIMES} periods on")
    n = len(codes)
    runs = np.zeros((0, 3), np.int64)
    equal = None
    codes = np.append(codes, codes.max(initial=0) + 1).astype(np.uint64)
    furthest = np.append(reach, np.full(-n % BLOCK, FAR))  # of the words of each block, at the scale at hand
    held, scale = 1, FIRST
    while scale * times <= longest or scale == FIRST:
        m = min(scale, BLOCK)
        while held < m:
            furthest, held = np.maximum(furthest[::2], furthest[1::2]), 2 * held
        starts = np.flatnonzero(furthest[:: scale // m] < 2 * scale) * scale
        open_ = np.ones(len(starts), bool)
        for s, e, _ in runs[(runs[:, 1] - runs[:, 0] >= 3 * scale) & (runs[:, 2] <= m)]:
            a, b = np.searchsorted(starts, (s, e - 3 * scale + 1))
            open_[a:b] = False
        starts = starts[open_]
        lags = range(1, 2 * scale, m) if scale == FIRST else range(scale, 2 * scale, m)
        for lag in lags:
            if not len(starts):
                break
            first, last, d = _seeds(*zero_mismatches(codes, starts, lag, m), scale if m == scale else 0)
            if len(d):
                equal = equal or _Equal(codes[:n])
                s, e = first - equal.before(first, d), last + d + equal.after(last, d)
                long = e - s >= np.maximum(least, times * d)
                runs = _least_periods(np.concatenate([runs, np.stack([s, e, d], axis=1)[long]]))
        scale *= 2
    if not all((codes[s : e - d] == codes[s + d : e]).all() for s, e, d in runs):
        runs = _plain(codes[:n], runs, least, times)
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _plain(codes: np.ndarray, seeds: np.ndarray, least: int, times: int) -> np.ndarray:
    """The runs of the seeds' periods without hashes, for the case that two stretches had equal hashes."""
    found = [np.zeros((0, 3), np.int64)]
    for d in np.unique(seeds[:, 2]):
        ends = np.flatnonzero(np.diff(np.concatenate([[0], (codes[:-d] == codes[d:]).astype(np.int8), [0]])))
        s, e = ends[::2], ends[1::2] + d
        long = e - s >= max(least, times * d)
        found.append(np.stack([s[long], e[long], np.full(long.sum(), d)], axis=1))
    return _least_periods(np.concatenate(found))


class _Texts:
    """The words of a step's documents as numbers, a mark behind each document."""

    def __init__(self, texts: pa.Array):
        self.data, offsets = text_bytes(texts)
        self.begins, self.ends, self.first = word_spans(self.data, offsets)
        rows, n = len(self.first) - 1, len(self.begins)
        hashes = word_hashes(self.data, self.begins, self.ends)
        self.row = np.repeat(np.arange(rows), np.diff(self.first))
        self.place = np.arange(n) + self.row
        order = np.argsort(hashes, kind="stable")
        new = np.ones(n, bool)
        new[1:] = hashes[order[1:]] != hashes[order[:-1]]
        number = np.cumsum(new)
        self.codes = np.empty(n + rows, np.int64)
        self.codes[self.place[order]] = number - 1
        self.codes[self.first[1:] + np.arange(rows)] = np.arange(rows) + (number[-1] if n else 0)
        self.reach = np.full(n + rows, FAR)
        again = np.flatnonzero(~new)
        self.reach[self.place[order[again - 1]]] = self.place[order[again]] - self.place[order[again - 1]]

    def runs(self, least: int, times: int) -> np.ndarray:
        return find_runs(self.codes, self.reach, int(np.diff(self.first).max(initial=0)), least, times)

    def join(self, kept: np.ndarray) -> pa.Array:
        """The kept words of each document joined by one space. kept: a flag for each word."""
        words = np.flatnonzero(kept)
        sizes = self.ends[words] - self.begins[words] + 1  # a space ahead of each word, but the first of a row
        opens = np.ones(len(words), bool)
        opens[1:] = self.row[words[1:]] != self.row[words[:-1]]
        sizes[opens] -= 1
        to = np.concatenate([[0], np.cumsum(sizes)])
        out = np.full(to[-1], 0x20, np.uint8)
        for at in range(0, len(words), STEP):
            own = words[at : at + STEP]
            length = self.ends[own] - self.begins[own]
            total = np.cumsum(length)
            inner = np.arange(total[-1]) - np.repeat(total - length, length)
            out[np.repeat(to[at + 1 : at + 1 + len(own)] - length, length) + inner] = self.data[np.repeat(self.begins[own], length) + inner]
        offsets = to[np.searchsorted(words, self.first)].astype(np.int32)
        return pa.StringArray.from_buffers(len(self.first) - 1, pa.py_buffer(offsets), pa.py_buffer(out))


def _find(text_col: str, least: int, times: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            texts = _Texts(batch.column(text_col))
            found = texts.runs(least, times)
            rows = len(texts.first) - 1
            opens = texts.first[:-1] + np.arange(rows)  # place of each document's first word
            own = np.searchsorted(opens, found[:, 0], side="right") - 1
            inside = np.zeros(len(texts.codes) + 1, np.int64)
            np.add.at(inside, found[:, 0] + found[:, 2], 1)
            np.add.at(inside, found[:, 1], -1)
            kept = np.cumsum(inside)[texts.place] == 0
            fields = [found[:, 0] - opens[own], found[:, 1] - found[:, 0], found[:, 2]]
            entries = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in fields], ["start", "length", "period"])
            offsets = np.searchsorted(own, np.arange(rows + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), entries)
            yield replace_columns(batch, {"runs": lists, "collapsed": texts.join(kept)})

    return run


def periodic_runs(docs: DataFrame, least: int = LEAST, times: int = TIMES, text_col: str = "text") -> DataFrame:
    """The rows with ``runs`` (by start and period; start counts words from 0) and ``collapsed``: the words that no run contains after its first period."""
    return docs.mapInArrow(_find(text_col, least, times), schema_with(docs.schema, f"runs {RUNS}, collapsed string"))


def wrapped(text: Column, start: Column, period: Column) -> Column:
    """The text's words, those from ``start`` on replaced by repetitions of the ``period`` words that begin there."""
    words = F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))
    n = F.size(words)
    copies = F.array_repeat(F.slice(words, start + 1, period), F.ceil((n - start) / period).cast("int"))
    return F.array_join(F.slice(F.concat(F.slice(words, F.lit(1), start), F.flatten(copies)), F.lit(1), n), " ")


def most_repeated(runs: Column) -> Column:
    """The run with the greatest length / period; of equal ones the first. Null without runs."""
    better = lambda best, x: F.when(best.isNull() | (x["length"] * best["period"] > best["length"] * x["period"]), x).otherwise(best)
    return F.reduce(runs, F.lit(None).cast("struct<start:long,length:long,period:long>"), better)


# A word list of each document, the given share of documents made periodic; DuckDB has no crc32, so it is worked out bit by bit.
ORACLE = r"""
WITH crc AS (SELECT doc_id, text, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
    lambda c, b: list_reduce(list_concat([xor(c, b)], CAST(range(8) AS BIGINT[])), lambda r, k: xor(r >> 1, 3988292384 * (r & 1)))), 4294967295::BIGINT) AS h FROM documents),
lists AS (SELECT doc_id, h, h // 10 AS g, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM crc),
cuts AS (SELECT *, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN g % len(w) END AS a FROM lists),
spans AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM cuts),
words AS (SELECT doc_id, i, CASE WHEN i >= a THEN w[a + (i - a) % p + 1] ELSE w[i + 1] END AS word FROM (SELECT *, unnest(range(n)) AS i FROM spans)),
pairs AS (SELECT x.doc_id, x.i, y.i - x.i AS d FROM words x JOIN words y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i),
islands AS (SELECT doc_id, d, min(i) AS s, max(i) + 1 + d AS e FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, d ORDER BY i) AS island FROM pairs) GROUP BY doc_id, d, island),
runs AS (SELECT doc_id, s AS start, e - s AS length, min(d) AS period FROM islands WHERE e - s >= greatest(24, 3 * d) GROUP BY doc_id, s, e),
best AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length / period DESC, start, period) = 1),
digests AS (SELECT doc_id, count(*) AS n_runs, string_agg(concat(start, ',', length, ',', period, chr(10)), '' ORDER BY start, period) AS listed FROM runs GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli, sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM lists LEFT JOIN best USING (doc_id) LEFT JOIN digests USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


@register("op11_periodic_runs", ORACLE)
def run_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of the documents, the tenth of them that ``h % 10 = 0`` picks made periodic from a word on."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", h.alias("h"), g.alias("g"), F.regexp_count("text", F.lit(WORD)).cast("long").alias("n"))
    start = F.col("g") % F.col("n")
    period = 1 + F.floor((F.col("n") - start) / (3 + F.col("g") % 8))
    planted = F.when((F.col("h") % 10 == 0) & (F.col("n") > 0), wrapped(F.col("text"), start.cast("int"), period.cast("int"))).otherwise(F.col("text"))
    found = periodic_runs(docs.select("doc_id", planted.alias("text"))).withColumn("best", most_repeated(F.col("runs")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.encode(F.array_join(lines, ""), "UTF-8"), 256).alias("runs_sha256"), F.sha2(F.encode("collapsed", "UTF-8"), 256).alias("collapsed_sha256"),
    )
