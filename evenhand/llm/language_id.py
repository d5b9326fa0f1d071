"""Language identification with interpolated Kneser-Ney character models, one for each language.

A text is lower-cased and cut into runs of letters; each run is a sequence of characters between a start and an end mark. A
model gives each character (and the end mark) its probability after up to ``ORDER - 1`` characters of the run:

    p(c | h) = max(n(hc) - D, 0) / n(h) + D * types(h) / n(h) * p(c | h without its first character)

with occurrences for n at the highest order, at lower ones the number of different characters before hc (occurrences where the start mark leaves
none), D from the numbers of n-grams seen once and twice, and a uniform distribution below. A text's language is the one with the least cross-entropy
per character. Words repeat, so their scores are kept for a task, up to a bound.

n-grams and contexts of a language are looked up by hash in its sorted arrays. They are fitted on a bounded sample of labelled documents: about
``TRAIN_DOCS`` of each language, those with the least hash of id and text, however many languages there are. Spark takes the counts, and fits a
language in a task of its own from its ``GRAMS`` most frequent n-grams (fewer where ``ALL_GRAMS`` would be passed by all languages together; of equally
frequent ones those with the least hash). So what the driver collects and broadcasts is bounded: some 700 MB for any number of languages.

A text is rejected if it has no letter or is unlike all languages. For that each run of letters counts by the language that it surprises
least, so that a text with parts in several known languages stays. The limit of this cross-entropy per character is calibrated on a part of
the sample that is not learned from: ``SIGMAS`` standard deviations (of documents, and of characters over the text's length) above the mean
of the text's language. It does not depend on how many characters the sample has. A language of fewer than ``FEW`` documents gives none to
calibration, and the document with the least hash is always learned from, so that no language is lost.

The score is the language's share of a softmax of the cross-entropies. Its sharpness is fitted on the same part of the sample: the least of ``GRID``
at which the mean share is no less than the (smoothed) share of right answers. It compares known languages; whether a text is in one of them is
what ``rejected`` says.

Defined cases: a null text, or one without a letter, is ``und`` with score 0 and rejected; without labelled documents all are
``und``; ties go to the language that is first in code point order; rows that repeat id and text are sampled once; input columns are kept, added
ones replace those of their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from evenhand.llm.catalog import register
from evenhand.llm.common import mix, read, slices, written
from evenhand.llm.rows import replace_columns, schema_with
from evenhand.operators.sizes import small_side

ORDER = 5
TRAIN_DOCS = 2000
GRAMS = 200_000
ALL_GRAMS = 12_000_000
SIGMAS = 6.0
# One in so many documents of the sample calibrates and is not learned from.
CALIBRATES = 5
FEW = 10
# Characters that the score's softmax takes a text to have, whatever its length: what is tried, and what is taken without calibration.
GRID = np.geomspace(0.25, 1024.0, 25)
SHARPNESS = 10.0
UNKNOWN = "und"
START, END = "\x02", "\x03"
LETTERS = re.compile(r"[^\W\d_]+")
CACHED_NUMBERS = 1_000_000
STEP = 1 << 20

_FACTORS = mix(np.arange(1, ORDER + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def _hashes(codes: np.ndarray) -> list[np.ndarray]:
    """For each length from 1 to ORDER, the hash of the characters that end at each place (wrong where there are fewer)."""
    scrambled = mix(codes.astype(np.uint64) + np.uint64(1))
    out, total = [], np.zeros(len(codes), np.uint64)
    for back in range(ORDER):
        shifted = np.zeros(len(codes), np.uint64)
        shifted[back:] = scrambled[: max(len(codes) - back, 0)]
        total = total + shifted * _FACTORS[back]
        out.append(mix(total + np.uint64(back)))
    return out


# For each length the hashes of n-grams, their probabilities, the hashes of contexts, and the weights of their shorter histories.
Tables = list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


def tables(texts: list[str], n: np.ndarray, uniform: float) -> Tables:
    """The model of a language from its n-grams: for each predicted character the run up to it, ORDER characters at most, and how often."""
    ends = np.cumsum([len(t) for t in texts])
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    length = np.diff(ends, prepend=0)
    suffix = [h[ends - 1] for h in _hashes(codes)]  # hash of the last 1, 2, ... characters of each row
    before = np.zeros(len(codes), np.uint32)
    before[1:] = codes[:-1]
    history = [h[ends - 1] for h in _hashes(before)]  # the same one character earlier
    out: Tables = []
    lower_grams, lower = np.zeros(0, np.uint64), np.zeros(0)
    for size in range(1, ORDER + 1):
        # Rows of this length have their occurrences; what is longer counts once for each character before it.
        longer, exact = np.flatnonzero(length > size), np.flatnonzero(length == size)
        one = np.unique(suffix[size][longer], return_index=True)[1] if size < ORDER else np.zeros(0, np.int64)
        rows = np.concatenate([exact, longer[one]])
        value = np.concatenate([n[exact].astype(np.float64), np.ones(len(one))])
        none = np.zeros(len(rows), np.uint64)
        grams, at = np.unique(suffix[size - 1][rows], return_inverse=True)
        contexts, of_row = np.unique(history[size - 2][rows] if size > 1 else none, return_inverse=True)
        of_gram, without_first = np.zeros(len(grams), np.int64), np.zeros(len(grams), np.uint64)
        of_gram[at], without_first[at] = of_row, suffix[size - 2][rows] if size > 1 else none
        count = np.bincount(at, value, len(grams))
        total, types = np.bincount(of_gram, count, len(contexts)), np.bincount(of_gram, minlength=len(contexts))
        once, twice = int((count == 1).sum()), int((count == 2).sum())
        discount = once / (once + 2 * twice) if once else 0.5
        weight = discount * types / np.maximum(total, 1)
        # The end of every n-gram that was seen was seen itself, so its probability is in the table before.
        below = lower[np.searchsorted(lower_grams, without_first)] if size > 1 else uniform
        share = np.maximum(count - discount, 0) / np.maximum(total, 1)[of_gram] + weight[of_gram] * below
        out.append((grams, share.astype(np.float32), contexts, weight.astype(np.float32)))
        lower_grams, lower = grams, share
    return out


def _probabilities(fitted: Tables, hashes: list[np.ndarray], histories: list[np.ndarray], deep: np.ndarray, uniform: float) -> np.ndarray:
    """What a language gives each character, from the hashes of all lengths up to it and up to the one before, and the number of characters before."""
    p = np.empty(len(deep))
    # Most n-grams of full length are known; for the others the weight of the shorter history comes in, and so on.
    left, weight = np.arange(len(deep)), np.ones(len(deep))
    for size in range(ORDER, 0, -1):
        grams, shares, contexts, weights = fitted[size - 1]
        fits = deep[left] >= size - 1
        rows, place = _known(grams, hashes[size - 1][left], fits)
        p[left[rows]] = weight[left[rows]] * shares[place]
        rest = np.ones(len(left), bool)
        rest[rows] = False
        left, fits = left[rest], fits[rest]
        rows, place = _known(contexts, histories[size - 2][left] if size > 1 else np.zeros(len(left), np.uint64), fits)
        weight[left[rows]] *= weights[place]
    p[left] = weight[left] * uniform
    return p


@dataclass
class Model:
    """The languages' models, and what calibration found."""

    languages: list[str]
    uniform: float
    fitted: list[Tables]
    mean: np.ndarray | None = None
    deviation: np.ndarray | None = None
    sharpness: float = SHARPNESS

    def surprise(self, runs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """For each run of letters the negative log-probability in every language, and the number of characters predicted."""
        out = np.zeros((len(runs), len(self.languages)))
        sizes = np.array([len(r) + 1 for r in runs], np.int64)
        low = 0
        while low < len(runs):
            high = max(low + 1, int(np.searchsorted(np.cumsum(sizes[low:]), STEP)) + low)
            self._add_surprise(runs[low:high], sizes[low:high], out[low:high])
            low = high
        return out, sizes

    def _add_surprise(self, runs: list[str], sizes: np.ndarray, out: np.ndarray) -> None:
        codes = np.frombuffer((START + (END + START).join(runs) + END).encode("utf-32-le"), np.uint32)
        begins = np.cumsum(sizes + 1) - sizes - 1
        run = np.repeat(np.arange(len(runs)), sizes + 1)
        depth = np.arange(len(codes)) - begins[run]  # characters before, the start mark included
        for low in range(0, len(codes), STEP):
            near = max(0, low - ORDER)
            part = slice(low, min(len(codes), low + STEP))
            at = np.flatnonzero(depth[part] > 0)
            hashes = [h[low - near :][at] for h in _hashes(codes[near : part.stop])]
            earlier = np.concatenate([[0], codes[near : part.stop - 1]]).astype(np.uint32) if near == 0 else codes[near - 1 : part.stop - 1]
            histories = [h[low - near :][at] for h in _hashes(earlier)]
            deep, of_run = depth[part][at], run[part][at]
            for i, fitted in enumerate(self.fitted):
                p = _probabilities(fitted, hashes, histories, deep, self.uniform)
                out[:, i] += np.bincount(of_run, -np.log(p), len(runs))


def _known(table: np.ndarray, keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the wanted keys are in the table, and where."""
    rows = np.flatnonzero(wanted)
    if not len(table):
        return rows[:0], rows[:0]
    at = np.minimum(np.searchsorted(table, keys[rows]), len(table) - 1)
    found = table[at] == keys[rows]
    return rows[found], at[found]


class _Places(dict):
    """Numbers words in the order in which they are first asked for."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


class Scorer:
    """Scores texts with one model, and remembers the scores of words."""

    def __init__(self, model: Model):
        self.model = model
        self.bound = max(1000, CACHED_NUMBERS // (len(model.languages) + 2))
        self.forget()

    def forget(self) -> None:
        """Drop what is remembered of words; done at the end of a task, since a waiting worker should hold little."""
        self.place = _Places()
        self.table = np.zeros((0, len(self.model.languages) + 2))

    def score(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each text its cross-entropy in every language, that of its runs in the language nearest to each, and the number of characters."""
        if len(self.place) > self.bound:
            self.forget()
        place, known = self.place, len(self.place)
        found = [np.fromiter(map(place.__getitem__, words), np.int64, len(words)) for words in ((t or "").lower().split() for t in texts)]
        if len(place) > known:
            runs = [LETTERS.findall(w) for w in islice(place, known, None)]
            surprise, sizes = self.model.surprise(list(chain.from_iterable(runs)))
            added = np.zeros((len(runs), self.table.shape[1]))
            np.add.at(added, np.repeat(np.arange(len(runs)), [len(r) for r in runs]), np.column_stack([surprise, surprise.min(axis=1), sizes]))
            self.table = np.vstack([self.table, added])
        totals = np.zeros((len(texts), self.table.shape[1]))
        for i, at in enumerate(found):
            for low in range(0, len(at), STEP):
                totals[i] += self.table[at[low : low + STEP]].sum(axis=0)
        n = totals[:, -1]
        mean = totals[:, :-1] / np.maximum(n, 1)[:, None]
        return mean[:, :-1], mean[:, -1], n


_SCORERS: dict[int, Scorer] = {}


def _scorer(shipped) -> Scorer:
    if shipped.id not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[shipped.id] = Scorer(shipped.value)
    return _SCORERS[shipped.id]


class _Shipped:
    """A broadcast model under a number that workers keep its scorer by."""

    def __init__(self, broadcast):
        self.broadcast, self.id = broadcast, f"{broadcast._jbroadcast.id() if broadcast._jbroadcast else id(broadcast)}"

    @property
    def value(self) -> Model:
        return self.broadcast.value

    def __getstate__(self) -> dict:
        return {"broadcast": self.broadcast, "id": self.id}


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, text) to (lang, run of letters, n), combined within a step."""
    for batch in slices(batches, "text"):
        found: dict[str, Counter] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            found.setdefault(lang, Counter()).update(LETTERS.findall(text.lower()))
        rows = [(lang, run, n) for lang, runs in found.items() for run, n in runs.items()]
        columns = [pa.array(x, t) for x, t in zip(zip(*rows), (pa.string(), pa.string(), pa.int64()))] if rows else [pa.array([], t) for t in (pa.string(), pa.string(), pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["lang", "run", "n"])


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, run, n) to (lang, gram, n), combined within a batch."""
    for batch in batches:
        found: dict[tuple[str, str], int] = {}
        for lang, run, n in zip(*(c.to_pylist() for c in batch.columns)):
            marked = f"{START}{run}{END}"
            for end in range(2, len(marked) + 1):
                key = (lang, marked[max(0, end - ORDER) : end])
                found[key] = found.get(key, 0) + n
        langs, grams = zip(*found) if found else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(grams, pa.string()), pa.array(found.values(), pa.int64())], ["lang", "gram", "n"])


def training_sample(docs: DataFrame, allowed: Column, per_language: int, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """Rows (lang, text, calibrates) of about ``per_language`` labelled documents for each language."""
    labelled = docs.where(allowed & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    draw = F.shiftrightunsigned(F.xxhash64(F.col(id_col), F.col(text_col)), 11)
    labelled = labelled.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), draw.alias("draw"))
    sizes = small_side(labelled.groupBy("lang").agg(F.count("*").alias("n"), F.min("draw").alias("least")))
    first = F.col("draw") == F.col("least")
    drawn = F.col("draw") / F.lit(float(2**53)) < F.lit(float(per_language)) / F.col("n")
    calibrates = (F.col("n") >= FEW) & ~first & (F.pmod("draw", F.lit(CALIBRATES)) == 0)
    found = labelled.join(sizes, "lang").where(first | drawn).select("lang", "text", "draw", calibrates.alias("calibrates"))
    return found.dropDuplicates(["lang", "draw"]).drop("draw")


def _most_frequent(counts: DataFrame, limit: int) -> DataFrame:
    """Of the rows (lang, gram, n) about the ``limit`` most frequent of each language; of the last number that fits in part, those with the least hash."""
    levels = counts.groupBy("lang", "n").agg(F.count("*").alias("rows"))
    above = Window.partitionBy("lang").orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)
    room = F.lit(limit) - F.coalesce(F.sum("rows").over(above), F.lit(0))
    shares = levels.select("lang", "n", (room / F.col("rows")).alias("share")).where("share > 0")
    place = F.shiftrightunsigned(F.xxhash64("gram"), 11) / F.lit(float(2**53))
    return counts.join(shares, ["lang", "n"]).where(place < F.col("share")).select("lang", "gram", "n")


FITTED = "lang string, size int, grams binary, shares binary, contexts binary, weights binary"


def _fit_language(uniform: float):
    """The n-grams of a language to its arrays, a row for each length."""

    def run(table: pa.Table) -> pa.Table:
        # A fixed order, so that reruns add up alike.
        table = table.sort_by("gram")
        found = tables(table["gram"].to_pylist(), table["n"].to_numpy(), uniform)
        arrays = [pa.array([x.tobytes() for x in column], pa.binary()) for column in zip(*found)]
        lang = pa.array([table["lang"][0].as_py()] * ORDER, pa.string())
        return pa.Table.from_arrays([lang, pa.array(range(1, ORDER + 1), pa.int32()), *arrays], ["lang", "size", "grams", "shares", "contexts", "weights"])

    return run


def fit(sample: DataFrame, grams: int = GRAMS, all_grams: int = ALL_GRAMS) -> Model | None:
    """The models of a bounded sample (lang, text, calibrates), calibrated on the rows set apart; None without a letter in the others."""
    learned, apart = sample.where("not calibrates").drop("calibrates"), sample.where("calibrates").drop("calibrates")
    runs = learned.mapInArrow(_count_words, "lang string, run string, n long").groupBy("lang", "run").agg(F.sum("n").alias("n"))
    counts = written(runs.mapInArrow(_count_grams, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    # Every character is the last one of an n-gram, but for the start mark.
    size = counts.agg(F.count_distinct(F.right("gram", F.lit(1))).alias("characters"), F.count_distinct("lang").alias("languages")).first()
    if not size.languages:
        return None
    uniform = 1.0 / (size.characters + 2)
    most = _most_frequent(counts, max(1, min(grams, all_grams // size.languages)))
    rows = most.groupBy("lang").applyInArrow(_fit_language(uniform), FITTED).collect()
    found: dict[str, dict[int, tuple]] = {}
    for r in rows:
        arrays = [np.frombuffer(x, t) for x, t in ((r.grams, np.uint64), (r.shares, np.float32), (r.contexts, np.uint64), (r.weights, np.float32))]
        found.setdefault(r.lang, {})[r["size"]] = tuple(arrays)
    languages = sorted(found)
    model = Model(languages, uniform, [[found[x][k] for k in range(1, ORDER + 1)] for x in languages])
    return _calibrate(model, apart)


def _shares(entropy: np.ndarray, sharpness: float) -> np.ndarray:
    """The share of the least cross-entropy of each row in the softmax."""
    return 1 / np.exp((entropy.min(axis=1, keepdims=True) - entropy) * sharpness).sum(axis=1)


def _calibrate(model: Model, apart: DataFrame) -> Model:
    """Mean and deviation of the cross-entropy for each language, and the sharpness, from rows (lang, text) that were not learned from."""
    shipped = _Shipped(apart.sparkSession.sparkContext.broadcast(model))
    tried = [f"share{i}" for i in range(len(GRID))]

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(shipped)
        index = {x: i for i, x in enumerate(scorer.model.languages)}
        for batch in slices(batches, "text"):
            entropy, nearest, n = scorer.score(batch.column("text").to_pylist())
            lang = np.array([index.get(x, -1) for x in batch.column("lang").to_pylist()])
            rows = np.flatnonzero((n > 0) & (lang >= 0))
            right = (entropy.argmin(axis=1) == lang)[rows].astype(float)
            columns = [pa.array(lang[rows], pa.int32()), pa.array(nearest[rows]), pa.array(right), *[pa.array(_shares(entropy[rows], g)) for g in GRID]]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "entropy", "right", *tried])
        scorer.forget()

    scored = apart.mapInArrow(own, ", ".join(["lang int", *[f"{c} double" for c in ("entropy", "right", *tried)]])).groupBy("lang")
    sums = [F.sum(c).alias(c) for c in ("right", *tried)]
    stats = scored.agg(F.count("*").alias("n"), F.avg("entropy").alias("mean"), F.stddev("entropy").alias("sd"), *sums).toPandas().set_index("lang").sort_index()
    highest = -float(np.log(model.uniform))
    mean, sd, n = stats["mean"].dropna(), stats["sd"].dropna(), int(stats["n"].sum())
    # A language without enough rows set apart is judged as mildly as the hardest one.
    model.mean = np.array([mean.get(i, mean.max() if len(mean) else highest) for i in range(len(model.languages))])
    model.deviation = np.array([sd.get(i, sd.max() if len(sd) else highest) for i in range(len(model.languages))])
    if n:
        enough = stats[tried].sum().to_numpy() / n >= (stats["right"].sum() + 1) / (n + 2)
        model.sharpness = float(GRID[enough.argmax()] if enough.any() else GRID[-1])
    return model


def identify(docs: DataFrame, model: Model | None, sigmas: float = SIGMAS, text_col: str = "text") -> DataFrame:
    """The rows with ``lang_pred``, ``score`` (share of the softmax of cross-entropies) and ``rejected``."""
    added = "lang_pred string, score double, rejected boolean"
    if model is None:
        kept = [F.col(f"`{c}`") for c in docs.columns if c not in ("lang_pred", "score", "rejected")]
        return docs.select(*kept, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected"))
    shipped = _Shipped(docs.sparkSession.sparkContext.broadcast(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(shipped)
        names = np.array([*scorer.model.languages, UNKNOWN], object)
        for batch in slices(batches, text_col):
            entropy, nearest, n = scorer.score(batch.column(text_col).to_pylist())
            best = entropy.argmin(axis=1)
            fitted = scorer.model
            share = _shares(entropy, fitted.sharpness)
            usual = fitted.mean[best] + sigmas * np.sqrt(fitted.deviation[best] ** 2 + fitted.mean[best] ** 2 / np.maximum(n, 1))
            rejected = (n == 0) | (nearest > usual)
            best = np.where(n > 0, best, len(names) - 1)
            columns = {"lang_pred": pa.array(names[best], pa.string()), "score": pa.array(np.where(n > 0, share, 0.0)), "rejected": pa.array(rejected)}
            yield replace_columns(batch, columns)
        scorer.forget()

    return docs.mapInArrow(run, schema_with(docs.schema, added))


def remainder(doc_id: Column) -> Column:
    """The remainder that tells held-out documents (2) from those to learn from; a null id counts as learnable."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4, F.lit(0))


@register("op5_kneser_ney")
def kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = fit(training_sample(docs, remainder(F.col("doc_id")) != 2, TRAIN_DOCS, "doc_id", "text", "lang"))
    found = identify(docs.select("doc_id", (remainder(F.col("doc_id")) == 2).alias("held_out"), "text"), model)
    return found.select("doc_id", "held_out", "lang_pred", "score", "rejected")
