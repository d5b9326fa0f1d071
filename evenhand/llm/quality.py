"""Quality scores by nearest-neighbour voting in a latent-semantic space.

1. Terms. A text's terms are its words (A-Z lower-cased), the shapes of its words (runs of capitals, other letters and digits become one sign each, runs of
   any other sign one of it), and a term for each word that repeats the one before it. Terms are numbered by hashes in two fixed ranges.
2. Weights: the root of a term's share of the words times the logarithm of its rarity. In how many documents a term occurs is counted over all documents.
   Words and shapes are brought to unit length apart, so that vocabulary and form count alike.
3. Space. The leading right singular vectors of the labelled sample's weights (subspace iteration) span the latent space. The sample
   holds about ``PER_CLASS`` labelled documents of each label, those with the least hashes of their ids; a row of it has at most ``TERMS`` entries, so
   sample, space and labelled vectors have a fixed bound (below 300 MB while fitting, below 10 MB broadcast), however many documents there are.
4. Votes. Every document's vector meets all labelled vectors in blocks: exact cosines, no index. The ``NEIGHBOURS`` nearest vote with their
   similarity as weight; the score is the weighted share of label 1.

Defined cases: texts that are null, blank, or at right angles to all labelled ones get the share of label 1 among all labels that may be learned from;
without labels that is 0.5. A label counts as 1 if it is above 0, rows with a null label or id are not learned from, the least of several labels of an
id counts; documents that share an id are judged row by row. Whole texts count, whatever their length. Input columns are kept, those named like the added
one are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from evenhand.llm.catalog import register
from evenhand.llm.common import lower_ascii, read, slices, text_bytes, word_hashes, word_spans
from evenhand.llm.rows import replace_columns, schema_with

PER_CLASS = 2048
NEIGHBOURS = 15
DIMS = 64
WORDS = 8192
SHAPES = 1024
REPEAT = WORDS + SHAPES
TERMS = REPEAT + 1
ROUNDS = 6
SEED = 11
THRESHOLD = 0.3

# The sign of each byte in a word's shape.
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[ord("A") : ord("Z") + 1] = ord("A")
_SHAPE[ord("a") : ord("z") + 1] = ord("a")
_SHAPE[0x80:] = ord("a")
_SHAPE[ord("0") : ord("9") + 1] = ord("0")


@dataclass
class Terms:
    """Terms of a step's texts, by row and number: how often each occurs; the number of words of each row."""

    row: np.ndarray
    term: np.ndarray
    count: np.ndarray
    words: np.ndarray

    @classmethod
    def of(cls, texts: pa.Array) -> Terms:
        data, offsets = text_bytes(texts)
        begins, ends, first = word_spans(data, offsets)
        hashes = word_hashes(lower_ascii(data), begins, ends)
        row = np.repeat(np.arange(len(first) - 1), np.diff(first))
        signs = _SHAPE[data]
        new = np.ones(len(signs) + 1, bool)
        new[1:-1] = signs[1:] != signs[:-1]
        new[begins] = True
        kept = np.flatnonzero(new[:-1])
        shapes = word_hashes(signs[kept], np.searchsorted(kept, begins), np.searchsorted(kept, ends))
        again = np.flatnonzero((hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])) + 1
        rows = np.concatenate([row, row, row[again]])
        terms = np.concatenate([hashes % np.uint64(WORDS), shapes % np.uint64(SHAPES) + np.uint64(WORDS), np.full(len(again), REPEAT, np.uint64)])
        found, count = np.unique(rows * TERMS + terms.astype(np.int64), return_counts=True)
        return cls(found // TERMS, found % TERMS, count, np.diff(first))

    def weights(self, rarity: np.ndarray) -> np.ndarray:
        """The weight of each entry; those of a row's words, and those of its shapes, have unit length together."""
        w = np.sqrt(self.count / self.words[self.row]) * rarity[self.term]
        part = 2 * self.row + (self.term >= WORDS)
        length = np.sqrt(np.bincount(part, w * w, 2 * len(self.words)))[part]
        return np.divide(w, length, out=np.zeros(len(w)), where=length > 0)


def _times(row: np.ndarray, rows: int, term: np.ndarray, weight: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The sparse matrix (row, term, weight), sorted by row, times ``table``."""
    out = np.zeros((rows, table.shape[1]))
    step = 1 << 15
    for at in range(0, len(row), step):
        own = row[at : at + step]
        first = np.flatnonzero(np.diff(own, prepend=-1))
        out[own[first]] += np.add.reduceat(table[term[at : at + step]] * weight[at : at + step, None], first, axis=0)
    return out


def latent_space(row: np.ndarray, rows: int, term: np.ndarray, weight: np.ndarray, dims: int = DIMS) -> np.ndarray:
    """The leading right singular vectors of the sparse matrix, as columns."""
    basis = np.linalg.qr(np.random.default_rng(SEED).normal(size=(TERMS, dims + 8)))[0]
    by_term = np.argsort(term, kind="stable")
    for _ in range(ROUNDS):
        image = _times(row, rows, term, weight, basis)
        basis = np.linalg.qr(_times(term[by_term], TERMS, row[by_term], weight[by_term], image))[0]
    image = _times(row, rows, term, weight, basis)
    _, vectors = np.linalg.eigh(image.T @ image)
    return basis @ vectors[:, ::-1][:, :dims]


@dataclass
class Model:
    """What voting takes: rarity of terms, the space, the labelled documents' unit vectors, their labels, and the share of label 1."""

    rarity: np.ndarray
    space: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    share: float
    neighbours: int = NEIGHBOURS

    def place(self, terms: Terms) -> np.ndarray:
        """Unit vectors of the rows; 0 where no term reaches the space."""
        return unit(_times(terms.row, len(terms.words), terms.term, terms.weights(self.rarity), self.space))

    def vote(self, terms: Terms) -> np.ndarray:
        out = np.full(len(terms.words), self.share)
        if not len(self.labels):
            return out
        vectors = self.place(terms)
        for at in range(0, len(out), 256):
            near = vectors[at : at + 256] @ self.vectors.T
            k = min(self.neighbours, near.shape[1])
            best = np.argpartition(-near, k - 1, axis=1)[:, :k]
            weight = np.maximum(np.take_along_axis(near, best, axis=1), 0.0)
            total = weight.sum(axis=1)
            voted = np.flatnonzero(total > 0)
            out[at + voted] = (weight * self.labels[best]).sum(axis=1)[voted] / total[voted]
        return np.clip(out, 0.0, 1.0)


def unit(x: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, length, out=np.zeros_like(x), where=length > 1e-9)


def _occurrences(text_col: str):
    """Rows (term, n): in how many documents of the task each term occurs. Term -1 counts the documents with words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(TERMS + 1, np.int64)
        for batch in slices(batches, text_col):
            terms = Terms.of(batch.column(text_col))
            n[:TERMS] += np.bincount(terms.term, minlength=TERMS)
            n[TERMS] += np.count_nonzero(terms.words)
        there = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(np.where(there < TERMS, there, -1), pa.int32()), pa.array(n[there])], ["term", "n"])

    return run


def rarity_of(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """The logarithm of each term's rarity over all documents."""
    counted = docs.select(text_col).mapInArrow(_occurrences(text_col), "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    n = dict(zip(counted["term"], counted["n"]))  # TERMS + 1 rows at most
    seen = np.array([n.get(t, 0) for t in range(TERMS)], float)
    return np.log((n.get(-1, 0) + 1) / (seen + 1)) + 0.01


def labelled_sample(docs: DataFrame, labels: DataFrame, per_class: int, id_col: str, text_col: str) -> tuple[DataFrame, float]:
    """Rows (draw, text, label) of about ``per_class`` documents of each label, and the share of label 1 among all labels.

    labels: (id, label), those that may be learned from. Only ids and labels are counted and drawn; the drawn ids go to the documents as a broadcast.
    """
    known = labels.where(F.col("id").isNotNull() & F.col("label").isNotNull()).groupBy("id").agg(F.min(F.col("label") > 0).alias("label"))
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}  # two rows
    total = sum(counts.values())
    cut = F.when(F.col("label"), per_class / max(counts.get(True, 1), 1)).otherwise(per_class / max(counts.get(False, 1), 1))
    draw = F.xxhash64(F.col("id"))
    drawn = known.where(F.shiftrightunsigned(draw, 11) / F.lit(float(2**53)) < cut).select("id", "label")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(drawn), "id")
    return rows.select(draw.alias("draw"), "text", "label"), counts.get(True, 0) / total if total else 0.5


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (draw, text, label) to (draw, label, words, terms, counts)."""
    for batch in slices(batches, "text"):
        found = Terms.of(batch.column("text"))
        bounds = np.searchsorted(found.row, np.arange(batch.num_rows + 1))
        lists = {n: pa.array([x[a:b].astype(kind).tobytes() for a, b in zip(bounds, bounds[1:])], pa.binary()) for n, x, kind in (("terms", found.term, np.uint16), ("counts", found.count, np.float32))}
        yield pa.RecordBatch.from_arrays([batch.column("draw"), batch.column("label"), pa.array(found.words, pa.int64()), *lists.values()], ["draw", "label", "words", *lists])


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, neighbours: int = NEIGHBOURS, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """The model of ``labels`` (id, label) over ``docs``, whose texts all count for the rarity of terms."""
    rarity = rarity_of(docs, text_col)
    sample, share = labelled_sample(docs, labels, per_class, id_col, text_col)
    drawn = sample.mapInArrow(_entries, "draw long, label boolean, words long, terms binary, counts binary").toPandas()
    drawn = drawn[drawn["words"] > 0].sort_values(["draw", "terms", "counts"], ignore_index=True)
    if drawn.empty:
        return Model(rarity, np.zeros((TERMS, DIMS)), np.zeros((0, DIMS)), np.zeros(0), share, neighbours)
    term = [np.frombuffer(x, np.uint16) for x in drawn["terms"]]
    row = np.repeat(np.arange(len(drawn)), [len(x) for x in term])
    terms = Terms(row, np.concatenate(term).astype(np.int64), np.concatenate([np.frombuffer(x, np.float32) for x in drawn["counts"]]).astype(float), drawn["words"].to_numpy())
    space = latent_space(row, len(drawn), terms.term, terms.weights(rarity))
    model = Model(rarity, space, np.zeros((0, DIMS)), drawn["label"].to_numpy().astype(float), share, neighbours)
    model.vectors = model.place(terms)
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows with ``score``: how likely label 1 is."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            yield replace_columns(batch, {"score": pa.array(shipped.value.vote(Terms.of(batch.column(text_col))))})

    return docs.mapInArrow(run, schema_with(docs.schema, "score double"))


def remainder(doc_id: Column) -> Column:
    """The remainder that tells held-out documents (0) from those to learn from; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


@register("op13_latent_quality")
def latent_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read(spark, sf_dir, "labels").where(remainder(F.col("doc_id")) != 0)
    model = fit(docs, labels.select(F.col("doc_id").alias("id"), F.col("quality").alias("label")))
    held_out = F.coalesce(remainder(F.col("doc_id")) == 0, F.lit(False))
    found = score(docs.withColumn("held_out", held_out), model)
    return found.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
