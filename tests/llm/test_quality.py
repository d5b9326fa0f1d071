"""Quality scores against plain versions, and on held-out labels."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from evenhand.llm import quality
from evenhand.llm.catalog import QUERIES

SF_DIR = "/root/testdata/sf0.01"
GOOD = ["The quick brown fox jumps over the lazy dog today.", "A plain sentence with a few words, and a second part.", "Nothing odd is in here; people read it."]
BAD = ["BUY!!! NOW!!! CHEAP!!!", "x| y| z| | w|", "spam spam spam spam spam spam"]


def shape(word):
    signs = re.sub(rb"[0-9]", b"0", re.sub(rb"[a-z\x80-\xff]", b"a", re.sub(rb"[A-Z]", b"A", word)))
    return re.sub(rb"(.)\1+", rb"\1", signs, flags=re.S)


@pytest.mark.parametrize("text", [*GOOD, *BAD, "", " ", "Aé12--b  Aé12--b aé12--B\n\x00!!", "é" * 50 + " zz 77"])
def test_terms_of_a_text(text):
    """Words, shapes and repeats in their numbers; equal words have equal terms."""
    terms = quality.Terms.of(pa.array([text, None, text]))
    words = re.findall(rb"[^\x20\x09-\x0D]+", text.encode())
    lower = [re.sub(rb"[A-Z]", lambda m: m[0].lower(), w) for w in words]
    assert terms.words.tolist() == [len(words), 0, len(words)]
    for r in (0, 2):
        own = {int(t): int(n) for t, n in zip(terms.term[terms.row == r], terms.count[terms.row == r])}
        assert sorted(n for t, n in own.items() if t < quality.WORDS) == sorted(Counter(lower).values())
        assert sorted(n for t, n in own.items() if quality.WORDS <= t < quality.REPEAT) == sorted(Counter(map(shape, words)).values())
        assert own.get(quality.REPEAT, 0) == sum(a == b for a, b in zip(lower, lower[1:]))


def test_rarity_counts_all_documents(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*GOOD, *BAD, None, " ", GOOD[0]])], "doc_id long, text string").repartition(4)
    rarity = quality.rarity_of(docs)
    there = Counter(int(t) for text in [*GOOD, *BAD, GOOD[0]] for t in set(quality.Terms.of(pa.array([text])).term.tolist()))
    for t in range(quality.TERMS):
        assert rarity[t] == pytest.approx(math.log(8 / (there[t] + 1)) + 0.01)


def sparse(rng, rows, density):
    dense = np.where(rng.random((rows, quality.TERMS)) < density, rng.random((rows, quality.TERMS)), 0.0)
    row, term = np.nonzero(dense)
    return dense, row, term, dense[row, term]


def test_latent_space_spans_the_leading_singular_vectors():
    rng = np.random.default_rng(5)
    dense, row, term, weight = sparse(rng, 60, 0.002)
    dense[:30, 5] += 9.0
    dense[30:, 7] += 6.0
    row, term = np.nonzero(dense)
    space = quality.latent_space(row, 60, term, dense[row, term], 2)
    right = np.linalg.svd(dense, full_matrices=False)[2][:2]
    assert np.allclose(space @ (space.T @ right.T), right.T, atol=1e-6)
    assert np.allclose(space.T @ space, np.eye(2))


def test_votes_against_all_pairs(spark):
    rows = spark.read.parquet(f"{SF_DIR}/documents.parquet").join(spark.read.parquet(f"{SF_DIR}/labels.parquet"), "doc_id")
    docs = rows.select("doc_id", "text")
    model = quality.fit(docs, rows.select(F.col("doc_id").alias("id"), F.col("quality").alias("label")), per_class=30, neighbours=7)
    got = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    for i, text in list(texts.items())[::7]:
        terms = quality.Terms.of(pa.array([text]))
        x = np.zeros(quality.TERMS)
        x[terms.term] = np.sqrt(terms.count / terms.words[0]) * model.rarity[terms.term]
        for part in (x[: quality.WORDS], x[quality.WORDS :]):
            part /= np.linalg.norm(part)
        near = model.vectors @ (x @ model.space) / np.linalg.norm(x @ model.space)
        best = np.argsort(-near)[:7]
        weight = np.maximum(near[best], 0)
        assert got[i] == pytest.approx(float((weight * model.labels[best]).sum() / weight.sum()), abs=1e-9)


def test_held_out_labels(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()}
    held = [(r.score, r.predicted, labels[r.doc_id]) for r in QUERIES["op13_latent_quality"](spark, SF_DIR).collect() if r.held_out and r.doc_id in labels]
    pairs = [(a[0] > b[0]) + 0.5 * (a[0] == b[0]) for a in held if a[2] for b in held if not b[2]]
    assert sum(pairs) / len(pairs) > 0.97
    assert sum(p == q for _, p, q in held) / len(held) > 0.95


def test_held_out_rows_of_the_query(spark):
    found = QUERIES["op13_latent_quality"](spark, SF_DIR)
    assert found.columns == ["doc_id", "held_out", "score", "predicted"]
    for r in found.collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)


def table(spark, texts):
    return spark.createDataFrame([(i, t, "clash", 7) for i, t in enumerate(texts)], "doc_id long, text string, score string, label int")


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "id long, label int")


def test_odd_rows(spark):
    texts = [*GOOD, *BAD, None, "", " \n", "中文", "\x00", "w " * 200000, "q" * 300000]
    docs = table(spark, texts).unionByName(table(spark, texts)).unionByName(spark.createDataFrame([(None, GOOD[0], "clash", 7)], "doc_id long, text string, score string, label int"))
    labels = labels_of(spark, [(0, 1), (1, 1), (2, 1), (3, 0), (4, 0), (5, 0), (5, 1), (None, 1), (6, None), (7, 0), (99, 1)])
    found = quality.score(docs, quality.fit(docs, labels))
    assert found.columns == ["doc_id", "text", "label", "score"]
    got = found.collect()
    assert len(got) == 2 * len(texts) + 1
    by = {}
    for r in got:
        assert by.setdefault(r.text, r.score) == r.score
    share = 4 / 8  # 0, 1, 2, 99 of eight labelled ids
    assert by[None] == by[""] == by[" \n"] == share
    assert all(by[t] > 0.5 for t in GOOD) and all(by[t] < 0.5 for t in BAD)


@pytest.mark.parametrize(("rows", "expected"), [([], 0.5), ([(0, 1)], 1.0), ([(0, 0), (1, 0)], 0.0), ([(50, 1), (51, 0), (52, 0), (53, 0)], 0.25)])
def test_few_labels(spark, rows, expected):
    docs = table(spark, GOOD)
    assert {r.score for r in quality.score(docs, quality.fit(docs, labels_of(spark, rows))).collect()} == {expected}


def test_empty_table(spark):
    docs = table(spark, ["x"]).limit(0)
    assert quality.score(docs, quality.fit(docs, labels_of(spark, [(1, 1)]))).count() == 0


def test_sample_is_bounded_and_balanced(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"))
    labels = spark.range(4000).select("id", (F.col("id") % 10 > 0).cast("int").alias("label"))
    sample, share = quality.labelled_sample(docs, labels, 100, "doc_id", "text")
    n = {r.label: r["count"] for r in sample.groupBy("label").count().collect()}
    assert share == 0.9 and all(60 < x < 140 for x in n.values()) and len(n) == 2
