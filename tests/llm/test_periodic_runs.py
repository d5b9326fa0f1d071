"""Periodic runs against a search over all periods."""

import random

import numpy as np
import pyarrow as pa
import pytest

from evenhand.llm import periodic_runs as pr


def brute(words, least=24, times=3):
    """(start, length, period) of all runs, by start."""
    found = {}
    for q in range(1, len(words) // times + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, times * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def made(rng):
    """Repetitions of short and long periods between other words; some of them follow each other."""
    out = []
    for _ in range(rng.randrange(7)):
        k, letters = rng.choice([1, 2, 3, 5, 7, 8, 9, 15, 16, 17, 31, 40, 70]), rng.choice("a ab abc abcdefgh".split())
        unit = [rng.choice(letters) for _ in range(k)]
        times = rng.randrange(1, 40 // k + 5)
        out += (unit * times)[: rng.randrange(k * times + 1)]
        out += [f"x{rng.randrange(30)}" for _ in range(rng.randrange(20))]
    return out


@pytest.mark.parametrize("block", [pr.BLOCK, 16])
def test_runs_of_made_texts(monkeypatch, block):
    monkeypatch.setattr(pr, "BLOCK", block)
    rng = random.Random(4)
    for turn in range(30):
        docs = [made(rng) for _ in range(12)]
        docs[4] = docs[3] = docs[2]  # copies beside each other are no run
        texts = pr._Texts(pa.array([" ".join(d) for d in docs]))
        found = texts.runs(24, 3)
        opens = texts.first[:-1] + np.arange(len(docs))
        own = np.searchsorted(opens, found[:, 0], side="right") - 1
        for i, words in enumerate(docs):
            assert [(s - opens[i], e - s, q) for s, e, q in found[own == i].tolist()] == brute(words), (turn, words)


def test_transforms_give_exact_product_sums():
    rng = np.random.default_rng(1)
    for m in (8, 64):
        block, window = (rng.integers(0, 1 << 20, (5, k)).astype(np.uint64) for k in (m, 2 * m))
        for p, g in pr.PRIMES:
            plain = [[sum(int(x) * int(y) for x, y in zip(block[r], window[r, d:])) % p for d in range(m)] for r in range(5)]
            assert pr._product_sums(block, window, p, g).tolist() == plain


def test_zero_mismatches_are_occurrences():
    rng = np.random.default_rng(2)
    codes = np.append(rng.integers(0, 2, 4000), 2).astype(np.uint64)
    starts = np.arange(0, 3984, 8)
    got = set(zip(*(x.tolist() for x in pr.zero_mismatches(codes, starts, 3, 8))))
    plain = {(b, d) for b in starts.tolist() for d in range(3, 11) if b + d + 8 <= 4000 and (codes[b : b + 8] == codes[b + d : b + d + 8]).all()}
    assert got == plain and plain


def test_plain_search_agrees():
    rng = random.Random(6)
    words = [w for _ in range(10) for w in made(rng)]
    texts = pr._Texts(pa.array([" ".join(words)]))
    found = texts.runs(24, 3)
    again = pr._plain(texts.codes, found, 24, 3)
    assert again[np.lexsort((again[:, 2], again[:, 0]))].tolist() == found.tolist()


@pytest.mark.parametrize("words", [["a"] * 60000, ["a", "b"] * 20000 + ["c"] * 3000, (["a"] * 300 + ["b"]) * 150, [str(i % 7919) for i in range(40000)]])
def test_long_periodic_texts(words):
    found = pr._Texts(pa.array([" ".join(words)])).runs(24, 3)
    for s, e, q in found.tolist():
        assert words[s : e - q] == words[s + q : e]
        assert (s == 0 or words[s - 1] != words[s - 1 + q]) and (e == len(words) or words[e] != words[e - q])
    assert max((e - s for s, e, _ in found.tolist()), default=0) >= len(words) * 0.9


def test_thresholds():
    words = (["a", "b", "c"] * 12)[:35]
    texts = pr._Texts(pa.array([" ".join(words)]))
    assert texts.runs(24, 3).tolist() == [[0, 35, 3]]
    assert texts.runs(36, 3).tolist() == [] and texts.runs(24, 12).tolist() == []
    with pytest.raises(ValueError):
        texts.runs(10, 3)


ODD = [None, "", " \n\t", "a", "a " * 23, "a " * 24, "\x00 é 中文 " * 9, "a b " * 30, "  a\tb\n" * 15 + "a", "w" * 100000 + " ", ("long " * 7 + "x ") * 500]


def test_odd_rows_and_clashing_names(spark):
    rows = [(i, t, 1, "mine", 0.5) for i, t in enumerate(ODD)] + [(None, "b " * 30, 2, None, None)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs int, collapsed string, start double")
    found = pr.periodic_runs(docs)
    assert found.columns == ["doc_id", "text", "start", "runs", "collapsed"]
    got = found.collect()
    assert len(got) == len(rows)
    for r in got:
        words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", r.text or "") if w]
        runs = brute(words)
        assert [tuple(x) for x in r.runs] == runs
        assert r.collapsed == collapsed(words, runs)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert pr.periodic_runs(docs).count() == 0


def test_wrapping_and_the_most_repeated_run(spark):
    from pyspark.sql import functions as F

    row = spark.createDataFrame([(" a b\tc d e f ",)], "text string").select(pr.wrapped(F.col("text"), F.lit(1), F.lit(2)).alias("t")).first()
    assert row.t == "a b c b c b"
    runs = [(0, 30, 10), (5, 24, 4), (7, 48, 8), (9, 6, 2)]
    df = spark.createDataFrame([(runs,), ([],)], f"runs {pr.RUNS}").select(pr.most_repeated(F.col("runs")).alias("best"))
    assert [r.best and tuple(r.best) for r in df.collect()] == [(5, 24, 4), None]
