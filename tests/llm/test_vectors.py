"""Nearest neighbours and exact top-k against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from evenhand.llm import hilbert_ann, uniform_topk, vectors as vec
from evenhand.llm.catalog import QUERIES

SCHEMA = "vec_id long, embedding array<float>, query_id string, top string"
def query():
    return F.col("vec_id") % 20 == 0



def table(spark, rows):
    return spark.createDataFrame([(i, v, "clash", None) for i, v in rows], SCHEMA)


def brute(rows, k, weigh=float):
    kept = {i: [weigh(x) for x in v] for i, v in rows}
    out = {}
    for q in kept:
        if q % 20 == 0:
            scores = sorted((-sum(a * b for a, b in zip(kept[q], v)), i) for i, v in kept.items() if i != q)
            out[q] = [(i, -s) for s, i in scores[:k]]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def random_rows(n, width, seed=1):
    rng = np.random.default_rng(seed)
    return [(i, [float(np.float32(x)) for x in rng.normal(size=width)]) for i in range(n)]


@pytest.mark.parametrize("k", [1, 5, 200])
def test_top_k_is_exact(spark, k):
    rows = [(i, [float(round(3 * x)) for x in v]) for i, v in random_rows(150, 7)]  # many ties
    assert found(uniform_topk.top_k(table(spark, rows), query(), k=k)) == brute(rows, k)


def test_top_k_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(vec, "CHUNK_ROWS", 16)
    monkeypatch.setattr(vec, "GROUP_ROWS", 3)
    monkeypatch.setattr(vec, "FAN_IN", 2)
    rows = [(i, [float(round(5 * x)) for x in v]) for i, v in random_rows(300, 6, 2)]
    for nodes in (1, 2, 3, 6):
        assert found(uniform_topk.top_k(table(spark, rows), query(), k=4, nodes=nodes)) == brute(rows, 4)


def test_top_k_over_many_strips_and_parts(spark, monkeypatch):
    monkeypatch.setattr(vec, "CHUNK_ROWS", 16)
    monkeypatch.setattr(vec, "GROUP_ROWS", 3)
    monkeypatch.setattr(uniform_topk, "STRIP_CHUNKS", 2)
    monkeypatch.setattr(uniform_topk, "PART_GROUPS", 2)
    rows = [(i, [float(round(5 * x)) for x in v]) for i, v in random_rows(300, 6, 4)]
    for nodes, k in ((1, 4), (2, 4), (3, 40), (6, 299)):
        assert found(uniform_topk.top_k(table(spark, rows), query(), k=k, nodes=nodes)) == brute(rows, k)


@pytest.mark.parametrize("size", [1.0, 300.0, 2.0**20, 2.0**28])
def test_top_k_of_numbers_of_any_size(spark, size):
    rows = [(i, [float(round(size * x)) for x in v]) for i, v in random_rows(2000, 6, 5)]
    rows = [(i, v) for i, v in rows if i % 20 or i < 200] + [(3000 + i, [-abs(x) for x in v]) for i, v in rows[:50]]
    assert found(uniform_topk.top_k(table(spark, rows), query(), k=6)) == brute(rows, 6, int)


def test_blocks_of_top_k_never_meet_in_the_driver(spark, monkeypatch):
    """Blocks of queries, copied for all vectors, would come to the driver as a broadcast wherever their packed file is small."""
    plans = []

    def noted(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return written(df)

    written = uniform_topk.written
    monkeypatch.setattr(uniform_topk, "written", noted)
    rows = [(i, [float(round(5 * x)) for x in v]) for i, v in random_rows(300, 6, 4)]
    top = uniform_topk.top_k(table(spark, rows), query(), k=4)
    plans.append(top._jdf.queryExecution().executedPlan().toString())
    assert sum("MapInArrow" in plan for plan in plans) >= 2
    assert not [plan for plan in plans if "Broadcast" in plan or "CartesianProduct" in plan]
    assert found(top) == brute(rows, 4)


def test_top_k_beyond_the_exact_range_of_doubles(spark):
    rows = [(i, [float(2**28 + 32 * i), float(i), 1.0]) for i in range(45)]
    got = found(uniform_topk.top_k(table(spark, rows), query(), k=3))
    assert got == brute(rows, 3, int)


BAD = [(1000, None), (1020, []), (1040, [1.0, None]), (1060, [math.nan, 1.0]), (1080, [math.inf, 1.0]), (None, [1.0, 1.0])]


def test_odd_rows_take_no_part(spark):
    good = [(i, [float(i % 7), 1.0]) for i in range(60)]
    assert found(uniform_topk.top_k(table(spark, good + BAD), query(), k=3)) == brute(good, 3)
    near = found(hilbert_ann.nearest(table(spark, good + BAD + [(1100, [0.0, 0.0])]), query(), k=3, ranges=2))
    assert near == brute(good, 3)


def test_repeated_ids_count_once(spark):
    rows = [(0, [1.0]), (0, [1.0]), (1, [2.0]), (1, [2.0]), (2, [2.0])]
    assert found(uniform_topk.top_k(table(spark, rows), query(), k=5)) == {0: [(1, 2), (2, 2)]}
    assert found(hilbert_ann.nearest(table(spark, rows), query(), k=5, ranges=2)) == {0: [(1, 2.0), (2, 2.0)]}


@pytest.mark.parametrize("rows", [[], [(0, [1.0, 2.0])], BAD])
def test_nothing_to_find(spark, rows):
    for df in (uniform_topk.top_k(table(spark, rows), query()), hilbert_ann.nearest(table(spark, rows), query())):
        assert df.columns == ["query_id", "rank", "vec_id", "score"]
        assert df.count() == 0


def test_one_common_vector(spark):
    rows = [(i, [1.0, 2.0, 3.0] if i % 3 else [float(i), 1.0, 0.0]) for i in range(400)]
    assert found(uniform_topk.top_k(table(spark, rows), query(), k=7)) == brute(rows, 7)
    near = found(hilbert_ann.nearest(table(spark, rows), query(), k=7))
    # Copies all score the same, so the smallest ids among those found come first.
    for q, listed in near.items():
        assert [s for _, s in listed] == sorted((s for _, s in listed), reverse=True)
        assert all(a[0] < b[0] for a, b in zip(listed, listed[1:]) if a[1] == b[1])


def test_ranges_with_common_vectors_are_neighbours():
    rng = np.random.default_rng(3)
    common = rng.normal(size=(6, 8))
    rows = np.concatenate([np.repeat(common, 130, axis=0), rng.normal(size=(220, 8))])
    longest = float(np.linalg.norm(rows, axis=1).max())
    index = hilbert_ann.Index.fit(rows, longest, 14, 6, 4, 16, 7)
    for own in index.ranges(hilbert_ann._lift(rows, longest)):
        assert sorted(set(own.tolist())) == list(range(own.min(), own.max() + 1))


@pytest.mark.parametrize(("dims", "bits"), [(2, 3), (3, 2), (4, 2)])
def test_hilbert_curve_steps_to_neighbouring_cells(dims, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
    keys = hilbert_ann.hilbert_keys(cells, bits)
    assert sorted(keys) == list(range(len(cells)))
    path = cells[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_recall_and_scores_of_the_query(spark):
    sf_dir = "/root/testdata/sf0.01"
    got = found(QUERIES["op1_hilbert_ann"](spark, sf_dir))
    rows = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()}
    ids = np.array(sorted(rows))
    matrix = np.stack([rows[i] for i in ids])
    hits = 0
    assert set(got) == {i for i in rows if i % 20 == 0}
    for q, listed in got.items():
        scores = matrix @ rows[q]
        best = [i for i in ids[np.lexsort((ids, -scores))] if i != q][:20]
        hits += len({i for i, _ in listed} & set(best))
        assert len(listed) == 20
        assert all(abs(s - rows[q] @ rows[i]) < 1e-12 for i, s in listed)
    assert hits >= 0.9 * 20 * len(got)
