"""Near-duplicate documents by SuperMinHash.

A document's set holds its distinct shingles of ``width`` words; two documents are linked if their sets' Jaccard similarity is at
least ``threshold``, and groups are the components of the links.

1. Signatures. For every element a random permutation of the ``BANDS * ROWS`` places is drawn step by step; step j offers j plus a
   random fraction to the place it draws, and a place keeps its least offer. Places' ranks are correlated, which lowers the variance, and a
   document is done as soon as all its places hold less than the next step could offer. Steps run for the elements of many documents at once.
2. Documents with equal sets are one from here on (a fingerprint of 128 bits and the size tell).
3. Bands. Documents that share a band are linked to the smallest one there; the components of these links are clusters: every pair
   that shares a band lies in one cluster. No pairs within a band are made. A pair at the threshold of 0.8 misses all bands with a probability of 2e-5.
4. Verification. The full sets of a cluster meet in one task, which counts the shared shingles of all its documents as one sparse
   or dense product and returns a forest of the links that hold. Clusters of more than ``CELL`` documents are split: the distance (1 - similarity, a metric)
   to the cluster's first document puts documents into rings; documents within rings nearer than 1 - threshold are linked
   by way of the first one, rings further apart than that cannot be linked, and of what is left, blocks of ``CELL`` documents are compared.
5. Groups are the components of the verified links (union-find in tasks, then stars across them).

Defined cases: documents with fewer words than ``width`` have the whole sequence as their one shingle; null or blank texts have an empty set and are
linked with nothing; a null id has a null component and is kept; rows that share an id are judged row by row; input columns are kept, added
ones replace those of their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from evenhand.llm.catalog import register
from evenhand.llm.common import lower_ascii, mix, read, slices, text_bytes, window_hashes, word_hashes, word_spans, written
from evenhand.llm.components import LINKS, components, find_roots

WIDTH = 5
THRESHOLD = 0.8
BANDS = 36
ROWS = 6
CELL = 1024
RINGS = 10
STEP_BYTES = 1 << 20
_FRACTION = 48


def shingle_sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashed shingles of every text, ascending and distinct, one text after the other, and where each begins."""
    data, offsets = text_bytes(texts)
    begins, ends, first = word_spans(lower_ascii(data), offsets)
    words = word_hashes(lower_ascii(data), begins, ends)
    n_words = np.diff(first)
    doc = np.repeat(np.arange(len(n_words)), n_words)
    starts = np.flatnonzero(first[doc + 1] - np.arange(len(words)) >= width)
    hashes, owner = window_hashes(words, width)[starts], doc[starts]
    for n in range(1, width):
        # A short document's only shingle differs from all of full width.
        short = np.flatnonzero(n_words == n)
        if len(short):
            whole = mix(window_hashes(words, n)[first[short]] + np.uint64(n))
            hashes, owner = np.concatenate([hashes, whole]), np.concatenate([owner, short])
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    hashes, owner = hashes[new], owner[new]
    return hashes, np.searchsorted(owner, np.arange(len(n_words) + 1))


def _odd(n: int) -> np.uint64:
    """The n-th step of a sequence that runs through all 64-bit numbers."""
    return np.uint64(n * 0x9E3779B97F4A7C15 % 2**64)


def super_minhash(hashes: np.ndarray, first: np.ndarray, places: int) -> np.ndarray:
    """The signature of every set (set, place); an empty set has the largest number everywhere."""
    n = len(first) - 1
    out = np.full((n, places), np.iinfo(np.uint64).max, np.uint64)
    flat = out.reshape(-1)
    owner = np.repeat(np.arange(n), np.diff(first))
    drawn = None  # permutations so far, one row for each element
    for step in range(places):
        if not len(hashes):
            break
        fraction = mix(hashes + _odd(2 * step + 1)) >> np.uint64(64 - _FRACTION)
        pick = step + (mix(hashes + _odd(2 * step + 2)) >> np.uint64(32)) % np.uint64(places - step)
        pick = pick.astype(np.int64)
        row = np.arange(len(hashes))
        place = pick if drawn is None else drawn[row, pick].astype(np.int64)
        np.minimum.at(flat, owner * places + place, (np.uint64(step) << np.uint64(_FRACTION)) | fraction)
        # A document whose places are all below the next step's offers is done.
        live = (out.max(axis=1) >= np.uint64(step + 1) << np.uint64(_FRACTION))[owner]
        if drawn is None:
            kind = np.uint8 if places <= 256 else np.uint16
            drawn = np.broadcast_to(np.arange(places, dtype=kind), (int(live.sum()), places)).copy()
        else:
            drawn = drawn[live]
        hashes, owner, pick, place = hashes[live], owner[live], pick[live], place[live]
        row = np.arange(len(hashes))
        drawn[row, pick] = drawn[row, step]
        drawn[row, step] = place
    return out


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A key for each band of each signature; equal keys mean equal bands of the same number."""
    cut = signatures.reshape(len(signatures), bands, rows)
    keys = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), cut.shape[:2]).copy()
    for r in range(rows):
        keys = mix(keys * np.uint64(0xD6E8FEB86659FD93) + cut[:, :, r])
    return keys.view(np.int64)


def _signed(width: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", STEP_BYTES):
            hashes, first = shingle_sets(batch.column("text"), width)
            sizes = np.diff(first)
            marks = []
            for salt in (0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179):
                total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(hashes ^ np.uint64(salt)), dtype=np.uint64)])
                marks.append(pa.array((total[first[1:]] - total[first[:-1]]).view(np.int64)))
            keys = band_keys(super_minhash(hashes, first, bands * rows), bands, rows)
            listed = pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1, dtype=np.int32) * bands), pa.array(keys.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(sizes, pa.int64()), *marks, listed], ["doc_id", "text_hash", "n_shingles", "mark1", "mark2", "bands"])

    return run


def _sets(width: int):
    """Rows (cluster, n_cluster, node, text) to their sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", STEP_BYTES):
            hashes, first = shingle_sets(batch.column("text"), width)
            cut = [hashes[a:b].tobytes() for a, b in zip(first, first[1:])]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in ("cluster", "n_cluster", "node")), pa.array(cut, pa.binary())], ["cluster", "n_cluster", "node", "shingles"])

    return run


def _loaded(column) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), np.uint64) for x in column]


def shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many elements each set on the left shares with each on the right."""
    rows, cols = np.repeat(np.arange(len(left)), [len(x) for x in left]), np.repeat(np.arange(len(right)), [len(x) for x in right])
    codes, at = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    a, b = at[: len(rows)], at[len(rows) :]
    n_a, n_b = np.bincount(a, minlength=len(codes)), np.bincount(b, minlength=len(codes))
    both = (n_a > 0) & (n_b > 0)
    renumbered = np.cumsum(both) - 1
    keep_a, keep_b = both[a], both[b]
    a, rows, b, cols, n_a, n_b = renumbered[a[keep_a]], rows[keep_a], renumbered[b[keep_b]], cols[keep_b], n_a[both], n_b[both]
    out = np.zeros((len(left), len(right)), np.float32)
    if not len(n_a):
        return out.astype(np.int64)
    order_a, order_b = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
    a, rows, b, cols = a[order_a], rows[order_a], b[order_b], cols[order_b]
    if (n_a * n_b).sum() * 100 < len(left) * len(right) * len(n_a):
        # Few documents have each shingle: list the pairs of each, a bounded number at a time.
        start_b, flat = np.cumsum(n_b) - n_b, np.zeros(out.size, np.int64)
        reach = np.cumsum(n_b[a])
        low = 0
        while low < len(a):
            high = max(low + 1, int(np.searchsorted(reach, (reach[low - 1] if low else 0) + (1 << 22))))
            times = n_b[a[low:high]]
            inner = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            pair = np.repeat(rows[low:high] * len(right), times) + cols[np.repeat(start_b[a[low:high]], times) + inner]
            flat += np.bincount(pair, minlength=out.size)
            low = high
        return flat.reshape(out.shape)
    for low in range(0, len(n_a), 4096):
        # Whole numbers below 2^24 are exact in single precision.
        x, y = np.zeros((len(left), 4096), np.float32), np.zeros((len(right), 4096), np.float32)
        i, j = slice(*np.searchsorted(a, [low, low + 4096])), slice(*np.searchsorted(b, [low, low + 4096]))
        x[rows[i], a[i] - low] = 1
        y[cols[j], b[j] - low] = 1
        out += x @ y.T
    return out.astype(np.int64)


def _verified(left_ids: np.ndarray, left: list[np.ndarray], right_ids: np.ndarray, right: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The links that hold, as a forest."""
    shared = shared_counts(left, right)
    union = np.array([len(x) for x in left])[:, None] + np.array([len(x) for x in right])[None, :] - shared
    i, j = np.nonzero((100 * shared >= percent * union) & (shared > 0))
    nodes, roots = find_roots(left_ids[i], right_ids[j])
    below = nodes != roots
    return nodes[below], roots[below]


def _links(u: np.ndarray, v: np.ndarray) -> pa.Table:
    return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})


def _within_clusters(percent: int):
    """All clusters of a bin, one by one."""

    def run(table: pa.Table) -> pa.Table:
        table = table.take(pa.array(np.argsort(table["cluster"].to_numpy(), kind="stable")))
        clusters, nodes, sets = table["cluster"].to_numpy(), table["node"].to_numpy(), _loaded(table["shingles"])
        edges = np.append(np.flatnonzero(np.diff(clusters, prepend=clusters[0] - 1)), len(clusters))
        found = [_verified(nodes[a:b], sets[a:b], nodes[a:b], sets[a:b], percent) for a, b in zip(edges, edges[1:])]
        return _links(np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found]))

    return run


def _between_blocks(percent: int):
    """One cell: the documents of two blocks of a cluster, or of one block twice."""

    def run(table: pa.Table) -> pa.Table:
        nodes, side, sets = table["node"].to_numpy(), table["side"].to_numpy(), _loaded(table["shingles"])
        i, j = np.flatnonzero(side <= 0), np.flatnonzero(side >= 0)
        return _links(*_verified(nodes[i], [sets[k] for k in i], nodes[j], [sets[k] for k in j], percent))

    return run


def _ringed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the numbers of shingles that a document and its cluster's first one have in common, and together."""
    for batch in batches:
        shared, union = [], []
        for own, pivot in zip(batch.column("shingles"), batch.column("pivot")):
            a, b = np.frombuffer(own.as_buffer(), np.uint64), np.frombuffer(pivot.as_buffer(), np.uint64)
            at = np.searchsorted(b, a)
            shared.append(int((b[np.minimum(at, len(b) - 1)] == a).sum()))
            union.append(len(a) + len(b) - shared[-1])
        columns = {n: batch.column(n) for n in ("cluster", "node", "shingles")}
        columns |= {"shared": pa.array(shared, pa.int64()), "total": pa.array(union, pa.int64())}
        yield pa.RecordBatch.from_arrays([*columns.values()], [*columns])


def _large_clusters(sets: DataFrame, percent: int, cell_size: int) -> tuple[DataFrame, DataFrame]:
    """Of clusters beyond the size of a cell: the links to their first documents, and the cells to compare."""
    pivots = sets.where("node = cluster").groupBy("cluster").agg(F.min("shingles").alias("pivot"))
    ringed = sets.join(pivots, "cluster").mapInArrow(_ringed, "cluster long, node long, shingles binary, shared long, total long")
    # Ring r holds distances in [r, r + 1) / RINGS.
    ringed = written(ringed.withColumn("ring", F.expr(f"CAST((total - shared) * {RINGS} DIV total AS INT)")))
    near = ringed.where((F.col("shared") * 100 >= F.col("total") * percent) & (F.col("node") != F.col("cluster")))
    near = near.select(F.col("node").alias("u"), F.col("cluster").alias("v"))
    sizes = ringed.groupBy("cluster", "ring").agg(F.ceil(F.count("*") / cell_size).cast("int").alias("blocks"))
    others = sizes.select("cluster", F.col("ring").alias("other"), F.col("blocks").alias("other_blocks"))
    # Inner rings hold only documents that are linked to the first one; between rings too far apart no link is possible.
    inner, reach = RINGS * (100 - percent) // 100, -(-RINGS * (100 - percent) // 100)
    pairs = sizes.join(others, "cluster").where((F.abs(F.col("ring") - F.col("other")) <= reach) & (F.greatest("ring", "other") >= inner))
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    rows = ringed.join(pairs, ["cluster", "ring"]).withColumn("block", block)
    rows = rows.withColumn("other_block", F.explode(F.sequence(F.lit(0), F.col("other_blocks") - 1)))
    own, met = F.struct(F.col("ring").alias("r"), F.col("block").alias("b")), F.struct(F.col("other").alias("r"), F.col("other_block").alias("b"))
    side = F.when(own < met, -1).when(own > met, 1).otherwise(0)
    cell = F.concat_ws(":", F.least(own, met).cast("string"), F.greatest(own, met).cast("string"))
    return near, rows.select("cluster", cell.alias("cell"), side.alias("side"), "node", "shingles")


def near_duplicates(docs: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, cell: int = CELL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: doc_id, text_hash, n_shingles, component_id (the smallest doc_id of its group) and kept."""
    percent = round(100 * threshold)
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    signed = named.withColumn("text_hash", F.xxhash64("text"))
    signed = written(signed.mapInArrow(_signed(width, bands, rows), "doc_id long, text_hash long, n_shingles long, mark1 long, mark2 long, bands array<long>"))
    marks = ["n_shingles", "mark1", "mark2"]
    full = signed.where("n_shingles > 0 and doc_id is not null")
    equal = written(full.groupBy(*marks).agg(F.min("doc_id").alias("node")))

    firsts = full.join(equal.withColumnRenamed("node", "doc_id"), [*marks, "doc_id"], "left_semi")
    banded = firsts.select(F.explode("bands").alias("band"), F.col("doc_id").alias("node"))
    least = banded.groupBy("band").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least < most").drop("most")
    met = banded.join(least, "band").where("node <> least").select(F.col("node").alias("u"), F.col("least").alias("v"))
    clusters = components(met)
    clusters = written(clusters.union(clusters.select(F.col("component").alias("node"), "component").distinct()).withColumnRenamed("component", "cluster"))
    sizes = clusters.groupBy("cluster").agg(F.count("*").alias("n_cluster"))
    members = clusters.join(sizes, "cluster")

    # The same plan at every size: clusters grow with the table, so they are never broadcast.
    sets = named.join(members.hint("merge"), named["doc_id"] == members["node"]).select("cluster", "n_cluster", "node", "text")
    sets = written(sets.mapInArrow(_sets(width), "cluster long, n_cluster long, node long, shingles binary").where(F.length("shingles") > 0))
    small = sets.where(F.col("n_cluster") <= cell)
    bins = max(1, -(-small.count() // cell))
    small = small.withColumn("bin", F.pmod(F.xxhash64("cluster"), F.lit(bins))).select("bin", "cluster", "node", "shingles")
    links = small.groupBy("bin").applyInArrow(_within_clusters(percent), LINKS)
    near, cells = _large_clusters(sets.where(F.col("n_cluster") > cell), percent, cell)
    links = links.union(near).union(cells.groupBy("cluster", "cell").applyInArrow(_between_blocks(percent), LINKS))
    groups = components(links)

    named_sets = equal.join(groups, "node", "left").select(*marks, F.coalesce("component", "node").alias("component_id"))
    found = signed.drop("bands").join(named_sets, marks, "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    found = found.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), component))
    return found.select("doc_id", "text_hash", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


ORACLE = r"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, array_to_string(w[pos:pos + 3], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS pos FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * shared.n >= 80 * (p.n + q.n - shared.n)),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, links.y FROM reach JOIN links ON links.x = reach.other),
groups AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT g.doc_id, CAST(coalesce(s.n, 0) AS BIGINT) AS n_shingles, component_id, g.doc_id = component_id AS kept FROM groups g LEFT JOIN sizes s ON s.doc_id = g.doc_id
"""


@register("op4_super_minhash", ORACLE)
def super_minhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read(spark, sf_dir, "documents"), width=4)
    return found.select("doc_id", "n_shingles", "component_id", "kept")
