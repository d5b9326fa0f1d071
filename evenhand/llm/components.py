"""Connected components of a graph that is given by its links.

Every task first joins the links of a batch by union-find, which leaves a forest of them. Then rounds of large star and
small star hang each node on the smallest neighbour until every component is a star. A round costs two
joins on the node; counts of neighbours are combined before the shuffle, and a node with many neighbours is
a skewed join key that Spark splits. Each round is a written table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from evenhand.llm.common import written

LINKS = "u long, v long"
# Links that one union-find pass holds.
BATCH = 1 << 20


def find_roots(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the links and the smallest node that each reaches."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    parent = list(range(len(nodes)))
    for a, b in zip(ends[: len(u)].tolist(), ends[len(u) :].tolist()):
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        while parent[b] != b:
            parent[b] = parent[parent[b]]
            b = parent[b]
        # The smaller node stays root, so a root is the smallest of its tree.
        if a < b:
            parent[b] = a
        elif b < a:
            parent[a] = b
    for i, p in enumerate(parent):
        parent[i] = parent[p]
    return nodes, nodes[np.array(parent, np.int64)] if len(nodes) else nodes


def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (u, v) to links (node, smallest node reached) with the same components."""
    held: list[pa.RecordBatch] = []

    def joined() -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        nodes, roots = find_roots(table["u"].to_numpy(), table["v"].to_numpy())
        below = nodes != roots
        return pa.RecordBatch.from_arrays([pa.array(nodes[below], pa.int64()), pa.array(roots[below], pa.int64())], ["u", "v"])

    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= BATCH:
            yield joined()
            held.clear()
    if held:
        yield joined()


def components(links: DataFrame) -> DataFrame:
    """Links (u, v) to rows (node, component): the smallest node that each linked node reaches; nodes without links are not in it."""
    links = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    links = written(links.mapInArrow(forest, LINKS).distinct())
    before = None
    while True:
        state = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state[0] == 0 or state == before:
            break
        before = state
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = written(small.union(least.select("u", F.col("m").alias("v"))).distinct())
    return links.select(F.col("u").alias("node"), F.col("v").alias("component"))
