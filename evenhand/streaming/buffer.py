"""The rolling buffer of positives on a stream of minibatches.

Each client keeps its last positives of either group as state, at most ``size`` each, across rounds and restarts. A group that has none
in a round gets those of the rounds before, as ``rounds.buffered_positives`` gives them for a finished history.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

FILLED = "round int, client_id int, a int, y int, row_id string, pos long, x array<double>"
GROUPS = (0, 1)


def _filled(size: int):
    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts), ignore_index=True)
        last, held = json.loads(state.get[0]) if state.exists else (-1, {str(a): [] for a in GROUPS})
        out = []
        for number, batch in rows.groupby("round", sort=True):
            if number <= last:
                raise ValueError(f"round {number} of client {key[0]} came after round {last}")
            positives = batch[batch["y"] == 1].sort_values(["pos", "row_id"])
            for a in GROUPS:
                own = positives[positives["a"] == a]
                kept = held[str(a)]
                if own.empty:
                    out += [(number, key[0], a, 1, row_id, pos, x) for row_id, pos, x in kept]
                new = [[r.row_id, int(r.pos), [float(v) for v in r.x]] for r in own.itertuples()]
                held[str(a)] = (kept + new)[-size:]
            last = int(number)
        state.update((json.dumps([last, held]),))
        yield pd.DataFrame(out, columns=["round", "client_id", "a", "y", "row_id", "pos", "x"])

    return run


def buffered_stream(batches: DataFrame, size: int = 50) -> DataFrame:
    """For the streamed minibatches ``(round, client_id, a, y, row_id, pos, x)`` the rows that fill groups without positives.

    A client's group in a micro-batch is its minibatches, at most 128 rows a round. A round comes as a whole, in one micro-batch, and rounds come in order;
    one that comes late or twice is refused, as its rows would change what is out already.
    """
    rows = batches.select(
        F.col("round").cast("int").alias("round"), F.col("client_id").cast("int").alias("client_id"), F.col("a").cast("int").alias("a"),
        F.col("y").cast("int").alias("y"), "row_id", F.col("pos").cast("long").alias("pos"), "x",
    )
    return rows.groupBy("client_id").applyInPandasWithState(_filled(size), FILLED, "held string", "append", GroupStateTimeout.NoTimeout)
