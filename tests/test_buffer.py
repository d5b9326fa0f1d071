"""The rolling buffer as a stream against the window over the finished history."""

import random

import pytest
from pyspark.sql import functions as F

from evenhand.plans.rounds import buffered_positives
from evenhand.streaming.buffer import buffered_stream

SCHEMA = "round int, client_id int, a int, y int, row_id string, pos long, x array<double>"


def history(rounds, clients=3, seed=2):
    """Rows of every client in every round; positives of a group are missing in some of them."""
    rng = random.Random(seed)
    rows = []
    for t in range(rounds):
        for client in range(clients):
            rows.append((t, client, 0, 0, f"n{t}-{client}", 1, [0.5]))
            for a in (0, 1):
                for k in range(rng.choice([0, 0, 1, 4])):
                    rows.append((t, client, a, 1, f"p{t}-{client}-{a}-{k}", k + 1, [rng.random(), 0.1]))
    return rows


def run(spark, tmp_path, size):
    """Everything that is new in the folder, round by round."""
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    query = (
        buffered_stream(stream, size).writeStream.format("json").option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    )
    query.awaitTermination()


def add(spark, tmp_path, rows, number):
    """One file for each round, so that files arrive in order."""
    target = tmp_path / "in"
    target.mkdir(exist_ok=True)
    lines = spark.createDataFrame(rows, SCHEMA).select(F.to_json(F.struct("*")).alias("j")).collect()
    (target / f"round{number:03d}.json").write_text("\n".join(r.j for r in lines) + "\n")


@pytest.mark.parametrize("size", [50, 3])
def test_stream_gives_what_the_window_gives(spark, tmp_path, size):
    rows = history(6)
    for t in range(3):
        add(spark, tmp_path, [r for r in rows if r[0] == t], t)
    run(spark, tmp_path, size)
    for t in range(3, 6):  # a restart goes on from the state
        add(spark, tmp_path, [r for r in rows if r[0] == t], t)
    run(spark, tmp_path, size)
    keys = ["round", "client_id", "a", "row_id", "pos", "x"]
    got = sorted(tuple(r) for r in spark.read.schema(SCHEMA).json(str(tmp_path / "out")).select(*keys).collect())
    plain = buffered_positives(spark.createDataFrame(rows, SCHEMA), 6, size)
    assert got == sorted(tuple(r) for r in plain.select(*keys).collect()) and got
    assert max(len([g for g in got if g[:3] == key]) for key in {g[:3] for g in got}) <= size


def test_late_rounds_are_refused(spark, tmp_path):
    rows = history(2)
    add(spark, tmp_path, [r for r in rows if r[0] == 1], 0)
    run(spark, tmp_path, 50)
    add(spark, tmp_path, [r for r in rows if r[0] == 0], 1)
    with pytest.raises(Exception, match="came after round"):
        run(spark, tmp_path, 50)
