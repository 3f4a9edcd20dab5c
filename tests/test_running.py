"""Counts that follow a stream, and outputs read again by their files' stamps."""

import random

import pytest
from pyspark.sql import functions as F

from tests.logs import SCHEMA, drawn, frame, hops
from tracelake.operators import dfg
from tracelake.sources import store
from tracelake.sources.outputs import Outputs
from tracelake.streaming import running

SHARED = ["source", "target", "frequency", "mean_duration_seconds", "median_duration_seconds"]


def split(rows, seed, batches):
    """Rows dealt to batches at random, in order within each case."""
    draw, cuts, out = random.Random(seed), {}, [[] for _ in range(batches)]
    for c in sorted({r[0] for r in rows}):
        own = sorted((r for r in rows if r[0] == c), key=lambda r: r[1])
        cuts[c] = sorted(draw.randrange(batches) for _ in own)
        for r, k in zip(own, cuts[c]):
            out[k].append(r)
    return out


@pytest.mark.parametrize("seed", [3, 11])
def test_any_split_gives_the_edges_of_the_whole(spark, tmp_path, seed):
    rows, at = drawn(seed, cases=25), str(tmp_path / "counts")
    for k, part in enumerate(split(rows, seed, 4)):
        running.update(frame(spark, part), k, at)
    running.update(frame(spark, rows), 1, at)  # a batch that is in the counts already
    found = sorted(map(tuple, running.edges(spark, at).collect()))
    assert found == sorted(map(tuple, dfg.edges(frame(spark, rows)).select(*SHARED).collect()))
    assert {(a, b): n for a, b, n, *_ in found} == {k: len(v) for k, v in hops(rows).items()}
    assert running.late_events(spark, at).head().late == 0 and store.versions(spark, at) == [3, 4]


def test_late_events_are_counted_and_left_out(spark, tmp_path):
    at = str(tmp_path / "counts")
    assert running.edges(spark, at).count() == 0 and running.late_events(spark, at).head().late == 0
    event = lambda place, name, time, case="c": (case, place, name, time, None, None)
    running.update(frame(spark, [event(0, "A", 0), event(2, "B", 60)]), 0, at)
    late = [event(1, "X", 30), event(2, "B", 60), event(3, "Y", 59)]
    broken = spark.createDataFrame([("c", 9, None, None, None, None), (None, 9, "A", None, None, None)], SCHEMA)
    running.update(frame(spark, [*late, event(4, "C", 60), event(0, "A", 5, "d"), event(0, "B", 6, "d")]).unionByName(broken), 1, at)
    running.update(spark.createDataFrame([], SCHEMA), 2, at)
    assert sorted((r.source, r.target, r.frequency) for r in running.edges(spark, at).collect()) == [("A", "B", 1), ("B", "C", 1)]
    assert running.late_events(spark, at).head().late == len(late) + 3


def test_a_stream_in_files(spark, tmp_path):
    rows, at = drawn(5, cases=12), str(tmp_path / "counts")
    for part in split(rows, 5, 3):
        frame(spark, part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in")) if part else None
        stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
        running.follow(stream, at, str(tmp_path / "state")).awaitTermination(120)
    assert {(r.source, r.target): r.frequency for r in running.edges(spark, at).collect()} == {k: len(v) for k, v in hops(rows).items()}


def test_outputs_are_read_again_only_when_rewritten(spark, tmp_path):
    path, held = str(tmp_path / "edges.csv"), Outputs(spark, most=2)
    write = lambda n: spark.range(n).select("id", F.lit("x").alias("name")).write.mode("overwrite").option("header", True).csv(path)
    with pytest.raises(FileNotFoundError):
        held.table(path)
    write(3)
    first = held.table(path, "id bigint, name string")
    assert first.count() == 3 and held.table(path, "id bigint, name string") is first and first.storageLevel.useMemory
    write(5)
    again = held.table(path, "id bigint, name string")
    assert again is not first and again.count() == 5
    store.write_text(spark, '{"a": 1}', str(tmp_path / "r.json"))
    report = held.json(str(tmp_path / "r.json"))
    assert report == {"a": 1} and held.json(str(tmp_path / "r.json")) is report
    store.write_text(spark, '{"a": 22}', str(tmp_path / "r.json"))
    assert held.json(str(tmp_path / "r.json")) == {"a": 22}
    assert held.text(str(tmp_path / "r.json")) == '{"a": 22}' and not again.storageLevel.useMemory  # the third output
    held.clear()
