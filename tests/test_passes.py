"""How often a log is read: each reading of a row is counted."""

import random

import numpy as np
import pytest
from logs import drawn, frame

from pyspark.sql import functions as F
from test_plans import plain_betweenness

from tracelake.operators import automation, conformance, miner, network, timing, variants
from tracelake.plans import adapters, catalog, reports, views
from tracelake.sources import store
from tracelake.streaming import running


@pytest.fixture
def readings(spark):
    """A log, and a function that tells how often its rows were read on average since."""
    rows = frame(spark, drawn(7)).collect()
    seen = spark.sparkContext.accumulator(0)

    def note(x):
        seen.add(1)
        return x

    log = spark.createDataFrame(rows, frame(spark, drawn(7)).schema).withColumn("case_id", F.udf(note, "string").asNondeterministic()("case_id"))
    return log, lambda: seen.value / len(rows)


def test_fulfilment_log_has_one_shuffle(spark):
    plan = adapters.fulfilment(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_slow_threshold(readings):
    log, times = readings
    timing.slow_threshold(timing.waits(log)).collect()
    assert times() == 1


@pytest.mark.parametrize("made", [views.map_crossings, views.placed_nodes, views.map_nodes, views.graph_nodes, views.graph_crossings, miner.connected, miner.model_edges, miner.orphans_of, miner.pairs, miner.two_loops])
def test_model_and_map(readings, made):
    log, times = readings
    made(log).collect()
    assert times() == 1


def cycle_days(log):
    return variants.days_of(variants.spans(log))


def model_gap(log):
    return views.variant_model_gap(log, log.select(F.col("activity").alias("source"), F.col("activity").alias("target")).limit(0))


@pytest.mark.parametrize("made", [variants.variants, variants.case_statistics, variants.case_spans, variants.coverage, cycle_days, model_gap, lambda log: variants.top(log, 3)])
def test_variants(readings, made):
    log, times = readings
    made(log).collect()
    assert times() == 1


def test_sequence(readings):
    log, times = readings
    variants.sequence(log, 2)
    assert times() == 1


@pytest.mark.parametrize("made", [timing.rework_cases, timing.rework_activities, timing.bottlenecks, network.team_sparsity, conformance.replay_most_frequent])
def test_diagnosed(readings, made):
    log, times = readings
    made(log).collect()
    assert times() == 1


def test_business_case(readings):
    """One reading for the contexts, one for the happy path."""
    log, times = readings
    automation.business_case(log, [0.5], [0.0], [100.0]).collect()
    assert times() == 2


@pytest.mark.parametrize("write", [reports.write_discovery, lambda log, at: reports.write_diagnosis(log, None, at)])
def test_outputs(readings, write, tmp_path):
    log, times = readings
    write(log, str(tmp_path / "o"))
    assert times() == 1


def test_running_update_reads_once(readings, tmp_path):
    log, times = readings
    running.update(log, 0, str(tmp_path / "c"))
    assert times() == 1


@pytest.mark.parametrize("name", ["stored_log", "running_edges"])
def test_log_is_made_once(spark, monkeypatch, name):
    """What the queries store in several steps is written once and read from there."""
    made, staged = [], store.staged
    monkeypatch.setattr(store, "staged", lambda df, at: made.append(at) or staged(df, at))
    assert catalog.queries()[name](spark, "/root/testdata/sf0.001").count() > 0 and len(made) == 1


@pytest.mark.parametrize("bound", [10**6, 40, 0])
def test_betweenness_by_components(spark, monkeypatch, bound):
    """Two dense components and a path: those within the bound need no waves of joined rows."""
    far, used = network.far, []
    monkeypatch.setattr(network, "NEAR", bound)
    monkeypatch.setattr(network, "far", lambda *given: used.append(1) or far(*given))
    draw = random.Random(5)
    edges = [(f"a{x}", f"a{y}") for x in range(60) for y in range(60) if x != y and draw.random() < 0.3]
    edges += [(f"b{x}", f"b{y}") for x in range(30) for y in range(30) if x != y and draw.random() < 0.2] + [(f"c{x}", f"c{x + 1}") for x in range(12)]
    got = {r.resource: r.betweenness for r in network.betweenness(spark.createDataFrame(edges, "giver string, taker string")).collect()}
    assert got == {a: pytest.approx(b, abs=1e-6) for a, b in plain_betweenness(edges).items()} and len(used) == (bound < 60)


@pytest.mark.parametrize("held", [2**25, 0])
def test_betweenness_keeps_no_row_per_pair(spark, monkeypatch, held):
    """Larger components: what is written has at most the edges' rows, or the share of the sources that go at a time."""
    kept, sizes = network.written, []

    def noted(df):
        made = kept(df)
        sizes.append(made.count())
        return made

    for name, value in {"written": noted, "NEAR": 8, "HELD": held, "AT_ONCE": 900, "CHEAP": 1, "PART": 64}.items():
        monkeypatch.setattr(network, name, value)
    draw = random.Random(6)
    edges = [(f"a{x}", f"a{y}") for x in range(60) for y in range(60) if x != y and draw.random() < 0.08]
    edges += [(f"b{x}", f"b{x + 1}") for x in range(12)] + [("c0", "c1"), ("c1", "c2")]
    got = {r.resource: r.betweenness for r in network.betweenness(spark.createDataFrame(edges, "giver string, taker string")).collect()}
    assert got == {a: pytest.approx(b, abs=1e-6) for a, b in plain_betweenness(edges).items()}
    assert max(sizes) <= (len(edges) if held else 60 * 60 / 2)


@pytest.mark.parametrize("seed", range(8))
def test_walks_by_chosen_and_by_all_edges(monkeypatch, seed):
    """Each way to sum over edges, a few edges and sources at a time, on random graphs."""
    draw = random.Random(seed)
    m = draw.randrange(2, 30)
    pairs = sorted({(x, y) for x, y in ((draw.randrange(m), draw.randrange(m)) for _ in range(4 * m)) if x != y} | {(0, 1)})
    first = np.searchsorted([x for x, _ in pairs], np.arange(m + 1))
    out = network.Edges(first, np.array([y for _, y in pairs], np.int32))
    want = plain_betweenness(pairs)
    for cheap, part in ((5, 2**20), (10**6, 64), (1, 3), (0.01, 64)):
        monkeypatch.setattr(network, "CHEAP", cheap)
        monkeypatch.setattr(network, "PART", part)
        got = sum(network.passed_on(out, out.back(), np.arange(a, min(m, a + 7))) for a in range(0, m, 7))
        assert {a: got[a] for a in want} == pytest.approx(want)
