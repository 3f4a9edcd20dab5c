"""Process-mining operators on random logs against plain Python, and on small logs with answers worked out by hand."""

import math
import random
from collections import Counter
from statistics import mean, median

import numpy as np
import pytest
from logs import by_case, drawn, frame, hops, spelled
from pyspark.sql import functions as F

from tracelake.functions.quantiles import with_quantiles
from tracelake.operators import conformance, dfg, miner, timing, variants


@pytest.mark.parametrize("seed", [1, 2])
def test_graph(spark, seed):
    rows = drawn(seed)
    log, cases = frame(spark, rows), by_case(rows)
    got = {(r.source, r.target): (r.frequency, r.case_frequency, round(r.mean_duration_seconds, 6), r.median_duration_seconds) for r in dfg.edges(log).collect()}
    assert got == {p: (len(x), len({c for c, _ in x}), round(mean(t for _, t in x), 6), median(t for _, t in x)) for p, x in hops(rows).items()}
    for first in (True, False):
        assert {r.activity: r.cases for r in dfg.end_counts(log, first).collect()} == Counter(e[0 if first else -1][0] for e in cases.values())
    assert dfg.totals(log).head().asDict() == {"events": len(rows), "cases": len(cases), "transitions": len(rows) - len(cases)}
    assert dfg.edges(log.where("event_index = 0")).count() == 0
    ranked = [(r.frequency, r.source, r.target) for r in dfg.by_frequency(dfg.edges(log)).collect()]
    assert ranked == sorted(ranked, key=lambda r: (-r[0], r[1], r[2]))
    assert dfg.frequency(log, "H", "I") == len(hops(rows).get(("H", "I"), [])) and dfg.frequency(log, "H", "nowhere") == 0
    for column in ("case_id", "event_index", "activity", "timestamp"):
        with pytest.raises(ValueError, match=column):
            dfg.edges(log.drop(column))


@pytest.mark.parametrize("threshold", [0.2, 0.6])
def test_relations(spark, threshold):
    rows = drawn(5, 40, "HIJKLMN", 5)
    seen = {p: len(x) for p, x in hops(rows).items()}
    names = sorted({r[2] for r in rows})
    want = {}
    for a in names:
        for b in set(names) - {a}:
            x, y = seen.get((a, b), 0), seen.get((b, a), 0)
            d = (x - y) / (x + y + 1)
            want[a, b] = (d, "#" if x + y == 0 else "->" if d >= threshold else "<-" if d <= -threshold else "||" if min(x, y) else "~")
    got = {(r.a, r.b): (r.dependency, r.relation) for r in miner.pairs(frame(spark, rows), threshold).collect()}
    assert got == want and len({r for _, r in want.values()}) >= 4
    strong = {(r.source, r.target): (r.dependency, r.frequency) for r in miner.causal_edges(frame(spark, rows), threshold).collect()}
    assert strong == {p: (d, seen[p]) for p, (d, _) in want.items() if d >= threshold}
    triples = Counter((x, y) for e in by_case(rows).values() for (x, _), (y, _), (z, _) in zip(e, e[1:], e[2:]) if x == z != y)
    assert {(r.a, r.b): r.occurrences for r in miner.aba_patterns(frame(spark, rows)).collect()} == triples


def test_thresholds(spark):
    log = frame(spark, spelled([("HI", 9)]))
    assert [r.dependency for r in miner.causal_edges(log, 0.9).collect()] == [0.9]  # nine times and never back: right on it
    for bad in (0, 1, -0.3, 1.7):
        with pytest.raises(ValueError):
            miner.causal_edges(log, bad)


def test_connections(spark):
    """K and L turn around each other, O leads to them, M ends; N stands beside them on a rare path, G and V on rarer ones."""
    log = frame(spark, spelled([("OKLKLM", 11), ("OKLM", 12), ("ONNM", 4), ("GV", 2)]))
    edges = {x.source + x.target: (x.kind, round(x.dependency, 6), x.frequency) for x in miner.model_edges(log).collect()}
    loop = round(22 / 23, 6)  # eleven times K L K, eleven times L K L
    assert edges == {"OK": ("causal", round(23 / 24, 6), 23), "LM": ("causal", round(23 / 24, 6), 23), "KL": ("length_two_loop", loop, 34), "LK": ("length_two_loop", loop, 11)}
    assert sorted(x.activity for x in miner.orphans(log, miner.model_edges(log)).collect()) == ["G", "N", "V"]
    added = {x.source + x.target: (x.kind, round(x.dependency, 6)) for x in miner.connected(log).collect()}
    # G starts and V ends a case: G needs a way out, V a way in, and the pair gives both; N asks for either
    assert added == {k: v[:2] for k, v in edges.items()} | {"ON": ("best_connection", 0.8), "NM": ("best_connection", 0.8), "GV": ("best_connection", round(2 / 3, 6))}
    assert not miner.orphans(log, miner.connected(log)).collect()
    loops = {x.source: x.dependency for x in miner.self_loops(frame(spark, spelled([("OTTTTM", 5), ("ONNM", 4)]))).collect()}
    assert loops == {"T": 15 / 16}


def test_variants(spark):
    rows = drawn(9, 400, "HIJ", 4)
    seen = Counter(" > ".join(a for a, _ in e) for e in by_case(rows).values())
    want, upto = [], 0
    for n, (variant, count) in enumerate(sorted(seen.items(), key=lambda x: (-x[1], x[0])), 1):
        upto += count
        want.append((n, variant, variant.count(">") + 1, count, upto))
    log = frame(spark, rows)
    got = [(r.variant_rank, r.variant, r.length, r.case_count, round(r.cumulative_share * 400)) for r in variants.variants(log).orderBy("variant_rank").collect()]
    assert got == want
    for share in (0.1, 0.5, 0.8, want[4][4] / 400, 1.0):
        assert variants.coverage(log, share).head().variants_needed == sum(u - c < math.ceil(round(share * 400, 9)) for *_, c, u in want)
    assert variants.coverage(log.limit(0)).head().variants_needed == 0
    for bad in (0, -1, 1.01):
        with pytest.raises(ValueError):
            variants.coverage(log, bad)
    stats = {r.case_id: (r.cycle_time_seconds, r.activity_count, r.is_happy_path, r.outcome) for r in variants.case_statistics(log).collect()}
    outcome = {r[0]: r[5] for r in rows}
    assert stats == {c: (e[-1][1] - e[0][1], len(e), " > ".join(a for a, _ in e) == want[0][1], outcome[c]) for c, e in by_case(rows).items()}


def test_distribution(spark):
    draw = random.Random(1)
    values = [draw.randrange(10**7) / 8 for _ in range(333)]
    row = variants.distribution(spark.createDataFrame([(v,) for v in [*values, None]], "x double"), "x").head()
    assert [row[c] for c in ("count", "min", "max")] == [333, min(values), max(values)] and row["mean"] == pytest.approx(mean(values))
    assert [row[c] for c in ("p50", "p90", "p99")] == pytest.approx(list(np.percentile(values, [50, 90, 99])))
    with pytest.raises(Exception, match="no values"):
        variants.distribution(spark.createDataFrame([], "x double"), "x").collect()


def fired(line, trace):
    """Token replay of a line of activities: produced, consumed, missing, remaining. A place holds tokens; an activity
    takes one from before it, made up where there is none, and puts one behind it. Of equal names the first that needs
    no made-up token fires, else the first. An activity that the line does not have costs one of each kind."""
    tokens = [1] + [0] * len(line)
    made_up = strangers = 0
    for a in trace:
        spots = [i for i, b in enumerate(line) if a == b]
        if not spots:
            strangers += 1
            continue
        i = next((i for i in spots if tokens[i]), spots[0])
        made_up += not tokens[i]
        tokens[i] -= bool(tokens[i])
        tokens[i + 1] += 1
    made_up += not tokens[-1]
    tokens[-1] -= bool(tokens[-1])
    return len(trace) + 1, len(trace) + 1, made_up + strangers, sum(tokens) + strangers


@pytest.mark.parametrize("line", ["HIJK", "HIHK", "H"])
def test_replay(spark, line):
    rows = drawn(len(line), 150, "HIJKZ", 8)
    log, net = frame(spark, rows), conformance.sequence_net(list(line))
    want = {c: fired(line, [a for a, _ in e]) for c, e in by_case(rows).items()}
    found = [conformance.replay(log, net)] + ([conformance.replay_sequence(log, list(line))] if len(set(line)) == len(line) else [])
    for df in found:
        got = {r.case_id: r for r in df.collect()}
        assert {c: (r.produced, r.consumed, r.missing, r.remaining) for c, r in got.items()} == want
        assert all(r.fitness == pytest.approx(1 - m / c / 2 - x / p / 2) and r.fits == (m + x == 0) for r, (p, c, m, x) in ((got[k], want[k]) for k in want))
    s = conformance.summary(found[0]).head()
    p, c, m, x = (sum(v) for v in zip(*want.values()))
    assert (s.cases, s.fitting_cases, s.log_fitness) == (150, sum(w[2] + w[3] == 0 for w in want.values()), pytest.approx(1 - m / c / 2 - x / p / 2))
    by_outcome = {r.outcome: (r.cases, r.mean_fitness) for r in conformance.fitness_by_outcome(found[0], log).collect()}
    assert set(by_outcome) == {"kept", "sold", "no terminal state"} and sum(n for n, _ in by_outcome.values()) == 150


def test_replay_errors(spark):
    log = frame(spark, spelled([("HI", 1)]))
    with pytest.raises(Exception, match="empty event log"):
        conformance.summary(conformance.replay(log.limit(0), conformance.sequence_net(["H"]))).collect()
    with pytest.raises(ValueError):
        conformance.replay_sequence(log, ["H", "H"])
    with pytest.raises(ValueError):
        conformance.sequence_net([])


def test_nets():
    """A choice: from `open` either `mail` or `call` leads to `done`."""
    mail, call = (conformance.Transition(i, a, ("open",), ("done",)) for i, a in (("m", "mail"), ("c", "call")))
    net = conformance.PetriNet(("open", "done"), (mail, call), {"open": 1}, {"done": 1})
    assert net.labels == ("mail", "call") and net.transitions_for("call") == (call,) or list(net.transitions_for("call")) == [call]
    assert not net.transitions_for("fax")
    wrong = {"no places": {"places": ()}, "a place twice": {"places": ("open", "done", "open")}, "an id twice": {"transitions": (mail, mail)}, "an arc to nowhere": {"places": ("open",)}, "no first token": {"initial": {}}, "a negative token": {"final": {"done": -2}}, "a token nowhere": {"final": {"gone": 1}}}
    for name, change in wrong.items():
        parts = {"places": ("open", "done"), "transitions": (mail, call), "initial": {"open": 1}, "final": {"done": 1}} | change
        with pytest.raises(ValueError):
            conformance.PetriNet(*parts.values())
            pytest.fail(name)


def test_references(spark):
    rows = [(f"{w}{k}", i, a, i, None, o) for w, n, o in (("HJ", 7, "sold"), ("HIJ", 5, "kept"), ("HIIJ", 3, "kept"), ("H", 9, None)) for k in range(n) for i, a in enumerate(w)]
    log = frame(spark, rows)
    of = conformance.reference(log, "most_frequent_variant")
    assert (of["activities"], of["supporting_cases"], of["eligible_cases"]) == (["H"], 9, 24)
    of = conformance.reference(log, "most_frequent_variant_for_outcome", "kept")
    assert (of["activities"], of["supporting_cases"], of["eligible_cases"]) == (["H", "I", "J"], 5, 8)
    assert conformance.reference(log, "documented", documented=["H", "J"])["activities"] == ["H", "J"]
    for wrong in (("most_frequent_variant_for_outcome", None), ("most_frequent_variant_for_outcome", "lost"), ("documented", None), ("guessed", None)):
        with pytest.raises(ValueError):
            conformance.reference(log, *wrong)


def plain_kind(waits, slow):
    q1, q2, q3 = np.percentile(waits, [25, 50, 75])
    varies = (q3 - q1) / (q3 + q1) > 0.5 if q1 + q3 else False
    if len(waits) < 30:
        return "insufficient_data"
    return ("slow_and_variable" if varies else "uniformly_slow") if q2 >= slow and q2 > 0 else "high_variance" if varies else "not_flagged"


def test_bottlenecks(spark):
    draw = random.Random(6)
    spreads = {"HI": lambda: 900, "IJ": lambda: draw.choice([10, 90_000]), "JK": lambda: draw.randrange(80_000, 90_000), "KL": lambda: draw.choice([60_000, 60_000, 900_000]), "LM": lambda: 0, "MN": lambda: draw.randrange(100)}
    rows = [(f"{p}{k}", i, a, t, None, None) for p, f in spreads.items() for k in range(12 if p == "MN" else 45) for w in [f()] for i, (a, t) in enumerate(((p[0], 0), (p[1], w)))]
    log, waits = frame(spark, rows), {p: [w for _, w in x] for p, x in hops(rows).items()}
    slow = np.percentile([np.median(w) for w in waits.values() if len(w) >= 30], 75)
    assert timing.slow_threshold(timing.waits(log)).head()[0] == slow
    every = sum(map(sum, waits.values()))
    for given in (None, 50_000.0):
        got = {(r.source, r.target): r for r in timing.bottlenecks(log, slow_seconds=given).collect()}
        assert {p: r.kind for p, r in got.items()} == {p: plain_kind(w, given or slow) for p, w in waits.items()}
        assert all((r.occurrences, r.total_seconds, r.max_seconds) == (len(waits[p]), sum(waits[p]), max(waits[p])) and r.share_of_total_time == pytest.approx(sum(waits[p]) / every) for p, r in got.items())
        assert all([r.q1_seconds, r.p50_seconds, r.q3_seconds, r.p90_seconds, r.p99_seconds] == pytest.approx(list(np.percentile(waits[p], [25, 50, 75, 90, 99]))) for p, r in got.items())
    kinds = {r.kind: r.transitions for r in timing.kind_counts(timing.bottlenecks(log)).collect()}
    assert kinds == {k: 0 for k in timing.KINDS} | Counter(plain_kind(w, slow) for w in waits.values())
    with pytest.raises(ValueError):
        timing.bottlenecks(log, quantile=1.0)
    with pytest.raises(Exception, match="no transitions"):
        timing.bottlenecks(log.where("event_index = 0")).collect()
    few = frame(spark, spelled([("HI", 3), ("IJ", 2)]))  # too rare to judge: then all of them make the threshold
    assert timing.slow_threshold(timing.waits(few)).head()[0] == 60


def covered(spans):
    """Seconds that lie in any of the spans, second by second's worth of border points."""
    points = sorted({p for s in spans for p in s})
    return sum(b - a for a, b in zip(points, points[1:]) if any(s <= a and b <= e for s, e in spans))


def test_rework(spark):
    rows = drawn(12, 80, "HIJK", 10)
    log, cases, activities = frame(spark, rows), {}, {}
    for c, events in by_case(rows).items():
        times = {}
        for a, t in events:
            times.setdefault(a, []).append(t)
        again = {a: t for a, t in times.items() if len(t) > 1}
        r, cycle = covered([(min(t), max(t)) for t in again.values()]), events[-1][1] - events[0][1]
        cases[c] = (sum(len(t) - 1 for t in again.values()), len(again), r, cycle, r / cycle if cycle else 0.0)
        for a, t in again.items():
            activities.setdefault(a, []).append((len(t) - 1, max(t) - min(t)))
    got = {r.case_id: tuple(r)[1:] for r in timing.rework_cases(log).collect()}
    assert got == {c: pytest.approx(v) for c, v in cases.items()}
    table = {r.activity: tuple(r)[1:] for r in timing.rework_activities(log).collect()}
    assert table == {a: (len(x), sum(n for n, _ in x), sum(s for _, s in x), median(s for _, s in x)) for a, x in activities.items()}
    t, hit = timing.rework_totals(timing.rework_cases(log)).head(), [v for v in cases.values() if v[0]]
    assert (t.cases, t.cases_with_rework, t.rework_events) == (80, len(hit), sum(v[0] for v in hit))
    assert [t.p50, t.p90, t.p99, t.mean, t.time_share] == pytest.approx([*np.percentile([v[2] for v in hit], [50, 90, 99]), mean(v[2] for v in hit), sum(v[2] for v in hit) / sum(v[3] for v in cases.values())])
    none = timing.rework_totals(timing.rework_cases(frame(spark, spelled([("HIJ", 2)])))).head()
    assert (none.cases_with_rework, none.rework_seconds, none.p50, none.mean) == (0, 0, 0, 0)
    with pytest.raises(Exception, match="empty event log"):
        timing.rework_totals(timing.rework_cases(log.limit(0))).collect()


def test_sums_beyond_a_bigint(spark):
    """Two spans of 290,000 years each: their microseconds together are more than 2**63."""
    rows = [(c, i, a, None, None) for c in ("c1", "c2") for i, a in enumerate("AB")]
    times = F.when(F.col("event_index") == 0, F.timestamp_micros(F.lit(0))).otherwise(F.timestamp_micros(F.lit(9_151_488_000_000_000_000)))
    log = spark.createDataFrame(rows, "case_id string, event_index long, activity string, resource string, outcome string").withColumn("timestamp", times)
    got = timing.bottlenecks(log).select("total_seconds", "share_of_total_time", "p50_seconds").collect()
    assert [tuple(r) for r in got] == [(2 * 9_151_488_000_000.0, 1.0, 9_151_488_000_000.0)]
    assert dfg.edges(log).head().mean_duration_seconds == 9_151_488_000_000.0
    cycles = variants.distribution(log.select(F.lit(9.0e12).alias("x")), "x").head()
    assert cycles["mean"] == 9.0e12 and cycles["p99"] == 9.0e12


def test_quantiles(spark):
    draw = random.Random(8)
    groups = {"small": [5], "ties": [7] * 50 + [9] * 3, "wide": [draw.randrange(10**12) for _ in range(400)], "signed": [draw.randrange(-1000, 1000) for _ in range(77)], "pair": [-3, 10**15]}
    rows = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in [*vs, None]], "g string, v long")
    shares = [0.0, 0.1, 0.5, 0.75, 0.99, 1.0]
    got = {r.g: r._q for r in with_quantiles(rows, ["g"], "v", shares).collect()}
    for g, values in groups.items():
        assert got[g] == pytest.approx([float(x) for x in np.quantile(values, shares)], rel=1e-12, abs=1e-9)
    whole = with_quantiles(rows, [], "v", [0.5]).collect()
    assert [r._q for r in whole] == [[pytest.approx(np.median([v for vs in groups.values() for v in vs]))]]
    assert with_quantiles(rows.limit(0), ["g"], "v", [0.5]).collect() == [] and with_quantiles(rows.limit(0), [], "v", [0.5]).head()._q == [None]


def test_ranks_over_many_variants(spark):
    """More variants than ranges: numbered without gaps, as one sort numbers them."""
    rows = drawn(2, 3000, "HIJK", 6)
    seen = Counter(" > ".join(a for a, _ in e) for e in by_case(rows).values())
    want = [(n, v, c) for n, (v, c) in enumerate(sorted(seen.items(), key=lambda x: (-x[1], x[0])), 1)]
    log = frame(spark, rows)
    assert [(r.variant_rank, r.variant, r.case_count) for r in variants.variants(log).orderBy("variant_rank").collect()] == want and len(want) > 300
    assert [(r.variant_rank, r.variant, r.case_count) for r in variants.top(log, 9).orderBy("variant_rank").collect()] == want[:9]
    assert variants.sequence(log, 4) == want[3][1].split(" > ")
    for wrong in (0, len(want) + 1):
        with pytest.raises(ValueError):
            variants.sequence(log, wrong)
    cover = variants.coverage(log).head()
    assert (cover.variants, cover.singletons) == (len(want), sum(c == 1 for *_, c in want))
