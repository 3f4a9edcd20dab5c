"""Cleaning, reports, map, automation scores and the network of resources: plain Python and answers worked out by hand."""

import json
import math
import random
from collections import Counter, defaultdict
from statistics import mean, pstdev

import pytest
from logs import by_case, drawn, frame, spelled

from tracelake.operators import automation, conformance, dfg, network, normalize, placing, timing
from tracelake.plans import layout, reports, views

RAW = "case_id string, event_index long, activity string, lifecycle string, timestamp string, resource string"
#: (row, what becomes of it)
PARCELS = [
    (("p7", 2, " weigh ", None, "2020-05-04T08:00:00Z", "scale"), "normalized"),
    (("p7", 5, "stamp", "Complete", "2020-05-04T07:59:59.999Z", "desk"), "out_of_order"),
    (("p7", 6, "stamp", "schedule", "2020-05-04T09:00:00Z", "desk"), "filtered"),
    (("p7", 9, "load", "", "2020-05-04T10:00:00+02:00", " "), "normalized"),  # 08:00 UTC: a tie is in order
    (("p7", 11, " ", None, "never", None), "missing_activity"),
    (("p7", 12, "load", None, "05/04/2020", None), "unparseable_timestamp"),
    (("p7", 13, "load", None, "\t", None), "missing_timestamp"),
    (("\n", 0, None, None, None, None), "missing_case_id"),
    (("p8", 0, "weigh", None, "2020-05-05T08:00:00Z", None), "duplicate_case_id"),
    (("p8", 3, "load", None, "2020-05-05T09:00:00Z", None), "duplicate_case_id"),
    (("p8", 3, "load", "schedule", "2020-05-05T09:00:00Z", None), "duplicate_case_id"),
    (("p9", 0, "weigh", None, "2020-05-06T08:00:00", "scale"), "normalized"),
    (("p9", 1, "load", None, "09:30", None), "unparseable_timestamp"),
]


def test_cleaning(spark):
    raw = spark.createDataFrame([r for r, _ in PARCELS], RAW)
    marked = normalize.classified(raw)
    got = sorted((repr(r.case_id), r.event_index, r.reason or r.status) for r in marked.collect())
    assert got == sorted((repr((c or "").strip() or None), i, what) for (c, i, *_), what in PARCELS)
    counts = Counter(what for _, what in PARCELS)
    assert {r.reason: r.events for r in normalize.exclusion_counts(marked).collect()} == {r: counts[r] for r in normalize.REASONS}
    r = normalize.report(marked).head()
    assert (r.parsed_events, r.normalized_events, r.filtered_events, r.excluded_events) == (13, 3, 1, 9) and r.missing_resource == 1
    assert [(x.activity, x.event_index) for x in normalize.normalized_events(raw).orderBy("case_id", "event_index").collect()] == [("weigh", 2), ("load", 9), ("weigh", 0)]


def test_lifecycles_and_outcomes(spark):
    """weigh is started somewhere, if only in a row that is of no use; so everywhere its starts count."""
    rows = [("a", 0, "weigh", "start"), ("a", 1, "weigh", "complete"), ("a", 2, "load", "complete"), ("a", 3, "lost", "complete"), ("a", 4, "found", "complete"), ("b", 0, "weigh", "complete"), ("b", 1, "load", "schedule"), ("b", 2, "lost", "complete"), ("c", 0, "load", None)]
    raw = spark.createDataFrame([(c, i, x, y, f"2020-01-01T{i:02d}:00:00Z", None) for c, i, x, y in rows], RAW)
    kept = lambda policy: sorted((r.case_id, r.event_index) for r in normalize.normalized_events(raw, policy).collect())
    assert kept("all") == sorted((c, i) for c, i, *_ in rows)
    assert kept("complete") == [("a", 1), ("a", 2), ("a", 3), ("a", 4), ("b", 0), ("b", 2), ("c", 0)]
    assert kept("start_else_complete") == [("a", 0), ("a", 2), ("a", 3), ("a", 4), ("b", 2), ("c", 0)]
    log = normalize.normalized_events(raw, outcomes={"lost": "missing", "found": "there"})
    assert {r.case_id: r.outcome for r in conformance.case_outcomes(log).collect()} == {"a": "there", "b": "missing", "c": None} and log.columns == normalize.LOG
    assert {r.outcome: r.cases for r in normalize.outcome_counts(log).collect()} == {"there": 1, "missing": 1, "no_terminal_state": 1}
    with pytest.raises(ValueError):
        normalize.classified(raw, "some")


def plain_places(names, starts, edges):
    layer, wave = {a: 0 for a in names if a in starts}, [a for a in names if a in starts]
    while wave:
        wave = [t for t in names if t not in layer and any((s, t) in edges for s in wave)]
        layer |= dict.fromkeys(wave, max(layer.values()) + 1)
    layer |= dict.fromkeys(set(names) - set(layer), max(layer.values(), default=-1) + 1)
    rows = [sorted(a for a in names if layer[a] == n) for n in range(max(layer.values()) + 1)]
    for turn in range(4):
        order = range(len(rows)) if turn % 2 == 0 else reversed(range(len(rows)))
        for n in order:
            m = n - 1 if turn % 2 == 0 else n + 1
            beside = rows[m] if 0 <= m < len(rows) else []
            at = {}
            for i, a in enumerate(rows[n]):
                near = [j for j, b in enumerate(beside) if (a, b) in edges or (b, a) in edges]
                at[a] = (sum(near) / len(near) if near else i, i)
            rows[n].sort(key=at.get)
    return {a: (n, i, 210.0 * n, 64 * (i - (len(row) - 1) / 2)) for n, row in enumerate(rows) for i, a in enumerate(row)}


def tables(spark, names, starts, edges):
    return spark.createDataFrame([(a, int(a in starts)) for a in names], "activity string, starts int"), spark.createDataFrame([(*e, 1) for e in edges], "source string, target string, frequency int")


@pytest.mark.parametrize("seed", range(4))
def test_places(spark, seed):
    draw = random.Random(seed)
    names = [f"n{i:02d}" for i in range(4 + 5 * seed)]
    edges = {(draw.choice(names), draw.choice(names)) for _ in range(3 * len(names) // 2)}
    starts = set(draw.sample(names, seed))
    nodes, lines = tables(spark, names, starts, edges)
    placed = placing.places(nodes, lines).persist()
    got = {r.activity: (r.layer, r.order, r.x, r.y) for r in placed.collect()}
    assert got == plain_places(names, starts, edges)
    lines_at = {(got[s][0], got[s][1], got[t][1]) for s, t in edges if got[t][0] == got[s][0] + 1}
    crossed = sum(a[0] == b[0] and a[1] < b[1] and a[2] > b[2] for a in lines_at for b in lines_at)
    assert placing.crossings(placed, lines.unionByName(lines).union(spark.createDataFrame([(names[0], "gone", 1)], lines.schema))).head().crossings == crossed
    placed.unpersist()


def test_map_text(spark):
    nodes, lines = tables(spark, [], set(), set())
    assert placing.places(nodes, lines).count() == 0
    m = layout.mermaid([("u", "v", 25), ("v", "w", 100), ("w", "u", 4), ("w", "w", 1)], 2)
    assert (m["edges"], m["edges_shown"], m["transitions_shown"], m["transitions"]) == (4, 2, 125, 130)
    assert m["text"].splitlines() == ["flowchart LR", '    n0["u"]', '    n1["v"]', '    n2["w"]', '    n1 -->|"100"| n2', '    n0 -->|"25"| n1', "    linkStyle 0 stroke-width:8.0px", "    linkStyle 1 stroke-width:4.5px"]
    assert '|"1,234"|' in layout.mermaid([("a", "b", 1234)])["text"] and 'n0["a<br/>5"]' in layout.mermaid([("a", "b", 1)], counts={"a": 5})["text"]
    assert layout.stroke(0, 0) == 1.0 and layout.escaped('1 < 2 > "0"') == "1 #lt; 2 #gt; #quot;0#quot;"
    with pytest.raises(ValueError):
        layout.mermaid([], 0)


def plain_scores(rows, weights):
    cases = by_case(rows)
    paths = Counter(tuple(a for a, _ in e) for e in cases.values())
    best = min(paths, key=lambda p: (-paths[p], " > ".join(p), min(c for c, e in cases.items() if tuple(a for a, _ in e) == p)))
    facts = defaultdict(lambda: {"before": Counter(), "after": Counter(), "gaps": [], "bad": 0})
    for events in cases.values():
        path = tuple(a for a, _ in events)
        for i, (a, t) in enumerate(events):
            f = facts[a]
            f["before"][path[i - 1] if i else None] += 1
            f["after"][path[i + 1] if i + 1 < len(path) else None] += 1
            f["gaps"] += [events[i + 1][1] - t] if i + 1 < len(path) else []
            looped = any(path[: i + 1].count(b) and path[i:].count(b) and path.count(b) > 1 for b in set(path))
            f["bad"] += looped or path != best
    even, most = math.log2(len(facts) + 1), max(f["before"].total() for f in facts.values())
    bits = lambda c: sum(n / c.total() * -math.log2(n / c.total()) for n in c.values())
    out = {}
    for a, f in facts.items():
        n, gap = f["before"].total(), mean(f["gaps"]) if f["gaps"] else 0
        cv = pstdev(f["gaps"]) / gap if gap else 0
        parts = (math.log1p(n) / math.log1p(most), 1 - bits(f["before"]) / even, (1 - bits(f["after"]) / even) / 2 + 0.5 / (1 + cv), 1 - f["bad"] / n)
        out[a] = [*parts, sum(w * x for w, x in zip(weights, parts))]
    return out


@pytest.mark.parametrize(("seed", "weights"), [(1, (0.3, 0.25, 0.25, 0.2)), (4, (0.1, 0.2, 0.3, 0.4))])
def test_automation(spark, seed, weights):
    rows = drawn(seed, 90, "HIJ", 4)
    names = ("volume", "repetitiveness", "rule_clarity", "regularity")
    got = automation.scores(frame(spark, rows), dict(zip(names, weights))).collect()
    want = plain_scores(rows, weights)
    assert {r.activity: [*[r[c] for c in names], r.score] for r in got} == {a: pytest.approx(v, abs=1e-6) for a, v in want.items()}
    assert [r.activity for r in sorted(got, key=lambda r: r["rank"])] == sorted(want, key=lambda a: (-round(want[a][-1], 6), a))
    for bad in ({"volume": 1.0}, dict(zip(names, (0.5, 0.5, 0.5, -0.5))), dict(zip(names, (1, 1, 1, 1)))):
        with pytest.raises(ValueError):
            automation.scores(frame(spark, rows), bad)


def test_business_case(spark):
    log = frame(spark, drawn(3, 200, "HIJK", 6))
    best = {r.activity: r for r in automation.scores(log).collect()}
    times = [t for _, _, _, t, *_ in drawn(3, 200, "HIJK", 6)]
    months = max(1.0, (max(times) - min(times)) / (86400 * 365.25 / 12))
    rows = automation.business_case(log, [0.5, 1.0], [-0.2, 0.3], [10.0, 4000.0], candidates=2).collect()
    assert len(rows) == 16 and {best[r.activity]["rank"] for r in rows} == {1, 2}
    for r in rows:
        left, worth, paid = r.cost, -r.cost, None
        monthly = best[r.activity].events / months * best[r.activity].mean_seconds * 0.02 / 3600 * 45
        for m in range(1, 37):
            flow = monthly * r.adoption * (1 + r.growth) ** (m / 12)
            left, worth = left - flow, worth + flow / 1.08 ** (m / 12)
            paid = m if paid is None and left <= 0 else paid
        assert r.payback_months == paid and r.net_present_value == pytest.approx(worth, rel=1e-3, abs=0.05)
    told = {r.activity: r for r in automation.sensitivity(spark.createDataFrame(rows)).collect()}
    assert all(t.scenarios == 8 and t.least_value == min(r.net_present_value for r in rows if r.activity == a) for a, t in told.items())
    for bad in (([], [0.0], [1.0]), ([1.5], [0.0], [1.0]), ([1.0], [-1.0], [1.0]), ([1.0], [0.0], [-1.0]), ([0.5] * 200, [0.0] * 60, [1.0])):
        with pytest.raises(ValueError):
            automation.scenarios(log, *bad)


def plain_betweenness(edges, sources=None):
    """Over all pairs: distances and numbers of shortest paths by lengthening walks, then the share through each node."""
    nodes = sorted({x for e in edges for x in e})
    far, ways = {(a, a): 0 for a in nodes}, {(a, a): 1 for a in nodes}
    for d in range(1, len(nodes) + 1):
        new = Counter()
        for (s, v), n in ways.items():
            if far[s, v] == d - 1:
                for u, w in edges:
                    if u == v and (s, w) not in far:
                        new[s, w] += n
        for k, n in new.items():
            far[k], ways[k] = d, n
    through = dict.fromkeys(nodes, 0.0)
    for (s, t), d in far.items():
        for v in nodes:
            if (sources is None or s in sources) and v not in (s, t) and s != t and (s, v) in far and (v, t) in far and far[s, v] + far[v, t] == d:
                through[v] += ways[s, v] * ways[v, t] / ways[s, t]
    return through


@pytest.mark.parametrize(("seed", "bound"), [(1, 0), (2, 10**6), (3, 0)])
def test_betweenness(spark, monkeypatch, seed, bound):
    """Random directed graphs, on both sides of the bound of what is broadcast."""
    draw = random.Random(seed)
    n = 6 * seed + 4
    edges = {(f"r{a}", f"r{b}") for a, b in ((draw.randrange(n), draw.randrange(n)) for _ in range(2 * n)) if a != b}
    edges |= {("x1", "x2"), ("x2", "x3")} if seed == 2 else set()  # apart from all others
    monkeypatch.setattr(network, "BROADCAST_EDGES", bound)
    table = spark.createDataFrame([*edges, *edges, ("r1", "r1")], "giver string, taker string")
    got = {r.resource: r for r in network.betweenness(table).collect()}
    want = plain_betweenness(edges)
    assert {a: r.betweenness for a, r in got.items()} == {a: pytest.approx(b, abs=1e-6) for a, b in want.items()} and max(want.values()) > 0
    assert all(r.share == pytest.approx(r.betweenness / ((len(want) - 1) * (len(want) - 2)), abs=1e-8) for r in got.values())
    some = sorted(want)[:3]
    part = network.betweenness(table, sources=spark.createDataFrame([(a,) for a in some], "resource string"))
    assert {r.resource: r.betweenness for r in part.collect()} == {a: pytest.approx(b, abs=1e-6) for a, b in plain_betweenness(edges, some).items()}


def test_betweenness_of_little(spark):
    pair = spark.createDataFrame([("a", "b")], "giver string, taker string")
    assert {r.resource: (r.betweenness, r.share) for r in network.betweenness(pair).collect()} == {"a": (0, 0), "b": (0, 0)}
    assert network.betweenness(pair.limit(0)).count() == 0


def test_sparse_teams(spark):
    """ann and bo pass work at H-I only, but both meet others elsewhere; cy and di meet at two places."""
    cases = [("HI", "ann bo", 4), ("HI", "cy di", 6), ("JK", "di cy", 5), ("JK", "ann cy", 8), ("KJ", "bo di", 9), ("JK", "ann ann", 7)]
    rows = [(f"{w}{r}{k}", i, a, i, p, None) for w, r, n in cases for k in range(n) for i, (a, p) in enumerate(zip(w, r.split()))]
    log = frame(spark, rows)
    met = {("H", "I"): Counter({("ann", "bo"): 4, ("cy", "di"): 6}), ("J", "K"): Counter({("cy", "di"): 5, ("ann", "cy"): 8}), ("K", "J"): Counter({("bo", "di"): 9})}
    total = sum(c.total() for c in met.values())
    want = {}
    for at, pairs in met.items():
        others = [(p, n) for x, c in met.items() if x != at for p, n in c.items()]
        out = lambda r, o=others: sum(n for p, n in o if r in p)
        for (x, y), n in pairs.items():
            hoped = out(x) * out(y) / (2 * (total - pairs.total()))
            if pairs.total() >= 0.2 * total and all((x, y) not in c for o, c in met.items() if o != at) and hoped >= 1:
                want[(*at, x, y)] = (n, round(hoped, 9))
    got = {(r.source, r.target, r.a, r.b): (r.meetings, r.expected_elsewhere) for r in network.sparse_teams(log, 0.2).collect()}
    assert got == want and ("H", "I", "ann", "bo") in want and ("H", "I", "cy", "di") not in want
    shares = {(r.source, r.target): (r.pairs, r.sparse) for r in network.team_sparsity(log, 0.2).collect()}
    assert shares == {at: (len(c), sum(k[:2] == at for k in want)) for at, c in met.items() if c.total() >= 0.2 * total}
    assert network.sparse_teams(log, 0.2, 1000.0).count() == 0
    with pytest.raises(ValueError):
        network.sparse_teams(log, 2.0)


def test_reports(spark, tmp_path):
    rows = drawn(7, 50, "HIJKL", 6)
    log, cases = frame(spark, rows), by_case(rows)
    text = reports.discovery_summary(log, "complete")
    for part in (f"{len(rows):,} events in 50 cases, 5 activities, {len(rows) - 50} transitions.", "Lifecycle: completions only.", "## Cycle time", "## Outcomes", "| kept |", "```mermaid", "## Caveats"):
        assert part in text, part
    text = reports.diagnostic_report(log, list("HIJ"), "all")
    again = sum(len({a for a, _ in e}) < len(e) for e in cases.values())
    off = sum([a for a, _ in e] != list("HIJ") for e in cases.values())
    for part in (f"{off / 50:.1%} of 50 cases deviate", f"{again} cases ({again / 50:.1%}) repeat work", "too rare to judge | ", "## Rework"):
        assert part in text, part
    nodes = views.process_map(log)["nodes"]
    assert len(nodes) == 5 and [(n["layer"], n["order"]) for n in nodes] == sorted((n["layer"], n["order"]) for n in nodes)
    assert len(views.top_variants(log, 3)) == 3 and views.overview(log)["cases"] == 50
    assert [views.lifecycle_label(p) for p in ("all", None)] == ["all transitions", "not recorded"] and "not recorded" in views.lifecycle_note("x")
    assert [reports.measure(x) for x in (0.9996, 0.9994, 0.25)] == [">0.999", "0.999", "0.250"]
    assert [reports.short(x) for x in (7, 150, 5400, 432000)] == ["7.0 s", "2.5 min", "1.5 h", "5.0 d"] and reports.days(180000) == "2.1 days" and reports.case_days(86400 * 4321) == "4,321 case-days"
    assert [reports.counted(n, "box", "boxes") for n in (1, 3)] == ["1 box", "3 boxes"]
    reference = conformance.reference(log, "most_frequent_variant")
    assert "log fitness" in reports.diagnosis_run_summary(log, reference) and "median" in reports.edges_summary(log)
    assert "for 80 % of the cases" in reports.discovery_run_summary(log) and "causal: " in reports.model_summary(log)


def test_report_files(spark, tmp_path):
    at = str(tmp_path / "report.json")
    assert reports.recorded_policy(spark, at) is None
    told = reports.write_ingestion_report(normalize.classified(spark.createDataFrame([r for r, _ in PARCELS], RAW)), at)
    assert "9 excluded" in reports.ingestion_summary(told) and reports.recorded_policy(spark, at) == "start_else_complete"
    (tmp_path / "broken.json").write_text("{")
    assert reports.recorded_policy(spark, str(tmp_path / "broken.json")) is None
    log = frame(spark, spelled([("HIJ", 3), ("HJ", 1)]))
    paths = reports.write_diagnosis(log, conformance.reference(log, "most_frequent_variant"), str(tmp_path / "d"))
    assert len(paths) == 6
    summary = json.loads((tmp_path / "d" / "conformance_summary.json").read_text())
    assert summary["kinds"]["insufficient_data"] == 3 and summary["conformance"]["fitting_cases"] == 3 and summary["reference"]["activities"] == list("HIJ")
    assert timing.of_kind(timing.bottlenecks(log), "insufficient_data").count() == 3 and dfg.totals(log).head().events == 11
