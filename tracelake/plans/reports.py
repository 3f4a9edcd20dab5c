"""Reports as Markdown, run summaries as text, and the files that a discovery or a diagnosis leaves behind."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.functions.written import written
from tracelake.operators import conformance, dfg, miner, normalize, timing, variants
from tracelake.plans import views
from tracelake.plans.views import lifecycle_label, lifecycle_note, plain
from tracelake.sources import store

TOP = 5
KIND_LABELS = {
    "uniformly_slow": "slow as a rule", "slow_and_variable": "slow, and varying much", "high_variance": "varying much",
    "not_flagged": "not flagged", "insufficient_data": "too rare to judge",
}


def days(seconds: float) -> str:
    """A span in a report: hours up to two days, then days."""
    return f"{seconds / 86400:.1f} days" if seconds >= 2 * 86400 else f"{seconds / 3600:.1f} hours"


def case_days(seconds: float) -> str:
    """A sum of spans over cases."""
    return f"{seconds / 86400:,.0f} case-days" if seconds >= 2 * 86400 else f"{seconds / 3600:,.1f} case-hours"


def short(seconds: float) -> str:
    """A span in a run summary, in the largest unit that it holds once."""
    for size, unit in ((86400, "d"), (3600, "h"), (60, "min")):
        if seconds >= size:
            return f"{seconds / size:.1f} {unit}"
    return f"{seconds:.1f} s"


def measure(value: float) -> str:
    return ">0.999" if value >= 0.9995 else f"{value:.3f}"


def counted(n: int, noun: str, many: str | None = None) -> str:
    return f"{n:,} {noun if n == 1 else many or noun + 's'}"


def table(head: list[str], rows: list[list]) -> list[str]:
    return ["| " + " | ".join(r) + " |" for r in [head, ["-"] * len(head), *[[str(x) for x in r] for r in rows]]]


def paragraph(title: str, *lines: str) -> list[str]:
    return [f"## {title}", "", *lines, ""]


def cut_short(variant: str, most: int = 8) -> str:
    steps = variant.split(variants.SEPARATOR)
    return variant if len(steps) <= most else variants.SEPARATOR.join([*steps[:most], f"… ({len(steps)} steps)"])


def discovery_summary(log: DataFrame, policy: str | None = None, threshold: float = 0.9, cases: DataFrame | None = None, tri: DataFrame | None = None) -> str:
    """What the log looks like: size, variants, cycle times, outcomes of the paths, map, model, caveats. cases: the log's
    case statistics, tri: its trigrams, where they are at hand."""
    with views.kept(variants.case_statistics(log) if cases is None else cases) as cases:
        o, top, mix = views.overview(log, policy, cases), views.top_variants(log, TOP, cases), plain(variants.outcome_mix(cases).orderBy(F.desc("cases"), "outcome"))
    tri = miner.trigrams(log) if tri is None else tri
    edges = miner.net(tri, threshold)
    net, drawn = plain(edges.orderBy("source", "target")), views.mermaid(log, tri=tri)
    kinds = {k: sum(e["kind"] == k for e in net) for k in miner.KINDS}
    pairs = {frozenset((e["source"], e["target"])) for e in net if e["kind"] == "length_two_loop"}
    alone = [r.activity for r in miner.orphans(miner.nodes(tri), edges).orderBy("activity").collect()]
    lines = ["# Discovery summary", "", f"Lifecycle: {lifecycle_label(policy)}. {counted(o['events'], 'event')} in {counted(o['cases'], 'case')}, {counted(o['activities'], 'activity', 'activities')}, {counted(o['transitions'], 'transition')}.", ""]
    spread = f"{counted(o['variants'], 'variant')}, of which {o['variants_needed']:,} hold 80 % of the cases; {o['singletons']:,} occur once. The most frequent one holds {o['top_share']:.1%}."
    rows = [[v["variant_rank"], f"{v['case_count']:,}", f"{v['case_share']:.1%}", f"{v['cumulative_share']:.1%}", v["length"], cut_short(v["variant"]), ", ".join(f"{x['outcome']} {x['cases']:,}" for x in v["outcomes"] or [])] for v in top]
    lines += paragraph("Variants", spread, "", *table(["rank", "cases", "share", "so far", "steps", "path", "outcomes"], rows))
    spans = [[name, f"{d['count']:,}", *[days(d[q]) for q in ("p50", "p90", "p99", "mean", "max")]] for name, d in (("all", o["cycle_time"]), ("most frequent path", o["happy_path"]), ("other paths", o["other_paths"])) if d]
    lines += paragraph("Cycle time", *table(["cases of", "cases", "p50", "p90", "p99", "mean", "longest"], spans))
    lines += paragraph("Outcomes", *table(["outcome", "cases", "share"], [[m["outcome"], f"{m['cases']:,}", f"{m['share']:.1%}"] for m in mix]))
    lines += paragraph("Map", f"{drawn['caption'][0].upper()}{drawn['caption'][1:]}.", "", "```mermaid", drawn["text"].rstrip("\n"), "```")
    model = [f"{counted(len(net), 'edge')} at a threshold of {threshold}: " + ", ".join(f"{n} {k.replace('_', ' ')}" for k, n in kinds.items()) + f". {counted(len(pairs), 'pair')} of activities loop by turns."]
    model += [f"Without an edge to another activity: {', '.join(alone)}."] if alone else []
    lines += paragraph("Model", *model, "", *table(["from", "to", "kind", "measure", "frequency"], [[e["source"], e["target"], e["kind"].replace("_", " "), measure(e["dependency"]), f"{e['frequency']:,}"] for e in net]))
    return "\n".join([*lines, *paragraph("Caveats", f"- {o['lifecycle']}", "- Measures near 1 come from many observations; rare behaviour may be missing from the model.")])


def diagnosis(log: DataFrame, reference: dict | None = None) -> dict:
    """The tables that a diagnosis consists of; see diagnostic_report. reference: the most frequent variant if none is
    given. What has a row for each case is written down, since several tables and texts are made of it."""
    cases = written(variants.named(variants.sequences(log)))
    reference = conformance.reference(log, "most_frequent_variant", cases=cases) if reference is None else reference
    replayed = written(conformance.replay(None, conformance.sequence_net(reference["activities"]), cases))
    return {"reference": reference, "cases": replayed, "summary": conformance.summary(replayed), "by_outcome": conformance.fitness_by_outcome(replayed, log), "bottlenecks": timing.bottlenecks(log), "rework_cases": written(timing.rework_cases(log)), "rework_activities": timing.rework_activities(log)}


def diagnostic_report(log: DataFrame, activities: list[str] | dict, policy: str | None = None, top: int = TOP, d: dict | None = None) -> str:
    """Does the log follow the reference, where does time go, and how much work is repeated? d: the diagnosis, where it is
    at hand."""
    if d is None:
        d = diagnosis(log, activities if isinstance(activities, dict) else conformance.reference(log, "documented", documented=activities))
    s, w = plain(d["summary"])[0], plain(timing.rework_totals(d["rework_cases"]))[0]
    marked = plain(d["bottlenecks"].orderBy(F.desc("total_seconds"), "source", "target"))  # pairs of activities
    kinds = {k: [b for b in marked if b["kind"] == k] for k in timing.KINDS}
    step = lambda b: f"{b['source']} → {b['target']}"
    name = variants.SEPARATOR.join(d["reference"]["activities"])
    costly, slow = marked[0], kinds["uniformly_slow"] + kinds["slow_and_variable"]
    lines = ["# Diagnosis", "", f"Lifecycle: {lifecycle_label(policy)}.", ""]
    lines += paragraph(
        "Answers",
        f"- Does the log follow the reference? {s['deviating_share']:.1%} of {counted(s['cases'], 'case')} deviate; log fitness {s['log_fitness']:.3f}, median case fitness {s['p50']:.3f}.",
        f"- Where does time go? {step(costly)} takes {costly['share_of_total_time']:.1%} of all waiting ({case_days(costly['total_seconds'])}); {counted(len(slow), 'transition')} of {len(marked):,} are slow.",
        f"- How much work is repeated? {counted(w['cases_with_rework'], 'case')} ({w['case_share']:.1%}) repeat work: {case_days(w['rework_seconds'])}, {w['time_share']:.1%} of all cycle time.",
    )
    of = plain(d["by_outcome"].orderBy(F.desc("cases"), "outcome"))
    lines += paragraph("Conformance", f"Reference: {name} ({d['reference']['description']}).", "", f"Case fitness: mean {s['mean']:.3f}, p10 {s['p10']:.3f}, p50 {s['p50']:.3f}, p90 {s['p90']:.3f}.", "", *table(["outcome", "cases", "mean fitness", "fitting"], [[x["outcome"], f"{x['cases']:,}", f"{x['mean_fitness']:.3f}", f"{x['fitting_cases']:,}"] for x in of]))
    lines += paragraph("Bottlenecks", *table(["kind", "transitions"], [[KIND_LABELS[k], f"{len(x):,}"] for k, x in kinds.items()]), "", *table(["from", "to", "waits", "p50", "p90", "total", "share", "kind"], [[b["source"], b["target"], f"{b['occurrences']:,}", days(b["p50_seconds"]), days(b["p90_seconds"]), case_days(b["total_seconds"]), f"{b['share_of_total_time']:.1%}", KIND_LABELS[b["kind"]]] for b in marked[:top]]))
    again = plain(d["rework_activities"].orderBy(F.desc("total_span_seconds"), "activity").limit(top))
    spread = f"Of the affected cases: median {days(w['p50'])}, p90 {days(w['p90'])}, mean {days(w['mean'])}."
    lines += paragraph("Rework", spread, "", *table(["activity", "cases", "repeats", "total span", "median span"], [[a["activity"], f"{a['cases_with_rework']:,}", f"{a['repeat_occurrences']:,}", case_days(a["total_span_seconds"]), days(a["median_span_seconds"])] for a in again]))
    return "\n".join([*lines, *paragraph("Caveats", f"- {lifecycle_note(policy)}", "- Activities that the reference lacks count as one token missing and one left over.", "- Spans of rework run from an activity's first to its last event in a case; what overlaps counts once.")])


def ingestion_report(marked: DataFrame, source: dict | None = None, policy: str = "start_else_complete") -> dict:
    """The account of a cleaned log: counts, exclusions by reason, lifecycle transitions, and what it was made from."""
    counts = plain(normalize.report(marked))[0]
    reasons = {r["reason"]: r["events"] for r in plain(normalize.exclusion_counts(marked).orderBy("position"))}
    seen = {r["lifecycle"]: r["events"] for r in plain(normalize.lifecycle_counts(marked).orderBy("lifecycle"))}
    return {"source": source or {}, "lifecycle_policy": policy, "normalization": counts | {"excluded_by_reason": reasons, "lifecycle_transitions": seen}}


def write_ingestion_report(marked: DataFrame, path: str, source: dict | None = None, policy: str = "start_else_complete") -> dict:
    report = ingestion_report(marked, source, policy)
    store.write_text(marked.sparkSession, json.dumps(report, sort_keys=True, indent=1) + "\n", path)
    return report


def recorded_policy(spark: SparkSession, path: str) -> str | None:
    """The lifecycle policy that an ingestion report names; None where it is missing or broken."""
    try:
        policy = json.loads(store.read_text(spark, path) or "")["lifecycle_policy"]
    except (ValueError, KeyError, TypeError):
        return None
    return policy if policy in normalize.POLICIES else None


def by_cost(found: DataFrame, cost: str, *names: str) -> DataFrame:
    return found.orderBy(F.desc(cost), *names)


#: The tables among a discovery's outputs, each made from a log, in the order of their files.
DISCOVERY = {
    "dfg_edges.csv": lambda log: dfg.by_frequency(dfg.edges(log)),
    "variants.csv": lambda log: variants.variants(log).orderBy("variant_rank"),
    "case_statistics.csv": lambda log: written(variants.case_statistics(log)).orderBy("case_id"),
}

#: The same of a diagnosis against the most frequent variant. Rows of all cases are written down before they are put in
#: order, for which they are looked at twice.
DIAGNOSIS = {
    "conformance_cases.csv": lambda log: written(conformance.replay_most_frequent(log)).orderBy("case_id"),
    "bottlenecks.csv": lambda log: by_cost(timing.bottlenecks(log), "total_seconds", "source", "target"),
    "rework_cases.csv": lambda log: written(timing.rework_cases(log)).orderBy("case_id"),
    "rework_activities.csv": lambda log: by_cost(timing.rework_activities(log), "total_span_seconds", "activity"),
}


def diagnosis_tables(d: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables of a diagnosis that is at hand, in the order of their files."""
    return {
        "conformance_cases.csv": d["cases"].orderBy("case_id"),
        "bottlenecks.csv": by_cost(d["bottlenecks"], "total_seconds", "source", "target"),
        "rework_cases.csv": d["rework_cases"].orderBy("case_id"),
        "rework_activities.csv": by_cost(d["rework_activities"], "total_span_seconds", "activity"),
    }


def write_discovery(log: DataFrame, at: str, policy: str | None = None, threshold: float = 0.9) -> list[str]:
    """The outputs of a discovery under a folder, one file each: edges, map, model, variants, cases, summary. Their paths
    are returned."""
    with views.kept(log) as log:
        spark = log.sparkSession
        cases, tri = written(variants.case_statistics(log)), miner.trigrams(log)
        for name in ("dfg_edges.csv", "variants.csv"):
            store.write_one_csv(DISCOVERY[name](log), f"{at}/{name}")
        store.write_one_csv(cases.orderBy("case_id"), f"{at}/case_statistics.csv")
        store.write_text(spark, views.mermaid(log, tri=tri)["text"], f"{at}/dfg.mmd")
        store.write_text(spark, views.heuristic_net_json(log, threshold, tri) + "\n", f"{at}/heuristic_net.json")
        store.write_text(spark, discovery_summary(log, policy, threshold, cases, tri), f"{at}/discovery_summary.md")
    return [f"{at}/{n}" for n in ("dfg_edges.csv", "dfg.mmd", "heuristic_net.json", "variants.csv", "case_statistics.csv", "discovery_summary.md")]


def write_diagnosis(log: DataFrame, reference: dict | None, at: str, policy: str | None = None) -> list[str]:
    """The outputs of a diagnosis under a folder, one file each: cases, summary, bottlenecks, rework by case and
    activity, report. reference: the most frequent variant if none is given."""
    with views.kept(log) as log:
        spark, d = log.sparkSession, diagnosis(log, reference)
        for name, found in diagnosis_tables(d).items():
            store.write_one_csv(found, f"{at}/{name}")
        summary = {"reference": d["reference"], "conformance": plain(d["summary"])[0], "rework": plain(timing.rework_totals(d["rework_cases"]))[0], "kinds": {r["kind"]: r["transitions"] for r in plain(timing.kind_counts(d["bottlenecks"]))}}
        store.write_text(spark, json.dumps(summary, sort_keys=True, indent=1) + "\n", f"{at}/conformance_summary.json")
        store.write_text(spark, diagnostic_report(log, d["reference"], policy, d=d), f"{at}/diagnostic_report.md")
    return [f"{at}/{n}" for n in ("conformance_cases.csv", "conformance_summary.json", "bottlenecks.csv", "rework_cases.csv", "rework_activities.csv", "diagnostic_report.md")]


def ingestion_summary(report: dict) -> str:
    n = report["normalization"]
    lines = [f"{counted(n['parsed_events'], 'event')} read, {n['normalized_events']:,} kept, {n['filtered_events']:,} filtered, {n['excluded_events']:,} excluded", f"{counted(n['normalized_cases'], 'case')} of {n['parsed_cases']:,} kept"]
    return "\n".join(lines + [f"  {reason.replace('_', ' ')}: {k:,}" for reason, k in n["excluded_by_reason"].items() if k])


def edges_summary(log: DataFrame, top: int = 10) -> str:
    rows = plain(dfg.by_frequency(dfg.edges(log)).limit(top))
    return "\n".join([counted(plain(dfg.totals(log))[0]["transitions"], "transition"), *[f"  {r['source']} -> {r['target']}: {r['frequency']:,}, median {short(r['median_duration_seconds'])}" for r in rows]])


def model_summary(log: DataFrame, threshold: float = 0.9) -> str:
    net = plain(miner.connected(log, threshold))
    return f"{counted(len(net), 'edge')} at {threshold}\n" + "\n".join(f"  {k.replace('_', ' ')}: {sum(e['kind'] == k for e in net)}" for k in miner.KINDS)


def discovery_run_summary(log: DataFrame) -> str:
    o = views.overview(log)
    return f"{counted(o['variants'], 'variant')}, {o['variants_needed']:,} for 80 % of the cases\nmedian cycle time {short(o['cycle_time']['p50'])}"


def diagnosis_run_summary(log: DataFrame, reference: dict) -> str:
    d = diagnosis(log, reference)
    s, w, b = plain(d["summary"])[0], plain(timing.rework_totals(d["rework_cases"]))[0], plain(d["bottlenecks"].orderBy(F.desc("total_seconds"), "source", "target").limit(1))[0]
    return f"log fitness {s['log_fitness']:.3f}, {s['fitting_cases']:,} of {counted(s['cases'], 'case')} fit\nmost costly: {b['source']} -> {b['target']}, {short(b['total_seconds'])}\nrework in {counted(w['cases_with_rework'], 'case')}"
