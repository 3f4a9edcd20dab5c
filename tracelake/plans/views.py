"""What a dashboard shows, as plain values: small aggregates of a log, collected once."""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.operators import dfg, miner, placing, variants
from tracelake.plans import layout

#: Of each lifecycle policy: its name in reports, and what follows from it for the figures.
LIFECYCLES = {
    "all": ("all transitions", "A piece of work that was scheduled, started and completed makes three events here: counts, loops and variants are larger than the number of work steps."),
    "complete": ("completions only", "A step's time is the time it ended, so the wait before it and the work on it are one figure."),
    "start_else_complete": ("starts, else completions", "Steps with recorded starts stand at their start and all others at their end, so a span between two steps may or may not hold the work on them."),
}


def lifecycle_label(policy: str | None) -> str:
    return LIFECYCLES.get(policy or "", ("not recorded", ""))[0]


def lifecycle_note(policy: str | None) -> str:
    return LIFECYCLES.get(policy or "", ("", "It is not recorded which lifecycle transitions this log holds; read spans with care."))[1]


def plain(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


def overview_row(log: DataFrame) -> DataFrame:
    """One row: events, cases, transitions, activities, variants, coverage, share of the most frequent variant."""
    counts, activities = dfg.totals(log), log.agg(F.count_distinct("activity").alias("activities"))
    found = variants.counted(variants.named(variants.sequences(log)))
    top = variants.top(log, 1, found=found).select(F.col("case_share").alias("top_share"))
    return counts.join(activities).join(variants.coverage(log, found=found)).join(top, how="left")  # one row each


@contextmanager
def kept(df: DataFrame) -> Iterator[DataFrame]:
    """df, computed once for all that reads it here."""
    stored = df.persist()
    try:
        yield stored
    finally:
        stored.unpersist()


def overview(log: DataFrame, policy: str | None = None, cases: DataFrame | None = None) -> dict:
    """Headline counts, coverage and cycle-time distributions. cases: the log's case statistics, where they are at hand."""
    cases = variants.case_statistics(log) if cases is None else cases
    split = {str(r["is_happy_path"]): r for r in plain(variants.distribution(cases, "cycle_time_seconds", ["is_happy_path"]))}
    return plain(overview_row(log))[0] | {
        "cycle_time": plain(variants.distribution(cases, "cycle_time_seconds"))[0], "happy_path": split.get("True"), "other_paths": split.get("False"),
        "lifecycle_label": lifecycle_label(policy), "lifecycle": lifecycle_note(policy),
    }


def map_nodes(log: DataFrame) -> DataFrame:
    """activity, events, starts, ends: zero where an activity starts or ends no case."""
    return miner.nodes(miner.trigrams(log))


def placed(tri: DataFrame, edges: DataFrame) -> DataFrame:
    """The nodes of a map with counts and places. tri: the log's trigrams."""
    nodes = miner.nodes(tri)
    return nodes.join(placing.places(nodes, edges), "activity")


def placed_nodes(log: DataFrame, threshold: float = 0.9) -> DataFrame:
    """The nodes of the process map with counts and places. Nodes and model follow from one reading of the log."""
    tri = miner.trigrams(log)
    return placed(tri, miner.net(tri, threshold))


def map_crossings(log: DataFrame, threshold: float = 0.9) -> DataFrame:
    """One row: crossings of the process map's edges, told from one reading of the log."""
    tri = miner.trigrams(log)
    edges = miner.net(tri, threshold)
    return placing.crossings(placed(tri, edges), edges)


def graph_nodes(log: DataFrame) -> DataFrame:
    """placed_nodes over all directly-follows edges."""
    tri = miner.trigrams(log)
    return placed(tri, miner.frequencies(tri))


def graph_crossings(log: DataFrame) -> DataFrame:
    """map_crossings over all directly-follows edges."""
    tri = miner.trigrams(log)
    edges = miner.frequencies(tri)
    return placing.crossings(placed(tri, edges), edges)


def process_map(log: DataFrame, threshold: float = 0.9) -> dict:
    """Nodes with places and counts, model edges with their timing."""
    times = dfg.edges(log).drop("frequency", "case_frequency")
    tri = miner.trigrams(log)
    edges = miner.net(tri, threshold)
    rows = plain(edges.join(times, ["source", "target"], "left").orderBy("source", "target"))
    return {"nodes": plain(placed(tri, edges).orderBy("layer", "order")), "edges": rows}


def top_variants(log: DataFrame, limit: int = 25, cases: DataFrame | None = None) -> list[dict]:
    """The most frequent variants with their outcomes, the most frequent outcome first."""
    if not 1 <= limit <= 200:
        raise ValueError(f"limit must lie between 1 and 200: {limit}")
    top = variants.top(log, limit).drop("seq", "_total")
    return plain(top.join(variants.outcomes_by_count(variants.case_statistics(log) if cases is None else cases), "variant_rank", "left").orderBy("variant_rank"))


def variant_model_gap(log: DataFrame, edges: DataFrame) -> DataFrame:
    """variant_rank and the number of its steps that are no edge of the model."""
    seqs = variants.counted(variants.named(variants.sequences(log)))
    ranked = variants.ranked(seqs).select("variant_rank", "_k")
    steps = seqs.select("_k", F.explode(F.filter(F.transform("seq", lambda x, i: F.struct(x.alias("source"), F.get("seq", i + 1).alias("target"))), lambda p: p["target"].isNotNull())).alias("p")).select("_k", "p.*")
    gone = steps.join(edges.select("source", "target").distinct(), ["source", "target"], "left_anti").groupBy("_k").agg(F.count("*").alias("missing"))
    return ranked.join(gone, "_k", "left").select("variant_rank", F.coalesce("missing", F.lit(0)).cast("bigint").alias("missing_steps"))


def heuristic_net_json(log: DataFrame, threshold: float = 0.9, tri: DataFrame | None = None) -> str:
    """tri: the log's trigrams, where they are at hand."""
    tri = miner.trigrams(log) if tri is None else tri
    edges = plain(miner.net(tri, threshold).orderBy("source", "target"))
    nodes = plain(miner.nodes(tri).orderBy("activity"))
    of = lambda value: {r["activity"]: r[value] for r in nodes if value == "events" or r[value]}
    net = {"threshold": threshold, "edges": edges, "activities": of("events"), "starts": of("starts"), "ends": of("ends"), "cases": plain(dfg.totals(log))[0]["cases"]}
    return json.dumps(net, sort_keys=True, indent=1)


def mermaid(log: DataFrame, max_edges: int = layout.MAX_EDGES, tri: DataFrame | None = None) -> dict:
    """The most frequent edges of the log as Mermaid text, with its caption. tri: the log's trigrams, where they are at hand."""
    tri = miner.trigrams(log) if tri is None else tri
    counts = {r.activity: r.events for r in miner.nodes(tri).collect()}
    return layout.mermaid([(r.source, r.target, r.frequency) for r in miner.frequencies(tri).collect()], max_edges, counts)


def mermaid_lines(log: DataFrame, max_edges: int = layout.MAX_EDGES) -> DataFrame:
    """line, text: the Mermaid text as a table."""
    return log.sparkSession.createDataFrame(list(enumerate(mermaid(log, max_edges)["text"].splitlines())), "line bigint, text string")
