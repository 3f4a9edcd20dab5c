"""Directly-follows graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tracelake.functions.measures import micros, quantile_seconds, seconds, weighted_total
from tracelake.functions.quantiles import quantiles_of
from tracelake.functions.written import written

NEEDED = ("case_id", "event_index", "activity", "timestamp")


def in_case() -> WindowSpec:
    return Window.partitionBy("case_id").orderBy("event_index")


def require(log: DataFrame, columns: tuple[str, ...] = NEEDED) -> DataFrame:
    missing = [c for c in columns if c not in log.columns]
    if missing:
        raise ValueError(f"event log lacks columns: {', '.join(missing)}")
    return log


def occurrences(log: DataFrame) -> DataFrame:
    """source, target, case_id, micro: one row per pair of consecutive events of a case. One shuffle, by case."""
    paired = require(log).select("case_id", F.col("activity").alias("source"), F.lead("activity").over(in_case()).alias("target"), "timestamp", F.lead("timestamp").over(in_case()).alias("next"))
    return paired.where(F.col("next").isNotNull()).select("source", "target", "case_id", micros(F.col("timestamp"), F.col("next")).alias("micro"))


PAIR = ["source", "target"]


def counted_steps(log: DataFrame) -> DataFrame:
    """source, target, micro, n (occurrences), k (cases that have the pair here first): all that is told of pairs
    follows from these counts, which are written down, so the log is read once."""
    fresh = F.row_number().over(Window.partitionBy("case_id", *PAIR).orderBy("micro")) == 1  # in the case's partition
    return written(occurrences(log).withColumn("fresh", fresh.cast("int")).groupBy(*PAIR, "micro").agg(F.count("*").alias("n"), F.sum("fresh").alias("k")))


def edges(log: DataFrame) -> DataFrame:
    steps = counted_steps(log)
    found = steps.groupBy(*PAIR).agg(F.sum("n").alias("frequency"), F.sum("k").alias("case_frequency"), weighted_total(F.col("micro"), F.col("n")).alias("s"))
    joined = found.join(quantiles_of(steps, PAIR, "micro", "n", [0.5]), PAIR)
    return joined.select("source", "target", "frequency", "case_frequency", seconds(F.col("s").cast("double") / F.col("frequency")).alias("mean_duration_seconds"), quantile_seconds(F.get("_q", F.lit(0))).alias("median_duration_seconds"))


def by_frequency(edges: DataFrame) -> DataFrame:
    """Edges for an output: the most frequent first, then by name."""
    return edges.orderBy(F.desc("frequency"), "source", "target")


def frequency(log: DataFrame, source: str, target: str) -> int:
    """How often one activity directly follows another; 0 if never."""
    return frequencies(log).where((F.col("source") == source) & (F.col("target") == target)).agg(F.coalesce(F.sum("frequency"), F.lit(0))).head()[0]


def frequencies(log: DataFrame) -> DataFrame:
    """source, target, frequency alone: no distinct count and no percentile."""
    pairs = require(log).select(F.col("activity").alias("source"), F.lead("activity").over(in_case()).alias("target"))
    return pairs.where(F.col("target").isNotNull()).groupBy("source", "target").agg(F.count("*").alias("frequency"))


def end_counts(log: DataFrame, first: bool) -> DataFrame:
    pick = F.min_by if first else F.max_by
    cases = require(log).groupBy("case_id").agg(pick("activity", "event_index").alias("activity"))
    return cases.groupBy("activity").agg(F.count("*").alias("cases"))


def activity_counts(log: DataFrame) -> DataFrame:
    return require(log).groupBy("activity").agg(F.count("*").alias("events"))


def totals(log: DataFrame) -> DataFrame:
    """events, cases and transitions, which are their difference."""
    n = F.count("*")
    cases = F.count_distinct("case_id")
    return require(log).agg(n.alias("events"), cases.alias("cases"), (n - cases).alias("transitions"))


def handoffs(log: DataFrame) -> DataFrame:
    """Work passed from one resource to another between consecutive events of a case."""
    paired = require(log, ("case_id", "event_index", "resource")).select("case_id", F.col("resource").alias("giver"), F.lead("resource").over(in_case()).alias("taker"))
    passed = paired.where(F.col("giver").isNotNull() & F.col("taker").isNotNull() & (F.col("giver") != F.col("taker")))
    return passed.groupBy("giver", "taker").agg(F.count("*").alias("handoffs"), F.count_distinct("case_id").alias("cases"))


def bus_factor(log: DataFrame) -> DataFrame:
    """Per activity the resource that does most of it, and its share."""
    counts = require(log, ("activity", "resource")).where(F.col("resource").isNotNull()).groupBy("activity", "resource").agg(F.count("*").alias("n"))
    ranked = counts.withColumn("total", F.sum("n").over(Window.partitionBy("activity"))).withColumn("rank", F.row_number().over(Window.partitionBy("activity").orderBy(F.desc("n"), "resource")))
    return ranked.where("rank = 1").select("activity", "resource", F.col("n").alias("events"), F.round(F.col("n") / F.col("total"), 9).alias("share"))
