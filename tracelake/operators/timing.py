"""Bottlenecks and rework."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions.measures import dispersion, filled, micros, quantile_seconds, seconds, total, weighted_total
from tracelake.functions.quantiles import quantiles_of, with_quantiles
from tracelake.functions.written import written
from tracelake.operators import dfg

MIN_OCCURRENCES, SLOW_QUANTILE, DISPERSION = 30, 0.75, 0.5
NAMES = ["q1", "p50", "q3", "p90", "p99"]


def kind(n: Column, median: Column, spread: Column, slow: Column, least: int, most: float) -> Column:
    """What a transition's waits are like."""
    is_slow = (median >= slow) & (median > 0)
    varies = spread > F.lit(most)
    return F.when(n < least, "insufficient_data").when(is_slow & varies, "slow_and_variable").when(is_slow, "uniformly_slow").when(varies, "high_variance").otherwise("not_flagged")


KINDS = ["uniformly_slow", "slow_and_variable", "high_variance", "not_flagged", "insufficient_data"]


def waits(log: DataFrame) -> DataFrame:
    """Statistics of each transition's waits, in seconds; _s: their sum in microseconds."""
    steps = dfg.counted_steps(log)
    found = steps.groupBy(*dfg.PAIR).agg(F.sum("n").alias("occurrences"), F.sum("k").alias("cases"), weighted_total(F.col("micro"), F.col("n")).alias("_s"), F.max("micro").alias("_max"))
    found = found.join(quantiles_of(steps, dfg.PAIR, "micro", "n", [0.25, 0.5, 0.75, 0.9, 0.99]), dfg.PAIR)
    columns = [quantile_seconds(F.get("_q", F.lit(i))).alias(f"{n}_seconds") for i, n in enumerate(NAMES)]
    return found.select("source", "target", "occurrences", "cases", "_s", seconds(F.col("_s")).alias("total_seconds"), (F.col("_s").cast("double") / F.col("occurrences") / F.lit(1e6)).alias("mean_seconds"), *columns, seconds(F.col("_max")).alias("max_seconds"))


def slow_threshold(table: DataFrame, least: int = MIN_OCCURRENCES, quantile: float = SLOW_QUANTILE) -> DataFrame:
    """One row: the quantile of the medians of transitions with enough occurrences, or of all if none has enough."""
    q = lambda c: F.percentile(c, F.lit(quantile))
    return table.agg(F.round(F.coalesce(q(F.when(F.col("occurrences") >= least, F.col("p50_seconds"))), q(F.col("p50_seconds"))), 8).alias("slow_threshold_seconds"))


def bottlenecks(log: DataFrame, least: int = MIN_OCCURRENCES, quantile: float = SLOW_QUANTILE, most: float = DISPERSION, slow_seconds: float | None = None) -> DataFrame:
    """Transitions with their waits' statistics, share of all waiting time, dispersion and kind. A log without transitions
    makes the query fail: the threshold's one row then meets no transition, so no job has to look beforehand."""
    if not 0 < quantile < 1:
        raise ValueError(f"slow quantile must lie between 0 and 1, both excluded: {quantile}")
    table = waits(log)
    slow = slow_threshold(table, least, quantile) if slow_seconds is None else log.sparkSession.range(1).select(F.lit(float(slow_seconds)).alias("slow_threshold_seconds"))
    source = F.when(F.col("source").isNull() & F.col("target").isNull(), F.raise_error(F.lit("no transitions in the event log")).cast("string")).otherwise(F.col("source"))
    marked = slow.join(F.broadcast(table), how="left").withColumn("source", source).withColumn("dispersion", dispersion(F.col("q1_seconds"), F.col("q3_seconds")))  # pairs of activities
    share = F.coalesce(F.try_divide(F.col("_s").cast("double"), F.nullif(F.sum("_s").over(Window.partitionBy()).cast("double"), F.lit(0.0))), F.lit(0.0))
    marked = marked.withColumn("share_of_total_time", share).withColumn("kind", kind(F.col("occurrences"), F.col("p50_seconds"), F.col("dispersion"), F.col("slow_threshold_seconds"), least, most))
    return marked.select("source", "target", "occurrences", "cases", "total_seconds", "share_of_total_time", "mean_seconds", *[f"{n}_seconds" for n in NAMES], "max_seconds", "dispersion", "kind")


def of_kind(marked: DataFrame, wanted: str) -> DataFrame:
    """The transitions of one kind, the most costly first."""
    if wanted not in KINDS:
        raise ValueError(f"kind must be one of {', '.join(KINDS)}: {wanted}")
    return marked.where(F.col("kind") == wanted).orderBy(F.desc("total_seconds"), "source", "target")


def kind_counts(marked: DataFrame) -> DataFrame:
    """Transitions of every kind, zeros included."""
    every = marked.sparkSession.createDataFrame([(k,) for k in KINDS], "kind string")
    counts = marked.groupBy("kind").agg(F.count("*").alias("transitions"))
    return F.broadcast(every).join(counts, "kind", "left").select("kind", F.coalesce("transitions", F.lit(0)).cast("bigint").alias("transitions"))


def held(log: DataFrame) -> DataFrame:
    """case_id, activity, n, first, last of the activities of each case."""
    return dfg.require(log).groupBy("case_id", "activity").agg(F.count("*").alias("n"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last"))


def repeats(log: DataFrame) -> DataFrame:
    """held, of activities that a case holds twice or more."""
    return held(log).where("n > 1")


def rework_cases(log: DataFrame) -> DataFrame:
    """Per case: repeated events and activities, the length of the union of their spans, and its share of the cycle time.
    An empty log gives no rows here, and an error in rework_totals. The log is read once, into its cases' activities."""
    by_start = Window.partitionBy("case_id").orderBy("first", "last", "activity").rowsBetween(Window.unboundedPreceding, -1)
    again = lambda c: F.when(F.col("n") > 1, c)
    reached = F.max(again(F.col("last"))).over(by_start)
    fresh = F.greatest(micros(F.greatest("first", F.coalesce(reached, F.col("first"))), F.col("last")), F.lit(0))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    joined = held(log).withColumn("fresh", again(fresh)).groupBy("case_id").agg(
        zero(F.sum(again(F.col("n") - 1))).alias("rework_events"), F.count_if(F.col("n") > 1).alias("repeated_activities"),
        F.coalesce(total(F.col("fresh")), F.lit(0).cast("decimal(29,0)")).alias("_r"), micros(F.min("first"), F.max("last")).alias("_c"),
    )
    share = F.when(F.col("_c") == 0, F.lit(0.0)).otherwise(F.try_divide(F.col("_r").cast("double"), F.col("_c").cast("double")))
    return joined.select("case_id", "rework_events", "repeated_activities", seconds(F.col("_r")).alias("rework_seconds"), seconds(F.col("_c")).alias("cycle_time_seconds"), share.alias("rework_share_of_cycle_time"))


def rework_activities(log: DataFrame) -> DataFrame:
    """Per activity its repeats and their spans. Spans are counted by length and written down, so the log is read once."""
    spans = repeats(log).groupBy("activity", micros(F.col("first"), F.col("last")).alias("span")).agg(F.count("*").alias("k"), F.sum(F.col("n") - 1).alias("e"))
    spans = written(spans)
    found = spans.groupBy("activity").agg(F.sum("k").alias("cases_with_rework"), F.sum("e").alias("repeat_occurrences"), weighted_total(F.col("span"), F.col("k")).alias("_s"))
    joined = found.join(quantiles_of(spans, ["activity"], "span", "k", [0.5]), "activity")
    return joined.select("activity", "cases_with_rework", "repeat_occurrences", seconds(F.col("_s")).alias("total_span_seconds"), quantile_seconds(F.get("_q", F.lit(0))).alias("median_span_seconds"))


def rework_totals(cases: DataFrame) -> DataFrame:
    """One row over rework_cases: sums, shares, and the distribution among affected cases (zeros if there is none)."""
    micro = lambda c: F.round(F.col(c) * 1e6).cast("bigint")
    hit = F.col("rework_events") > 0
    r, c = total(micro("rework_seconds")), total(micro("cycle_time_seconds"))
    ratio = lambda x, y: F.coalesce(F.try_divide(x.cast("double"), F.nullif(y.cast("double"), F.lit(0.0))), F.lit(0.0))
    sums = cases.agg(
        F.count("*").alias("cases"), F.count_if(hit).alias("cases_with_rework"), F.sum("rework_events").alias("rework_events"), seconds(r).alias("rework_seconds"),
        seconds(c).alias("cycle_time_seconds"), ratio(r, c).alias("time_share"), ratio(F.count_if(hit), F.count("*")).alias("case_share"), ratio(seconds(r), F.count_if(hit)).alias("mean"),
    )
    spread = with_quantiles(cases.where(hit).select(micro("rework_seconds").alias("micro")), [], "micro", [0.5, 0.9, 0.99])
    q = lambda i, name: F.coalesce(quantile_seconds(F.get("_q", F.lit(i))), F.lit(0.0)).alias(name)
    both = sums.join(F.broadcast(spread))  # one row each
    both = both.withColumn("cases", filled(F.col("cases"), "empty event log"))
    return both.select("cases", "cases_with_rework", "rework_events", "rework_seconds", "cycle_time_seconds", "time_share", "case_share", q(0, "p50"), q(1, "p90"), q(2, "p99"), "mean")
