"""Variants, case statistics and distributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions.measures import SEPARATOR, filled, micros, quantile_seconds, seconds, weighted_total
from tracelake.functions.quantiles import quantiles_of
from tracelake.functions.written import written
from tracelake.operators import dfg

PARTS = 256  # variants are put in order in so many ranges


def in_order() -> Column:
    """The activities of a case, as an aggregate over its events."""
    return F.transform(F.array_sort(F.collect_list(F.struct("event_index", "activity"))), lambda e: e["activity"])


def named(cases: DataFrame) -> DataFrame:
    """cases with _k, a name of 128 bits for seq, to group and join by instead of the array itself."""
    return cases.withColumn("_k", F.struct(F.xxhash64("seq").alias("a"), F.xxhash64(F.lit(1), "seq").alias("b")))


def sequences(log: DataFrame) -> DataFrame:
    """case_id and seq, its activities in order. A case is one row, as long as the case is."""
    return dfg.require(log).groupBy("case_id").agg(in_order().alias("seq"))


def counted(cases: DataFrame) -> DataFrame:
    """_k, seq, variant, length, case_count, _known, _first of each variant, from named sequences; written down, so what
    follows from it does not read the log again. _known: its cases that have a name."""
    found = cases.groupBy("_k").agg(F.first("seq").alias("seq"), F.count("*").alias("case_count"), F.count("case_id").alias("_known"), F.min("case_id").alias("_first"))
    return written(found.withColumn("variant", F.array_join("seq", SEPARATOR)).withColumn("length", F.size("seq").cast("bigint")))


def place() -> Column:
    """What variants are ordered by: frequent ones first, then by their text, then by their first case."""
    return F.struct((-F.col("case_count")).alias("minus"), F.col("variant").alias("variant"), F.col("_first").alias("first"))


def ranked(found: DataFrame) -> DataFrame:
    """_k, seq and the variant's columns, from the log's counted variants. No task puts all variants in order: they are dealt to ranges that a sample of them
    bounds, numbered within each range, and offset by the ranges before it."""
    slots = found.groupBy(F.pmod(F.xxhash64("_k"), F.lit(PARTS)).alias("slot")).agg(F.min_by(place(), F.xxhash64("_k")).alias("at"))
    bounds = slots.agg(F.array_sort(F.collect_list("at")).alias("bounds"))  # PARTS entries at most
    dealt = found.withColumn("_bounds", bounds.scalar()).withColumn("_part", F.size(F.filter("_bounds", lambda b: b <= place()))).drop("_bounds")
    of = dealt.groupBy("_part").agg(F.count("*").alias("_n"), F.sum("case_count").alias("_c"))
    before = lambda c: F.coalesce(F.sum(c).over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = of.select("_part", before("_n").alias("_nb"), before("_c").alias("_cb"), F.sum("_c").over(Window.partitionBy()).alias("_total"))  # PARTS + 1 rows
    here = Window.partitionBy("_part").orderBy(F.desc("case_count"), "variant", "_first")
    numbered = dealt.withColumn("_i", F.row_number().over(here)).withColumn("_upto", F.sum("case_count").over(here.rowsBetween(Window.unboundedPreceding, 0)))
    joined = numbered.join(F.broadcast(offsets), "_part").withColumn("_upto", F.col("_upto") + F.col("_cb"))
    rank = (F.col("_i") + F.col("_nb")).cast("bigint").alias("variant_rank")
    return joined.select("_k", "seq", rank, "variant", "length", "case_count", (F.col("case_count") / F.col("_total")).alias("case_share"), (F.col("_upto") / F.col("_total")).alias("cumulative_share"), "_upto", "_total")


def variants(log: DataFrame) -> DataFrame:
    return ranked(counted(named(sequences(log)))).drop("_k", "seq", "_upto", "_total")


def top(log: DataFrame, limit: int, cases: DataFrame | None = None, found: DataFrame | None = None) -> DataFrame:
    """The first variants, the same columns; the others are counted, never put in order. seq: the activities.
    cases: the log's named sequences, found: its counted variants, where they are at hand."""
    found = counted(named(sequences(dfg.require(log))) if cases is None else cases) if found is None else found
    whole = found.agg(F.sum("_known").alias("_total"))
    order = [F.desc("case_count"), F.col("variant"), F.col("_first")]
    few = found.orderBy(*order).limit(limit).join(F.broadcast(whole))  # one row
    upto = F.sum("case_count").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))  # of `limit` rows
    return few.select(F.row_number().over(Window.orderBy(*order)).cast("bigint").alias("variant_rank"), "variant", "length", "case_count", (F.col("case_count") / F.col("_total")).alias("case_share"), (upto / F.col("_total")).alias("cumulative_share"), "seq", "_total")


def sequence(log: DataFrame, rank: int) -> list[str]:
    """The activities of the variant with a rank."""
    found = ranked(counted(named(sequences(log)))).where(F.col("variant_rank") == rank).select("seq").head() if rank >= 1 else None
    if found is None:
        raise ValueError(f"no variant has rank {rank}")
    return list(found.seq)


def coverage(log: DataFrame, share: float = 0.8, found: DataFrame | None = None) -> DataFrame:
    """How many of the most frequent variants hold that share of the cases; 0 for an empty log.

    Variants are counted by how frequent they are; of each such level as many are needed as it takes to fill the gap.
    found: the log's counted variants, where they are at hand.
    """
    if not 0 < share <= 1:
        raise ValueError(f"share must lie in (0, 1]: {share}")
    cases = named(sequences(log)).groupBy("_k").agg(F.count("*").alias("case_count")) if found is None else found
    levels = cases.groupBy("case_count").agg(F.count("*").alias("_n")).withColumn("_cases", F.col("_n") * F.col("case_count"))
    upto = F.sum("_cases").over(Window.orderBy(F.desc("case_count")).rowsBetween(Window.unboundedPreceding, 0))
    needed = F.ceil(F.round(F.lit(share) * F.sum("_cases").over(Window.partitionBy()), 9))
    gap = F.greatest(needed - (upto - F.col("_cases")), F.lit(0))
    used = levels.withColumn("_used", F.least(F.col("_n"), F.ceil(gap / F.col("case_count"))))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    return used.agg(zero(F.sum("_used")).alias("variants_needed"), zero(F.sum("_n")).alias("variants"), zero(F.sum(F.when(F.col("case_count") == 1, F.col("_n")))).alias("singletons"))


def case_statistics(log: DataFrame) -> DataFrame:
    """Per case: start, end, cycle time, events, variant, whether it is the most frequent one, outcome."""
    outcome = F.first("outcome", ignorenulls=True) if "outcome" in log.columns else F.lit(None).cast("string")
    cases = dfg.require(log).groupBy("case_id").agg(F.min("timestamp").alias("start_time"), F.max("timestamp").alias("end_time"), F.count("*").alias("activity_count"), in_order().alias("seq"), outcome.alias("outcome"))
    cases = written(named(cases))
    joined = cases.drop("seq").join(ranked(counted(cases)).select("_k", "variant_rank"), "_k")
    return joined.select("case_id", "start_time", "end_time", seconds(micros(F.col("start_time"), F.col("end_time"))).alias("cycle_time_seconds"), "activity_count", "variant_rank", (F.col("variant_rank") == 1).alias("is_happy_path"), "outcome")


def spans(log: DataFrame) -> DataFrame:
    """case_id, cycle_time_seconds."""
    return dfg.require(log).groupBy("case_id").agg(seconds(micros(F.min("timestamp"), F.max("timestamp"))).alias("cycle_time_seconds"))


def happy(cases: DataFrame) -> DataFrame:
    """One row: _k of the most frequent variant (ties: by its text, then by its first case), found without ranking the
    others. cases: case_id, _k and variant."""
    found = cases.groupBy("_k").agg(F.count("*").alias("case_count"), F.first("variant").alias("variant"), F.min("case_id").alias("_first"))
    return F.broadcast(found.orderBy(F.desc("case_count"), "variant", "_first").limit(1).select("_k"))


def happy_cases(log: DataFrame) -> DataFrame:
    """case_id of the cases that follow the most frequent variant. The cases are written down, so the log is read once."""
    cases = written(named(sequences(log)).select("case_id", "_k", F.array_join("seq", SEPARATOR).alias("variant")))
    return cases.join(happy(cases), "_k").select("case_id")


def case_spans(log: DataFrame) -> DataFrame:
    """case_id, cycle_time_seconds, is_happy_path: what a histogram needs, without ranks."""
    found = dfg.require(log).groupBy("case_id").agg(micros(F.min("timestamp"), F.max("timestamp")).alias("_m"), in_order().alias("seq"))
    cases = written(named(found).select("case_id", "_m", "_k", F.array_join("seq", SEPARATOR).alias("variant")))
    joined = cases.join(happy(cases).withColumn("_happy", F.lit(True)), "_k", "left")
    return joined.select("case_id", seconds(F.col("_m")).alias("cycle_time_seconds"), F.col("_happy").isNotNull().alias("is_happy_path"))


def distribution(values: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    """count, mean, min, p50, p90, p99, max of a column of seconds; nulls are dropped. Nothing at all makes the query
    fail, or has no rows where it is told by groups."""
    by = by or []
    known = values.where(F.col(column).isNotNull()).select(*by, column, F.round(F.col(column) * 1e6).cast("bigint").alias("_micro"))
    known = written(known.groupBy(*by, "_micro").agg(F.count("*").alias("_n"), F.min(column).alias("_min"), F.max(column).alias("_max")))  # values are computed once
    n = F.coalesce(F.sum("_n"), F.lit(0))
    sums = known.groupBy(*by).agg(n.alias("count"), seconds(weighted_total(F.col("_micro"), F.col("_n")).cast("double") / n).alias("mean"), F.min("_min").alias("min"), F.max("_max").alias("max"))
    spread = quantiles_of(known, by, "_micro", "_n", [0.5, 0.9, 0.99])
    both = sums.join(spread, by) if by else sums.join(F.broadcast(spread)).withColumn("count", filled(F.col("count"), "no values to summarize"))  # one row each
    q = lambda i, name: quantile_seconds(F.get("_q", F.lit(i))).alias(name)
    return both.select(*by, "count", "mean", "min", q(0, "p50"), q(1, "p90"), q(2, "p99"), "max")


def histogram(cases: DataFrame, bins: int = 30) -> DataFrame:
    """Cases by days of cycle time, happy path and others, with empty bins and an overflow bin past the 99th percentile.
    Cases are counted by cycle time once, and written; percentile and bins follow from the counts."""
    micro = F.round(F.col("cycle_time_seconds") * 1e6).cast("bigint")
    times = written(cases.groupBy(micro.alias("micro")).agg(F.count("*").alias("n"), F.count_if("is_happy_path").alias("happy")))
    longest = F.round(F.get("_q", F.lit(0)) / F.lit(86400e6), 6)
    width = quantiles_of(times, [], "micro", "n", [0.99]).select(F.greatest(F.lit(1), F.ceil(longest)).alias("upper"))
    width = width.withColumn("width", F.greatest(F.lit(1), F.ceil(F.col("upper") / bins))).withColumn("bins", F.ceil(F.col("upper") / F.col("width")))
    every = width.select(F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("bins"))).alias("bin"), "width", "bins")
    days = F.col("micro") / F.lit(1e6) / F.lit(86400)
    counts = times.join(F.broadcast(width)).select(F.least(F.floor(days / F.col("width")), F.col("bins")).alias("bin"), "n", "happy")  # one row
    counts = counts.groupBy("bin").agg(F.sum("happy").alias("happy"), F.sum(F.col("n") - F.col("happy")).alias("other"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return every.join(counts, "bin", "left").select("bin", (F.col("bin") * F.col("width")).cast("bigint").alias("from_days"), (F.col("bin") == F.col("bins")).alias("overflow"), zero("happy"), zero("other"))


def days_of(cases: DataFrame) -> DataFrame:
    """One row: p50, p90 and p99 of the cycle times in days, which a histogram is marked with."""
    return distribution(cases, "cycle_time_seconds").select(*[(F.col(q) / 86400).alias(f"{q}_days") for q in ("p50", "p90", "p99")])


def variant_outcomes(cases: DataFrame) -> DataFrame:
    return cases.groupBy("variant_rank", F.coalesce("outcome", F.lit("no_terminal_state")).alias("outcome")).agg(F.count("*").alias("cases"))


def outcomes_by_count(cases: DataFrame) -> DataFrame:
    """variant_rank and its outcomes with their cases as one list, the most frequent outcome first."""
    each = F.struct((-F.col("cases")).alias("minus"), "outcome", "cases")
    listed = variant_outcomes(cases).groupBy("variant_rank").agg(F.array_sort(F.collect_list(each)).alias("o"))
    return listed.select("variant_rank", F.transform("o", lambda x: F.struct(x["outcome"].alias("outcome"), x["cases"].alias("cases"))).alias("outcomes"))


def top_variant_by_outcome(cases: DataFrame) -> DataFrame:
    best = F.row_number().over(Window.partitionBy("outcome").orderBy(F.desc("cases"), "variant_rank"))
    return variant_outcomes(cases).withColumn("_n", best).where("_n = 1").drop("_n")


def outcome_mix(cases: DataFrame) -> DataFrame:
    counted = cases.groupBy(F.coalesce("outcome", F.lit("no_terminal_state")).alias("outcome")).agg(F.count("*").alias("cases"))
    return counted.select("outcome", "cases", (F.col("cases") / F.sum("cases").over(Window.partitionBy())).alias("share"))
