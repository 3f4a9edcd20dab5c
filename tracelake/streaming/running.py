"""Directly-follows counts that follow a stream of cleaned events.

What is stored is small beside the log: per case its last kept event, and per pair and wait in microseconds a count. A
micro-batch meets the last events of all cases in one shuffle by case. Each micro-batch makes one version, written aside
and named by one rename under the batch's number, so one that runs again after a crash changes nothing.

Cases: an event at or before its case's last stored place, or earlier than the latest kept time of its case, is late; it
is counted and takes no part, as out-of-order events are left out of a cleaned log. Of events at one place of a case in
one batch the first by time and activity stays. Events without case, place, activity or time count as late. An empty
batch makes a version like the one before; before the first batch there are no edges.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tracelake.functions.measures import micros, quantile_seconds, seconds, weighted_total
from tracelake.functions.quantiles import quantiles_of
from tracelake.operators.dfg import NEEDED, PAIR, require
from tracelake.sources import store
from tracelake.streaming.ingest import for_each_log

TAILS = "case_id string, event_index bigint, activity string, timestamp timestamp"
STEPS = "source string, target string, micro bigint, n bigint"
HELD = 2  # versions that stay


def _part(spark: SparkSession, at: str, version: int | None, name: str, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema) if version is None else spark.read.schema(schema).parquet(f"{at}/v={version}/{name}")


def _last(spark: SparkSession, at: str) -> int | None:
    return max(store.versions(spark, at), default=None)


def judged(batch: DataFrame, tails: DataFrame) -> DataFrame:
    """Events of a batch and the stored last events of all cases, with `late`, and `known` for the stored ones."""
    rows = require(batch).select(*NEEDED, F.lit(False).alias("known")).unionByName(tails.withColumn("known", F.lit(True)))
    before = Window.partitionBy("case_id").orderBy(F.desc("known"), "event_index", "timestamp", "activity").rowsBetween(Window.unboundedPreceding, -1)
    broken = F.greatest(*[F.col(c).isNull() for c in NEEDED])
    usable = F.when(~broken, F.struct("event_index", "timestamp"))
    late = broken | (F.col("event_index") <= F.max(usable["event_index"]).over(before)) | (F.col("timestamp") < F.max(usable["timestamp"]).over(before))
    return rows.withColumn("late", ~F.col("known") & F.coalesce(late, F.lit(False)))


def update(batch: DataFrame, number: int, at: str) -> None:
    """Add micro-batch `number` of cleaned events to the counts at `at`; nothing happens if it is in them already."""
    spark = batch.sparkSession
    last = _last(spark, at)
    if last is not None and last > number:
        return
    fs, aside = store._files(spark, f"{at}/_new_{uuid.uuid4().hex}")
    marked = judged(batch, _part(spark, at, last, "tails", TAILS))
    after = Window.partitionBy("case_id", "late").orderBy("event_index")
    follow = [F.when(~F.col("late"), F.lead(c).over(after)).alias(f"next_{c}") for c in ("activity", "timestamp")]
    marked.select(*NEEDED, "known", "late", *follow).write.parquet(f"{aside.toString()}/events")
    events = spark.read.parquet(f"{aside.toString()}/events")
    events.where(~F.col("late") & F.col("next_timestamp").isNull()).select(*NEEDED).write.parquet(f"{aside.toString()}/tails")
    found = events.where(F.col("next_timestamp").isNotNull()).select(F.col("activity").alias("source"), F.col("next_activity").alias("target"), micros(F.col("timestamp"), F.col("next_timestamp")).alias("micro"), F.lit(1).cast("bigint").alias("n"))
    steps = found.unionByName(_part(spark, at, last, "steps", STEPS)).groupBy(*PAIR, "micro").agg(F.sum("n").alias("n"))
    steps.write.parquet(f"{aside.toString()}/steps")
    late = events.where("late").agg(F.count("*").alias("late")).unionByName(_part(spark, at, last, "late", "late bigint")).agg(F.sum("late").alias("late"))
    late.write.parquet(f"{aside.toString()}/late")
    fs.delete(store._files(spark, f"{aside.toString()}/events")[1], True)
    if not fs.rename(aside, store._files(spark, f"{at}/v={number + 1}")[1]):
        raise OSError(f"batch {number} could not be named at {at}")
    for old in store.versions(spark, at)[:-HELD]:
        fs.delete(store._files(spark, f"{at}/v={old}")[1], True)


def edges(spark: SparkSession, at: str) -> DataFrame:
    """source, target, frequency, mean_duration_seconds, median_duration_seconds over all batches so far, exactly."""
    steps = _part(spark, at, _last(spark, at), "steps", STEPS)
    found = steps.groupBy(*PAIR).agg(F.sum("n").alias("frequency"), weighted_total(F.col("micro"), F.col("n")).alias("s"))
    joined = found.join(quantiles_of(steps, PAIR, "micro", "n", [0.5]), PAIR)
    return joined.select(*PAIR, "frequency", seconds(F.col("s").cast("double") / F.col("frequency")).alias("mean_duration_seconds"), quantile_seconds(F.get("_q", F.lit(0))).alias("median_duration_seconds"))


def late_events(spark: SparkSession, at: str) -> DataFrame:
    """One row: late, the events that came too late so far."""
    return _part(spark, at, _last(spark, at), "late", "late bigint").agg(F.coalesce(F.sum("late"), F.lit(0)).alias("late"))


def follow(log: DataFrame, at: str, checkpoint: str) -> StreamingQuery:
    """Keep the counts at `at` up to date with a stream of cleaned events."""
    return for_each_log(log, lambda batch, number: update(batch, number, at), checkpoint)
