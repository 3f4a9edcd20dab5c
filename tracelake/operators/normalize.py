"""Cleaning raw events: each row is kept, filtered by the lifecycle policy, or excluded for its first reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

REASONS = ["missing_case_id", "duplicate_case_id", "missing_activity", "missing_timestamp", "unparseable_timestamp", "out_of_order"]
POLICIES = ("all", "complete", "start_else_complete")
LOG = ["case_id", "event_index", "activity", "timestamp", "resource", "cost", "outcome"]
NO_OUTCOME = "no_terminal_state"
GIVEN = ["case_id", "event_index", "activity", "lifecycle", "given", "ts", "resource"]
#: Extended ISO-8601 with an optional zone; basic forms and region names are not read.
ISO = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}(:?\d{2})?)?)?$"


#: White space of all scripts, and the four separators that Python strips too.
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def clean(text: Column) -> Column:
    """Without white space around it; null if nothing is left."""
    return F.nullif(F.btrim(text, F.lit(BLANKS)), F.lit(""))


def parsed_time(text: Column) -> Column:
    """The time of ISO text, null for other text. A date is its midnight, a time without a zone is UTC."""
    zoned = F.when(~text.rlike("[T ]"), F.concat(text, F.lit("T00:00:00Z"))).when(text.rlike(r"[T ].*(?:Z|[+-]\d{2}(?::?\d{2})?)$"), text).otherwise(F.concat(text, F.lit("Z")))
    return F.when(text.rlike(ISO), zoned.try_cast("timestamp"))


def prepared(raw: DataFrame, policy: str, tidy: tuple[str, ...] = ()) -> DataFrame:
    """raw, cleaned, with ts, and whether the lifecycle policy wants the row. tidy: columns that hold no white space, such
    as numbers as text; they are taken as they are, so a raw log that lies by case already is not shuffled again."""
    if policy not in POLICIES:
        raise ValueError(f"lifecycle policy must be one of {', '.join(POLICIES)}: {policy}")
    is_text = dict(raw.dtypes)["timestamp"] == "string"
    df = raw.withColumns({c: clean(F.col(c)) for c in ("case_id", "activity", "lifecycle", "resource") if c not in tidy})
    df = df.withColumn("lifecycle", F.lower(F.coalesce("lifecycle", F.lit("complete"))))
    df = df.withColumn("given", clean(F.col("timestamp")) if is_text else F.col("timestamp"))
    df = df.withColumn("ts", parsed_time(F.col("given")) if is_text else F.col("given"))
    if policy == "all":
        wanted = F.lit(True)
    elif policy == "complete":
        wanted = F.col("lifecycle") == "complete"
    else:
        # few activities: their started ones are counted first and looked up, instead of a window over all rows of one
        started = df.where((F.col("lifecycle") == "start") & F.col("activity").isNotNull()).select("activity").distinct().withColumn("_started", F.lit(True))
        df = df.join(started, "activity", "left")
        wanted = F.when(F.col("_started"), F.col("lifecycle") == "start").otherwise(F.col("lifecycle") == "complete")
    return df.withColumn("_wanted", F.coalesce(wanted, F.lit(False)))


def judged(df: DataFrame) -> DataFrame:
    """prepared rows that have a case, with reason and status. All windows run within a case, so there is one shuffle."""
    in_case = Window.partitionBy("case_id").orderBy("event_index")
    again = (F.row_number().over(in_case) > 1) & F.lag("event_index").over(in_case).eqNullSafe(F.col("event_index"))
    df = df.withColumn("_again", again).withColumn("_twice", F.max("_again").over(Window.partitionBy("case_id")))
    malformed = F.coalesce(F.when(F.col("_twice"), REASONS[1]), F.when(F.col("activity").isNull(), REASONS[2]), F.when(F.col("given").isNull(), REASONS[3]), F.when(F.col("ts").isNull(), REASONS[4]))
    df = df.withColumn("_bad", malformed).withColumn("_candidate", F.col("_bad").isNull() & F.col("_wanted"))
    before = F.max(F.when(F.col("_candidate"), F.col("ts"))).over(in_case.rowsBetween(Window.unboundedPreceding, -1))
    df = df.withColumn("_late", F.col("_candidate") & F.coalesce(F.col("ts") < before, F.lit(False)))
    reason = F.coalesce(F.col("_bad"), F.when(F.col("_late"), REASONS[5]))
    status = F.when(reason.isNotNull(), "excluded").when(F.col("_candidate"), "normalized").otherwise("filtered")
    return df.select(*GIVEN, reason.alias("reason"), status.alias("status"))


def classified(raw: DataFrame, policy: str = "start_else_complete") -> DataFrame:
    """raw, cleaned, with `ts`, `reason` (null unless excluded) and `status`: normalized, filtered or excluded.

    The timestamp may be text or a time already. Started activities are looked up among all rows, malformed ones too;
    order is judged among the candidates only, so an excluded row never raises the latest time. Rows without a case are
    told apart first: they need no window, and no task gets all of them.
    """
    df = prepared(raw, policy)
    lost = df.where(F.col("case_id").isNull()).select(*GIVEN, F.lit(REASONS[0]).alias("reason"), F.lit("excluded").alias("status"))
    return judged(df.where(F.col("case_id").isNotNull())).unionByName(lost)


def normalized_events(raw: DataFrame, policy: str = "start_else_complete", outcomes: dict[str, str] | None = None, tidy: tuple[str, ...] = ()) -> DataFrame:
    """The event log: the kept rows in the log's columns. tidy: as in prepared."""
    kept = judged(prepared(raw, policy, tidy).where(F.col("case_id").isNotNull())).where(F.col("status") == "normalized").select("case_id", "event_index", "activity", F.col("ts").alias("timestamp"), "resource", F.lit(None).cast("double").alias("cost"))
    return with_outcomes(kept, outcomes).select(*LOG)


def with_outcomes(log: DataFrame, outcomes: dict[str, str] | None) -> DataFrame:
    """log with the label of each case's last terminal activity."""
    if not outcomes:
        return log.withColumn("outcome", F.lit(None).cast("string"))
    label = F.coalesce(*[F.when(F.col("activity") == a, F.lit(x)) for a, x in outcomes.items()])
    last = F.max_by(label, F.when(label.isNotNull(), F.col("event_index"))).over(Window.partitionBy("case_id"))
    return log.withColumn("outcome", last)


def exclusion_counts(marked: DataFrame) -> DataFrame:
    """Every reason with its count of events, zeros included."""
    reasons = marked.sparkSession.createDataFrame([(r, n) for n, r in enumerate(REASONS)], "reason string, position int")
    counts = marked.where(F.col("reason").isNotNull()).groupBy("reason").agg(F.count("*").alias("events"))
    return F.broadcast(reasons).join(counts, "reason", "left").select("reason", "position", F.coalesce("events", F.lit(0)).cast("bigint").alias("events"))


def report(marked: DataFrame) -> DataFrame:
    """One row: parsed = normalized + excluded + filtered, distinct cases, missing resources."""
    kept = F.col("status") == "normalized"
    return marked.agg(
        F.count("*").alias("parsed_events"),
        F.count_if(kept).alias("normalized_events"),
        F.count_if(F.col("status") == "excluded").alias("excluded_events"),
        F.count_if(F.col("status") == "filtered").alias("filtered_events"),
        F.count_distinct("case_id").alias("parsed_cases"),
        F.count_distinct(F.when(kept, F.col("case_id"))).alias("normalized_cases"),
        F.count_if(kept & F.col("resource").isNull()).alias("missing_resource"),
    )


def lifecycle_counts(marked: DataFrame) -> DataFrame:
    return marked.groupBy("lifecycle").agg(F.count("*").alias("events"))


def outcome_counts(log: DataFrame) -> DataFrame:
    """Cases by outcome."""
    cases = log.groupBy("case_id").agg(F.first("outcome", ignorenulls=True).alias("outcome"))
    return cases.groupBy(F.coalesce("outcome", F.lit(NO_OUTCOME)).alias("outcome")).agg(F.count("*").alias("cases"))
