"""How far an activity lends itself to automation, told from the log alone, and what automating it may be worth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions.measures import micros
from tracelake.functions.written import written
from tracelake.operators import dfg, variants

#: What each dimension weighs. Volume comes first, since what is rare pays for no project however regular it is. The two
#: that say whether a rule can be written down at all, alike inputs and clear outcomes, weigh the same and together the
#: most. Exceptions weigh least: they are partly seen in the other two, and can be left to people.
WEIGHTS = {"volume": 0.3, "repetitiveness": 0.25, "rule_clarity": 0.25, "regularity": 0.2}
MOST_SCENARIOS = 10_000


def contexts(log: DataFrame) -> DataFrame:
    """activity, before, after (null at a case's ends), n, in_loop, off_path, exceptions, seconds, squares, followed, first
    and last time.

    One shuffle of the log by case. An event is in a loop if it lies between the first and the last of an activity that
    its case repeats: the furthest last of all activities up to here reaches it. Rows number activities cubed at most.
    """
    order, same = dfg.in_case(), Window.partitionBy("case_id", "activity")
    steps = dfg.require(log).select(
        "case_id", "event_index", "activity", "timestamp", F.lag("activity").over(order).alias("before"), F.lead("activity").over(order).alias("after"),
        (micros(F.col("timestamp"), F.lead("timestamp").over(order)) / F.lit(1e6)).alias("seconds"),
        F.when(F.count("*").over(same) > 1, F.max("event_index").over(same)).alias("again"),
    )
    reach = F.max("again").over(order.rowsBetween(Window.unboundedPreceding, 0))
    marked = steps.withColumn("loop", F.coalesce(reach >= F.col("event_index"), F.lit(False)))
    marked = marked.join(variants.happy_cases(log).withColumn("happy", F.lit(True)), "case_id", "left").withColumn("off", F.col("happy").isNull())
    return marked.groupBy("activity", "before", "after").agg(
        F.count("*").alias("n"), F.count_if("loop").alias("in_loop"), F.count_if("off").alias("off_path"), F.count_if(F.col("loop") | F.col("off")).alias("exceptions"),
        F.sum("seconds").alias("seconds"), F.sum(F.col("seconds") * F.col("seconds")).alias("squares"), F.count("seconds").alias("followed"),
        F.min("timestamp").alias("first"), F.max("timestamp").alias("last"),
    )


def dimensions(found: DataFrame) -> DataFrame:
    """Per activity what the score is made of: counts, entropies in bits, variation of the time to the next event, rates.
    found: the log's contexts."""
    mine = Window.partitionBy("activity")
    total = F.sum("n").over(mine)
    bits = lambda c: F.col("n") / total * -F.log2(F.sum("n").over(Window.partitionBy("activity", c)) / total)
    rows = found.withColumn("h_before", bits("before")).withColumn("h_after", bits("after"))
    count = F.sum("n")
    mean = F.try_divide(F.sum("seconds"), F.sum("followed"))
    spread = F.sqrt(F.greatest(F.sum("squares") / F.nullif(F.sum("followed"), F.lit(0)) - mean * mean, F.lit(0.0)))
    return rows.groupBy("activity").agg(
        count.alias("events"), F.sum("h_before").alias("context_entropy"), F.sum("h_after").alias("next_entropy"), mean.alias("mean_seconds"),
        F.coalesce(F.try_divide(spread, mean), F.lit(0.0)).alias("variation"), (F.sum("in_loop") / count).alias("loop_rate"), (F.sum("off_path") / count).alias("off_path_rate"), (F.sum("exceptions") / count).alias("exception_rate"),
    )


def weighed(weights: dict[str, float]) -> Column:
    if set(weights) != set(WEIGHTS) or min(weights.values()) < 0 or abs(sum(weights.values()) - 1) > 1e-9:
        raise ValueError(f"weights of {', '.join(WEIGHTS)} must not be negative and add up to 1: {weights}")
    return sum((F.col(c) * F.lit(float(w)) for c, w in weights.items()), F.lit(0.0))


def scores(log: DataFrame, weights: dict[str, float] | None = None, found: DataFrame | None = None) -> DataFrame:
    """Per activity the four dimensions, each from 0 to 1, the weighted score and the rank.

    volume: logarithm of its events against the most frequent activity's. repetitiveness: how sure the step before is,
    against equal odds of all activities and a case's start. rule_clarity: how sure the next step is, and how steady the
    time to it, half each. regularity: share of its events that are neither in a loop nor off the happy path. Activities
    are few, so their maximum and ranks are windows over all. found: the log's contexts, where they are at hand.
    """
    score, every = weighed(weights or WEIGHTS), Window.partitionBy()
    even = F.log2(F.count("*").over(every) + 1)
    known = dimensions(contexts(log) if found is None else found).withColumn("even", even).withColumn("most", F.max("events").over(every))
    made = known.select(
        "*",
        (F.log1p("events") / F.log1p("most")).alias("volume"),
        (1 - F.col("context_entropy") / F.col("even")).alias("repetitiveness"),
        (0.5 * (1 - F.col("next_entropy") / F.col("even")) + 0.5 / (1 + F.col("variation"))).alias("rule_clarity"),
        (1 - F.col("exception_rate")).alias("regularity"),
    ).withColumn("score", F.round(score, 6))
    rounded = [F.round(c, 6).alias(c) for c in ("context_entropy", "next_entropy", "variation", "loop_rate", "off_path_rate", "exception_rate", *WEIGHTS)]
    return made.select("activity", "events", F.round("mean_seconds", 3).alias("mean_seconds"), *rounded, "score", F.row_number().over(Window.orderBy(F.desc("score"), "activity")).alias("rank"))


def scenarios(log: DataFrame, adoption: list[float], growth: list[float], cost: list[float]) -> DataFrame:
    """adoption, growth, cost: every combination of the assumptions."""
    if not 0 < len(adoption) * len(growth) * len(cost) <= MOST_SCENARIOS:
        raise ValueError(f"1 to {MOST_SCENARIOS} scenarios can be told: {len(adoption) * len(growth) * len(cost)}")
    if not all(0 <= x <= 1 for x in adoption) or min(growth) <= -1 or min(cost) < 0:
        raise ValueError("adoption must lie in [0, 1], growth above -1, and no cost below 0")
    each = lambda df, name, values: df.withColumn(name, F.explode(F.array(*[F.lit(float(v)) for v in values])))
    return each(each(each(log.sparkSession.range(1), "adoption", adoption), "growth", growth), "cost", cost).drop("id")


#: Assumptions of a business case that are not varied: work among the time that passes until the next event, price of an
#: hour, interest a year, months that are looked at.
TOUCH, HOURLY, INTEREST, MONTHS = 0.02, 45.0, 0.08, 36


def business_case(log: DataFrame, adoption: list[float], growth: list[float], cost: list[float], candidates: int = 3, touch: float = TOUCH, hourly: float = HOURLY, interest: float = INTEREST, months: int = MONTHS, weights: dict[str, float] | None = None) -> DataFrame:
    """Per candidate (the best scores) and scenario: what is saved a month at full adoption, payback in months (null if not
    within `months`), net present value.

    Savings of month m: events a month x hours of work each x price x adoption x (1 + growth) ^ (m / 12). The cash flows
    of a scenario are folded month by month. The log's own span gives events a month (a month at least).
    """
    if months < 1 or not 0 < touch <= 1 or hourly <= 0 or interest <= -1:
        raise ValueError("months, touch and hourly must be positive, touch at most 1, interest above -1")
    found = written(contexts(log))  # for the scores and the log's span
    span = found.agg(F.greatest(micros(F.min("first"), F.max("last")) / F.lit(86400e6 * 365.25 / 12), F.lit(1.0)).alias("span"))
    best = scores(log, weights, found).where(F.col("rank") <= candidates).join(F.broadcast(span))  # one row
    hours = F.coalesce("mean_seconds", F.lit(0.0)) * touch / 3600
    rows = F.broadcast(best.select("activity", "rank", (F.col("events") / F.col("span") * hours * hourly).alias("monthly"))).join(scenarios(log, adoption, growth, cost))  # a few rows for each scenario

    def month(s: Column, m: Column) -> Column:
        saved = F.col("monthly") * F.col("adoption") * F.pow(1 + F.col("growth"), m / 12.0)
        left = s["left"] - saved
        paid = F.when(s["paid"].isNull() & (left <= 0), m).otherwise(s["paid"])
        return F.struct(left.alias("left"), (s["npv"] + saved / F.pow(F.lit(1.0 + interest), m / 12.0)).alias("npv"), paid.alias("paid"))

    empty = F.struct(F.col("cost").alias("left"), (-F.col("cost")).alias("npv"), F.lit(None).cast("int").alias("paid"))
    told = rows.withColumn("flow", F.aggregate(F.sequence(F.lit(1), F.lit(months)), empty, month))
    return told.select("activity", "rank", "adoption", "growth", "cost", F.round("monthly", 2).alias("monthly_savings"), F.col("flow.paid").alias("payback_months"), F.round("flow.npv", 2).alias("net_present_value"))


def sensitivity(cases: DataFrame) -> DataFrame:
    """Per activity the range of what business_case gives: payback of those scenarios that pay back, and value."""
    pays = F.col("payback_months").isNotNull()
    return cases.groupBy("activity").agg(
        F.count("*").alias("scenarios"), F.count_if(pays).alias("paying"), F.min("payback_months").alias("shortest_payback"), F.max("payback_months").alias("longest_payback"),
        F.min("net_present_value").alias("least_value"), F.max("net_present_value").alias("most_value"),
    )
