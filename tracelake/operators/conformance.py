"""Petri nets, reference models and token replay."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions.measures import filled, fitness
from tracelake.functions.written import written
from tracelake.operators import variants as v


@dataclass(frozen=True)
class Transition:
    id: str
    label: str
    inputs: tuple[str, ...]
    outputs: tuple[str, ...]


@dataclass(frozen=True)
class PetriNet:
    places: tuple[str, ...]
    transitions: tuple[Transition, ...]
    initial: dict[str, int] = field(default_factory=dict)
    final: dict[str, int] = field(default_factory=dict)

    def __post_init__(self):
        known, ids = set(self.places), [t.id for t in self.transitions]
        arcs = {p for t in self.transitions for p in (*t.inputs, *t.outputs)}
        problems = {
            "duplicate places": len(known) != len(self.places),
            "duplicate transition ids": len(set(ids)) != len(ids),
            "unknown places in arcs": not arcs <= known,
            "unknown places in markings": not {*self.initial, *self.final} <= known,
            "negative tokens": any(n < 0 for n in (*self.initial.values(), *self.final.values())),
            "empty marking": not sum(self.initial.values()) or not sum(self.final.values()),
        }
        if found := [name for name, wrong in problems.items() if wrong]:
            raise ValueError("; ".join(found))

    @property
    def labels(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys(t.label for t in self.transitions))

    def transitions_for(self, label: str) -> tuple[Transition, ...]:
        return tuple(t for t in self.transitions if t.label == label)


def sequence_net(activities: list[str]) -> PetriNet:
    """A line of places with one transition per activity between them."""
    if not activities:
        raise ValueError("a sequence net needs at least one activity")
    n = len(activities)
    line = tuple(Transition(f"t{i}", a, (f"p{i}",), (f"p{i + 1}",)) for i, a in enumerate(activities))
    return PetriNet(tuple(f"p{i}" for i in range(n + 1)), line, {"p0": 1}, {f"p{n}": 1})


STRATEGIES = ("most_frequent_variant", "most_frequent_variant_for_outcome", "documented")


def reference(log: DataFrame, strategy: str, outcome: str | None = None, documented: list[str] | None = None, cases: DataFrame | None = None) -> dict:
    """activities, supporting and eligible cases of the reference model, and what it is; one row reaches the driver.
    cases: the log's named sequences, where they are at hand."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy: {strategy}")
    if strategy == "documented":
        if not documented:
            raise ValueError("documented activities are needed")
        return {"activities": list(documented), "supporting_cases": None, "eligible_cases": None, "description": "a documented sequence of activities"}
    if strategy == "most_frequent_variant_for_outcome":
        if outcome is None:
            raise ValueError("an outcome is needed")
        log, cases = log.where(F.col("outcome") == outcome), None
    top = v.top(log, 1, cases).select("seq", "case_count", "_total").head()
    if top is None:
        raise ValueError(f"no case with outcome {outcome}" if outcome else "empty event log")
    of = f"cases that end as {outcome}" if strategy == STRATEGIES[1] else "all cases"
    return {"activities": list(top.seq), "supporting_cases": top.case_count, "eligible_cases": top._total, "description": f"the most frequent variant of {of}"}


def fold(seq: Column, net: PetriNet) -> Column:
    """Token replay of a sequence by a fold over its events, for any net: struct of p, c, m, r, u.

    Of several transitions with the event's label the one that lacks fewest tokens fires, the earliest between equals.
    The marking is a map of counts by place number; it is as small as the net.
    """
    number = {p: i for i, p in enumerate(net.places)}
    counts = lambda places: [sum(number[x] == i for x in places) for i in range(len(net.places))]
    longs = lambda values: F.array(*[F.lit(x).cast("bigint") for x in values])
    table = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(t.label).alias("label"), longs(counts(t.inputs)).alias("i"), longs(counts(t.outputs)).alias("o")) for n, t in enumerate(net.transitions)])
    total = lambda a: F.aggregate(a, F.lit(0).cast("bigint"), lambda s, x: s + x)
    lacking = lambda marking, t: total(F.zip_with(t["i"], marking, lambda need, have: F.greatest(need - have, F.lit(0))))
    initial, final = longs([net.initial.get(p, 0) for p in net.places]), longs([net.final.get(p, 0) for p in net.places])
    state = lambda marking, p, c, m, u: F.struct(marking.alias("k"), p.alias("p"), c.alias("c"), m.alias("m"), u.alias("u"))

    def step(s: Column, event: Column) -> Column:
        choices = F.transform(F.filter(table, lambda t: t["label"] == event), lambda t: F.struct(lacking(s["k"], t).alias("lacks"), t["n"].alias("n"), t["i"].alias("i"), t["o"].alias("o")))
        best = F.array_min(choices)
        consumed = F.zip_with(s["k"], best["i"], lambda have, need: F.greatest(have - need, F.lit(0).cast("bigint")))
        moved = F.zip_with(consumed, best["o"], lambda have, new: have + new)
        fired = state(moved, s["p"] + total(best["o"]), s["c"] + total(best["i"]), s["m"] + best["lacks"], s["u"])
        unknown = state(s["k"], s["p"] + 1, s["c"] + 1, s["m"] + 1, s["u"] + 1)
        return F.when(F.size(choices) == 0, unknown).otherwise(fired)

    zero = F.lit(0).cast("bigint")
    start = state(initial, F.lit(sum(net.initial.values())).cast("bigint"), zero, zero, zero)

    def finish(s: Column) -> Column:
        lacks = total(F.zip_with(final, s["k"], lambda need, have: F.greatest(need - have, F.lit(0))))
        left = total(F.zip_with(final, s["k"], lambda need, have: F.greatest(have - need, F.lit(0))))
        return F.struct(s["p"].alias("produced"), (s["c"] + F.lit(sum(net.final.values()))).alias("consumed"), (s["m"] + lacks).alias("missing"), (left + s["u"]).alias("remaining"), s["u"].alias("unknown_activities"))

    return F.aggregate(seq, start, step, finish)


def replay(log: DataFrame | None, net: PetriNet, cases: DataFrame | None = None) -> DataFrame:
    """Per case the token counts, fitness and whether it fits. Each distinct sequence is replayed once. An empty log gives
    no rows here, and an error in summary. cases: the log's named sequences, where they are at hand."""
    cases = written(v.named(v.sequences(log))) if cases is None else cases
    replayed = cases.groupBy("_k").agg(F.first("seq").alias("seq")).select("_k", fold(F.col("seq"), net).alias("_r"))
    joined = cases.select("case_id", "_k").join(replayed, "_k").select("case_id", "_r.*")
    return joined.withColumn("fitness", fitness(F.col("missing"), F.col("consumed"), F.col("remaining"), F.col("produced"))).withColumn("fits", (F.col("missing") == 0) & (F.col("remaining") == 0))


def replay_most_frequent(log: DataFrame) -> DataFrame:
    """replay on the net of the most frequent variant. The log's sequences are written once, for the variant and the replay."""
    cases = written(v.named(v.sequences(log)))
    return replay(None, sequence_net(reference(log, STRATEGIES[0], cases=cases)["activities"]), cases)


def replay_sequence(log: DataFrame, activities: list[str]) -> DataFrame:
    """The same for a line of different activities, as windows: a place's missing tokens are the depth its running
    count of tokens falls under zero."""
    if len(set(activities)) != len(activities):
        raise ValueError("activities repeat: replay with a net instead")
    n = len(activities)
    place_of = F.coalesce(*[F.when(F.col("activity") == a, F.lit(i)) for i, a in enumerate(activities)])
    order = F.row_number().over(Window.partitionBy("case_id").orderBy("event_index")).cast("bigint")
    events = log.select("case_id", place_of.alias("i"), order.alias("k"))
    move = lambda place, at, delta: F.struct(place.cast("int").alias("place"), at.cast("bigint").alias("at"), F.lit(delta).alias("delta"))
    moves = F.when(F.col("i").isNotNull(), F.array(move(F.col("i"), 2 * F.col("k"), -1), move(F.col("i") + 1, 2 * F.col("k") + 1, 1))).otherwise(F.array())
    first = F.when(F.col("k") == 1, F.array(move(F.lit(0), F.lit(0), 1), move(F.lit(n), F.lit(1 << 60), -1))).otherwise(F.array())
    exploded = events.select("case_id", F.explode(F.concat(moves, first)).alias("x")).select("case_id", "x.*")
    running = F.sum("delta").over(Window.partitionBy("case_id", "place").orderBy("at"))
    places = exploded.withColumn("run", running).groupBy("case_id", "place").agg(F.greatest(F.lit(0), -F.min("run")).alias("missing"), F.sum("delta").alias("left"))
    tokens = places.groupBy("case_id").agg(F.sum("missing").alias("missing"), F.sum(F.col("left") + F.col("missing")).alias("remaining"))
    lengths = events.groupBy("case_id").agg(F.count("*").alias("length"), F.count_if(F.col("i").isNull()).alias("unknown_activities"))
    counts = tokens.join(lengths, "case_id").select("case_id", (F.col("length") + 1).alias("produced"), (F.col("length") + 1).alias("consumed"), (F.col("missing") + F.col("unknown_activities")).alias("missing"), (F.col("remaining") + F.col("unknown_activities")).alias("remaining"), "unknown_activities")
    return counts.withColumn("fitness", fitness(F.col("missing"), F.col("consumed"), F.col("remaining"), F.col("produced"))).withColumn("fits", (F.col("missing") == 0) & (F.col("remaining") == 0))


def summary(replayed: DataFrame) -> DataFrame:
    """One row: cases, fitting cases, deviating share, pooled log fitness, and the distribution of case fitness."""
    q = lambda p: F.round(F.percentile("fitness", F.lit(p)), 9)
    got = replayed.agg(F.count("*").alias("cases"), F.count_if("fits").alias("fitting_cases"), *[F.sum(c).alias(f"_{c}") for c in ("missing", "consumed", "remaining", "produced")], F.round(F.avg("fitness"), 9).alias("mean"), q(0.1).alias("p10"), q(0.5).alias("p50"), q(0.9).alias("p90"))
    pooled = fitness(F.col("_missing"), F.col("_consumed"), F.col("_remaining"), F.col("_produced"))
    return got.withColumn("cases", filled(F.col("cases"), "empty event log")).select("cases", "fitting_cases", (1 - F.col("fitting_cases") / F.col("cases")).alias("deviating_share"), pooled.alias("log_fitness"), "mean", "p10", "p50", "p90")


def case_outcomes(log: DataFrame) -> DataFrame:
    return log.groupBy("case_id").agg(F.first("outcome", ignorenulls=True).alias("outcome"))


def fitness_by_outcome(replayed: DataFrame, log: DataFrame) -> DataFrame:
    label = F.coalesce("outcome", F.lit("no terminal state")).alias("outcome")
    return replayed.join(case_outcomes(log), "case_id", "left").groupBy(label).agg(F.round(F.avg("fitness"), 9).alias("mean_fitness"), F.count("*").alias("cases"), F.count_if("fits").alias("fitting_cases"))
