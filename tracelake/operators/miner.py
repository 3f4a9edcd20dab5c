"""Dependency and footprint of activity pairs, loops, and the heuristic net."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions.measures import check_threshold, dependency, footprint, self_loop, two_loop
from tracelake.functions.written import written
from tracelake.operators import dfg

KINDS = ["causal", "length_one_loop", "length_two_loop", "best_connection"]
EDGES = "source string, target string, kind string, dependency double, frequency bigint"


def trigrams(log: DataFrame) -> DataFrame:
    """source, target, third, is_first, is_last, n: how often activities stand one behind the other. target and third are
    null at a case's end, is_first and is_last tell its first and last event. One pass over the log; these few rows are
    written down, and all that is mined follows from them."""
    order = dfg.in_case()
    steps = dfg.require(log).select(F.col("activity").alias("source"), F.lead("activity").over(order).alias("target"), F.lead("activity", 2).over(order).alias("third"), (F.row_number().over(order) == 1).alias("is_first"), F.lead(F.lit(1)).over(order).isNull().alias("is_last"))
    return written(steps.groupBy("source", "target", "third", "is_first", "is_last").agg(F.count("*").alias("n")))


def nodes(tri: DataFrame) -> DataFrame:
    """activity, events, starts, ends: zero where an activity starts or ends no case."""
    of = lambda c: F.coalesce(F.sum(F.when(F.col(c), F.col("n"))), F.lit(0)).cast("bigint")
    return tri.groupBy(F.col("source").alias("activity")).agg(F.sum("n").alias("events"), of("is_first").alias("starts"), of("is_last").alias("ends"))


def frequencies(tri: DataFrame) -> DataFrame:
    """source, target, frequency."""
    return tri.where(F.col("target").isNotNull()).groupBy("source", "target").agg(F.sum("n").alias("frequency"))


def with_reverse(pairs: DataFrame) -> DataFrame:
    """Each observed pair with the frequency of the reverse pair, 0 if unseen. Pairs number activities squared at most."""
    back = pairs.select(F.col("source").alias("target"), F.col("target").alias("source"), F.col("frequency").alias("reverse"))
    return pairs.join(back, ["source", "target"], "left").withColumn("reverse", F.coalesce("reverse", F.lit(0)))


def pairs(log: DataFrame, threshold: float = 0.9) -> DataFrame:
    """a, b, ab, ba, dependency, relation for all ordered pairs of different activities.

    The pairs of the (few) activities are spanned from their distinct list, not from the events.
    """
    check_threshold(threshold)
    tri = trigrams(log)
    names = tri.select(F.col("source").alias("activity")).distinct()
    grid = names.agg(F.array_sort(F.collect_list("activity")).alias("all"))
    spanned = grid.select("all", F.explode("all").alias("a")).select("a", F.explode("all").alias("b")).where("a <> b")
    seen = frequencies(tri)
    ab = seen.toDF("a", "b", "ab")
    ba = seen.toDF("b", "a", "ba")
    both = spanned.join(ab, ["a", "b"], "left").join(ba, ["a", "b"], "left").select("a", "b", F.coalesce("ab", F.lit(0)).alias("ab"), F.coalesce("ba", F.lit(0)).alias("ba"))
    return both.withColumn("dependency", dependency(F.col("ab"), F.col("ba"))).withColumn("relation", footprint(F.col("ab"), F.col("ba"), threshold))


def causal_edges(log: DataFrame, threshold: float = 0.9) -> DataFrame:
    check_threshold(threshold)
    return causal(frequencies(trigrams(log)), threshold)


def causal(pairs: DataFrame, threshold: float) -> DataFrame:
    seen = with_reverse(pairs).where("source <> target")
    return seen.withColumn("dependency", dependency(F.col("frequency"), F.col("reverse"))).where(F.col("dependency") >= F.lit(threshold)).select("source", "target", "dependency", "frequency")


def self_loops(log: DataFrame, threshold: float = 0.9) -> DataFrame:
    return looping(frequencies(trigrams(log)), threshold)


def looping(pairs: DataFrame, threshold: float) -> DataFrame:
    loops = pairs.where("source = target")
    return loops.withColumn("dependency", self_loop(F.col("frequency"))).where(F.col("dependency") >= F.lit(threshold)).select("source", "target", "dependency", "frequency")


def aba_patterns(log: DataFrame) -> DataFrame:
    """a, b, occurrences of a b a within cases, overlapping ones too."""
    return patterns(trigrams(log))


def patterns(tri: DataFrame) -> DataFrame:
    return tri.where("source = third AND source <> target").groupBy(F.col("source").alias("a"), F.col("target").alias("b")).agg(F.sum("n").alias("occurrences"))


def two_loops(log: DataFrame, threshold: float = 0.9) -> DataFrame:
    """Both directions of every pair whose a b a and b a b patterns reach the threshold, with their own frequencies."""
    return turning(trigrams(log), threshold)


def turning(tri: DataFrame, threshold: float) -> DataFrame:
    seen = patterns(tri)
    back = seen.select(F.col("a").alias("b"), F.col("b").alias("a"), F.col("occurrences").alias("other"))
    both = seen.join(back, ["a", "b"], "full").select("a", "b", F.coalesce("occurrences", F.lit(0)).alias("aba"), F.coalesce("other", F.lit(0)).alias("bab"))
    strong = both.withColumn("dependency", two_loop(F.col("aba"), F.col("bab"))).where(F.col("dependency") >= F.lit(threshold))
    return strong.select(F.col("a").alias("source"), F.col("b").alias("target"), "dependency").join(frequencies(tri), ["source", "target"], "left").select("source", "target", "dependency", F.coalesce("frequency", F.lit(0)).alias("frequency"))


def model_edges(log: DataFrame, threshold: float = 0.9) -> DataFrame:
    """Edges admitted by rule, the first rule that admits an edge naming its kind; activities are not yet connected."""
    check_threshold(threshold)
    return admitted(trigrams(log), threshold)


def admitted(tri: DataFrame, threshold: float) -> DataFrame:
    pairs = frequencies(tri)
    rules = [causal(pairs, threshold), looping(pairs, threshold), turning(tri, threshold)]
    marked = [r.withColumn("kind", F.lit(k)).withColumn("rank", F.lit(n)) for n, (k, r) in enumerate(zip(KINDS, rules, strict=False))]
    every = marked[0].unionByName(marked[1]).unionByName(marked[2])
    first = F.row_number().over(Window.partitionBy("source", "target").orderBy("rank"))
    return every.withColumn("_n", first).where("_n = 1").select("source", "target", "kind", "dependency", "frequency")


def connected(log: DataFrame, threshold: float = 0.9) -> DataFrame:
    """The heuristic net: model_edges, and for activities left without a way in or out their strongest pair.

    Activities are taken in alphabetical order and each sees what was admitted before, so this runs over the pairs of
    activities on the driver, with what starts or ends a case. The log is read once, into its trigrams.
    """
    check_threshold(threshold)
    return net(trigrams(log), threshold)


def net(tri: DataFrame, threshold: float) -> DataFrame:
    """connected, from trigrams."""
    spark = tri.sparkSession
    edges = {(r.source, r.target): (r.kind, r.dependency, r.frequency) for r in admitted(tri, threshold).collect()}
    rows = tri.groupBy("source", "target").agg(F.sum("n").alias("n"), F.max("is_first").alias("is_first")).collect()
    starts, ends = {r.source for r in rows if r.is_first}, {r.source for r in rows if r.target is None}
    names = sorted({r.source for r in rows})
    counts = {(r.source, r.target): r.n for r in rows if r.target is not None}

    def strength(pair: tuple[str, str]) -> float:
        ab, ba = counts[pair], counts.get(pair[::-1], 0)
        return (ab - ba) / (ab + ba + 1)

    for name in names:
        for end, exempt in ((1, starts), (0, ends)):
            linked = any(e[end] == name and e[1 - end] != name for e in edges)
            if name in exempt or linked:
                continue
            open_pairs = [p for p in counts if p[end] == name and p[1 - end] != name]
            if open_pairs:
                best = min(open_pairs, key=lambda p: (-strength(p), -counts[p], p))
                edges.setdefault(best, (KINDS[3], strength(best), counts[best]))
    return spark.createDataFrame([(s, t, k, float(d), f) for (s, t), (k, d, f) in sorted(edges.items())], EDGES)


def orphans(log: DataFrame, edges: DataFrame) -> DataFrame:
    """Activities without any edge to another activity. log: anything with an activity in each row."""
    linked = edges.where("source <> target").select(F.explode(F.array("source", "target")).alias("activity"))
    return log.select("activity").distinct().join(linked, "activity", "left_anti")


def orphans_of(log: DataFrame, threshold: float = 0.9) -> DataFrame:
    """orphans of the log's model_edges, told from one reading of the log."""
    tri = trigrams(log)
    return orphans(nodes(tri), admitted(tri, check_threshold(threshold)))
