"""The network of resources that hand work over to each other."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import pairwise
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions.written import written
from tracelake.operators import dfg

BROADCAST_EDGES = 200_000  # or nodes: rows of two short names or numbers
NEAR, STRIP = 8192, 128  # resources of a component whose edges go to a task as bits; sources of a task at a time
HELD, FRONT = 2**25, 2**18  # edges of a larger component that a task holds as numbers, there and back; its sources at a time, times their nodes
AT_ONCE = 2**25  # rows of a source and a node that joins of waves keep at a time
CHEAP, PART = 5, 2**20  # sums over all edges cost so many times less an edge than those over chosen ones; chosen ones at a time
FREQUENT, EXPECTED = 0.01, 1.0


def small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_EDGES else df


def links(edges: DataFrame, giver: str, taker: str) -> tuple[DataFrame, DataFrame, int]:
    """Distinct pairs of different resources as numbers (u, v), the resources (node, id) and how many they are."""
    named = written(edges.select(F.col(giver).alias("a"), F.col(taker).alias("b")).where("a <> b").distinct())
    nodes = written(named.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("id", F.monotonically_increasing_id()))
    n = nodes.count()
    for name, number in (("a", "u"), ("b", "v")):
        named = named.join(small(nodes.select(F.col("node").alias(name), F.col("id").alias(number)), n), name).drop(name)
    return written(named), nodes, n


def components(e: DataFrame, nodes: DataFrame, n: int) -> DataFrame:
    """id, c: the smallest node that edges lead to from it, whatever their direction. Numbers spread along edges and from
    where they came from, until none changes."""
    both = e.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.col("v").alias("y")), F.struct(F.col("v").alias("x"), F.col("u").alias("y")))).alias("e")).select("e.*")
    at = nodes.select("id", F.col("id").alias("c"))
    while True:
        beside = both.join(small(at.select(F.col("id").alias("y"), "c"), n), "y").groupBy(F.col("x").alias("id")).agg(F.min("c").alias("b"))
        nearer = written(at.join(beside, "id", "left").select("id", F.least("c", "b").alias("n"), F.col("c").alias("old")))
        ahead = nearer.select(F.col("id").alias("n"), F.col("n").alias("nn"))
        moved = written(nearer.join(ahead, "n").select("id", F.least("n", "nn").alias("c"), "old"))
        at = moved.select("id", "c")
        if moved.where("c <> old").isEmpty():
            return at


def product(x: np.ndarray, bits: np.ndarray, rows: np.ndarray, columns: np.ndarray, back: bool) -> np.ndarray:
    """x times the edges from rows to columns, or times the edges back, unpacked a few rows at a time."""
    out = np.zeros((len(x), len(rows) if back else len(columns)))
    for k in range(0, len(rows), 512):
        part = np.unpackbits(bits[rows[k : k + 512]], axis=1)[:, columns].astype(np.float64)
        if back:
            out[:, k : k + 512] = x @ part.T
        else:
            out += x[:, k : k + 512] @ part
    return out


def through(bits: np.ndarray, sources: np.ndarray) -> np.ndarray:
    """What of all shortest paths from the sources leads through each node of a component, whose edges are bits."""
    m, here = len(bits), np.arange(len(sources))
    ways, level = np.zeros((len(sources), m)), np.full((len(sources), m), -1, np.int32)
    ways[here, sources], level[here, sources] = 1, 0
    front, every, depth = ways, np.arange(m), 0
    while True:
        rows = np.flatnonzero(front.any(axis=0))
        front = np.where(level < 0, product(front[:, rows], bits, rows, every, False), 0.0)
        if not front.any():
            break
        depth += 1
        level[front > 0] = depth
        ways = ways + front
    passed = np.zeros_like(ways)
    for k in range(depth, 1, -1):
        ahead, rows = np.flatnonzero((level == k).any(axis=0)), np.flatnonzero((level == k - 1).any(axis=0))
        each = np.divide(1 + passed[:, ahead], ways[:, ahead], out=np.zeros((len(sources), len(ahead))), where=level[:, ahead] == k)
        passed[:, rows] += np.where(level[:, rows] == k - 1, ways[:, rows] * product(each, bits, rows, ahead, True), 0.0)
    return passed.sum(axis=0)


def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """c, m, i, bits: the edges of one node as bits over the component's nodes."""
    for rows in batches:
        made = []
        for m, to in zip(rows["m"], rows["to"], strict=True):
            flags = np.zeros(m, np.uint8)
            flags[to] = 1
            made.append(np.packbits(flags).tobytes())
        yield rows[["c", "m", "i"]].assign(bits=made)


def strips(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """c, i, passed for each strip of sources with its component's edges."""
    for rows in batches:
        for c, m, at, bits, sources in zip(rows["c"], rows["m"], rows["at"], rows["bits"], rows["sources"], strict=True):
            table = np.zeros((m, -(-m // 8)), np.uint8)
            table[at] = np.frombuffer(b"".join(bits), np.uint8).reshape(len(at), -1)
            found = through(table, np.asarray(sources))
            i = np.flatnonzero(found)
            yield pd.DataFrame({"c": c, "i": i.astype(np.int32), "passed": found[i]})


def listed(e: DataFrame, numbered: DataFrame) -> DataFrame:
    """Per node of numbered (id, i and others) that edges lead from: all but the id, and to: the i of those they lead to."""
    to = numbered.select(F.col("id").alias("v"), F.col("i").alias("j"))
    return e.join(numbered.withColumnRenamed("id", "u"), "u").join(to, "v").groupBy(*[c for c in numbered.columns if c != "id"]).agg(F.collect_list("j").alias("to"))


def placed(sized: DataFrame) -> DataFrame:
    """With i: the node's place in its component."""
    return sized.withColumn("i", F.row_number().over(Window.partitionBy("c").orderBy("node")) - 1).drop("node")


def near(e: DataFrame, numbered: DataFrame, begin: DataFrame) -> DataFrame:
    """id, passed over components that numbered (id, c, m, i) names: a task gets a strip of sources and the edges of its
    component as bits, NEAR squared of them at most, and does the waves there and back as products of matrices."""
    bits = listed(e, numbered).mapInPandas(packed, "c long, m int, i int, bits binary")
    tables = bits.groupBy("c", "m").agg(F.collect_list(F.struct("i", "bits")).alias("t")).select("c", "m", F.col("t.i").alias("at"), F.col("t.bits").alias("bits"))
    starts = numbered.join(begin, "id", "left_semi").groupBy("c", F.floor(F.col("i") / STRIP).alias("k")).agg(F.collect_list("i").alias("sources"))
    parts = int(e.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = starts.join(tables, "c").repartition(parts, "c", "k").select("c", "m", "at", "bits", "sources")
    sums = dealt.mapInPandas(strips, "c long, i int, passed double").groupBy("c", "i").agg(F.sum("passed").alias("passed"))
    return written(sums.join(numbered, ["c", "i"]).select("id", "passed"))


class Edges(NamedTuple):
    """Those of node i lead to `to`, from first[i] up to first[i + 1]."""

    first: np.ndarray
    to: np.ndarray

    def many(self, nodes: np.ndarray) -> np.ndarray:
        return self.first[nodes + 1] - self.first[nodes]

    def back(self) -> Edges:
        order = np.argsort(self.to, kind="stable")
        m = len(self.first) - 1
        return Edges(np.concatenate([[0], np.cumsum(np.bincount(self.to, minlength=m))]), np.repeat(np.arange(m, dtype=np.int32), np.diff(self.first))[order])


def led(edges: Edges, keys: np.ndarray, s: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """A few keys (node times s, plus source) that edges lead from, how many, and the keys that these lead to."""
    many = edges.many(keys // s)
    keys, many = keys[many > 0], many[many > 0]
    ends = np.cumsum(many)
    for part in np.split(np.arange(len(keys)), np.searchsorted(ends, np.arange(PART, ends[-1] if len(ends) else 0, PART))):
        if len(part):
            k, n = keys[part], many[part]
            at = np.arange(n.sum()) + np.repeat(edges.first[k // s] - np.cumsum(n) + n, n)
            yield k, n, edges.to[at].astype(np.intp) * s + np.repeat(k % s, n)


def everywhere(against: Edges, x: np.ndarray, whole: bool) -> np.ndarray:
    """For each node the sum of x, node by source, over the nodes that its edges lead to; a few edges at a time, and as
    many sources as make 32 bytes. whole: x are whole numbers, so that four bytes hold sums under 2**24 exactly."""
    many = np.diff(against.first)
    y, held = np.zeros_like(x), np.flatnonzero(many)
    ends = np.append(against.first[held], len(against.to))
    cuts = [0]
    while cuts[-1] < len(held):
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(ends, ends[cuts[-1]] + PART // 32, "right")) - 1))
    kind = np.float32 if whole and x.max() * many.max() < 2**24 else x.dtype
    columns = [slice(c, c + 32 // np.dtype(kind).itemsize) for c in range(0, x.shape[1], 32 // np.dtype(kind).itemsize)]
    parts = [np.ascontiguousarray(x[:, c], kind) for c in columns]
    for k, e in pairwise(cuts):
        to, at = against.to[ends[k] : ends[e]].astype(np.intp), ends[k:e] - ends[k]
        for c, part in zip(columns, parts, strict=True):
            y[held[k:e], c] = np.add.reduceat(part.take(to, axis=0), at, axis=0)
    return y


def carried(along: Edges, against: Edges, front: np.ndarray, x: np.ndarray, wanted: Callable[[], np.ndarray], whole: bool) -> tuple[np.ndarray, np.ndarray]:
    """Keys and, where it is over 0, what x (0 but for the front) sums up to over the edges to them, which are against's
    from them. By the front's edges, by those of the keys that are wanted, or by all edges, as costs least. whole: as above."""
    flat, s = x.reshape(-1), x.shape[1]
    push = int(along.many(front // s).sum())
    if push <= x.size // 4:
        found = [(to, np.repeat(flat[k], n)) for k, n, to in led(along, front, s)]
        if not found:
            return front[:0], flat[:0]
        keys, at = np.unique(np.concatenate([to for to, _ in found]), return_inverse=True)
        return keys, np.bincount(at, np.concatenate([v for _, v in found]))
    into, all_edges = wanted(), len(against.to) * s // CHEAP
    pull = int(against.many(into // s).sum())
    if pull <= min(push, all_edges):
        found = [(k, np.add.reduceat(flat[to], np.cumsum(n) - n)) for k, n, to in led(against, into, s)]
        keys, sums = (np.concatenate([f[i] for f in found]) if found else flat[:0].astype(kind) for i, kind in enumerate((np.intp, float)))
        return keys[sums > 0], sums[sums > 0]
    if push <= all_edges:
        y = np.zeros(x.size)
        for k, n, to in led(along, front, s):
            y += np.bincount(to, np.repeat(flat[k], n), x.size)
    else:
        y = everywhere(against, x, whole).reshape(-1)
    keys = np.flatnonzero(y)
    return keys, y[keys]


def passed_on(out: Edges, into: Edges, sources: np.ndarray) -> np.ndarray:
    """What of all shortest paths from the sources leads through each node: waves there, and back with dependencies."""
    m, s = len(out.first) - 1, len(sources)
    ways, level, passed, x = np.zeros(m * s), np.full(m * s, -1, np.int32), np.zeros(m * s), np.zeros((m, s))
    flat, fronts = x.reshape(-1), [sources * s + np.arange(s)]
    ways[fronts[0]], level[fronts[0]] = 1, 0
    while len(front := fronts[-1]):
        flat[front] = ways[front]
        keys, sums = carried(out, into, front, x, lambda: np.flatnonzero(level < 0), True)
        flat[front] = 0
        new = level[keys] < 0
        fronts.append(keys[new])
        ways[fronts[-1]], level[fronts[-1]] = sums[new], len(fronts) - 1
    for k in range(len(fronts) - 2, 1, -1):
        flat[fronts[k]] = (1 + passed[fronts[k]]) / ways[fronts[k]]
        keys, sums = carried(into, out, fronts[k], x, lambda k=k: fronts[k - 1], False)
        flat[fronts[k]] = 0
        here = level[keys] == k - 1
        passed[keys[here]] += ways[keys[here]] * sums[here]
    return passed.reshape(m, s).sum(axis=1)


def short(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The places that edges lead to, in two bytes each where they fit, in four else."""
    for rows in batches:
        rows["to"] = [np.sort(to).astype("<u2" if m <= 2**16 else "<i4").tobytes() for m, to in zip(rows["m"], rows["to"], strict=True)]
        yield rows


def share(rows: pd.DataFrame) -> pd.DataFrame:
    """c, i, passed for one task's share of a component's sources."""
    c, m, k, of = (int(rows[name].iat[0]) for name in ("c", "m", "k", "of"))
    size = 2 if m <= 2**16 else 4
    first = np.zeros(m + 1, np.int64)
    first[rows["i"].to_numpy() + 1] = rows["to"].str.len().to_numpy() // size
    out = Edges(np.cumsum(first), np.frombuffer(b"".join(rows["to"]), f"<{'u' if size == 2 else 'i'}{size}").astype(np.int32))
    into = out.back()
    sources, s, found = rows["i"].to_numpy()[rows["begins"].to_numpy(bool)][k::of].astype(np.intp), max(8, FRONT // m), np.zeros(m)
    for at in range(0, len(sources), s):
        found += passed_on(out, into, sources[at : at + s])
    i = np.flatnonzero(found)
    return pd.DataFrame({"c": c, "i": i.astype(np.int32), "passed": found[i]})


def shares(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The shares of a task, one after the other; their rows come together, by place."""
    key, got = None, []
    for rows in batches:
        for at, part in rows.groupby(["c", "k"], sort=False):
            if got and at != key:
                yield share(pd.concat(got))
                got = []
            key = at
            got.append(part)
    if got:
        yield share(pd.concat(got))


def alone(e: DataFrame, sized: DataFrame, begin: DataFrame, sizes: DataFrame) -> DataFrame:
    """id, passed over components of sizes (c, edges), HELD edges each at most: a task holds the edges of one, for its
    share of the sources, and walks by a few edges or by all, whatever is less. Tasks get shares by sources times edges."""
    tasks = e.sparkSession.sparkContext.defaultParallelism
    work = F.col("m").cast("double") * F.col("edges")
    of = F.ceil(work / F.sum(work).over(Window.partitionBy()) * tasks)
    pieces = sizes.withColumn("of", F.greatest(of, F.lit(1)).cast("int")).select("c", "of", F.explode(F.sequence(F.lit(0), F.col("of") - 1)).alias("k"))
    dealt = pieces.withColumn("task", (F.row_number().over(Window.orderBy("c", "k")) - 1) % tasks)
    numbered = written(placed(sized.join(sizes.select("c"), "c", "left_semi")).join(begin.withColumn("begins", F.lit(True)), "id", "left").fillna(False, ["begins"]))
    lists = listed(e, numbered).mapInPandas(short, "c long, m int, i int, begins boolean, to binary")
    sent = lists.join(F.broadcast(dealt), "c").repartitionById(tasks, F.col("task")).drop("task").sortWithinPartitions("c", "k", "i")
    sums = sent.select("c", "m", "k", "of", "i", "begins", "to").mapInPandas(shares, "c long, i int, passed double").groupBy("c", "i").agg(F.sum("passed").alias("passed"))
    return written(sums.join(numbered, ["c", "i"]).select("id", "passed"))


def joined(e: DataFrame, begin: DataFrame) -> DataFrame:
    """id, passed by joins: waves go out from all sources at once, a row is a source, a node that it has reached and the
    number of shortest ways there. On the way back each wave hands its dependencies to the one before, by shares of
    ways. A step is a join with the edge table, so there are as many as the longest shortest path is long, twice."""
    waves = [begin.select(F.col("id").alias("s"), F.col("id").alias("v"), F.lit(1.0).alias("ways"))]
    seen = waves[0].select("s", "v")
    while True:
        out = waves[-1].withColumnRenamed("v", "u").join(e, "u").groupBy("s", "v").agg(F.sum("ways").alias("ways"))
        wave = written(out.join(seen, ["s", "v"], "left_anti"))
        if wave.isEmpty():
            break
        waves.append(wave)
        seen = seen.union(wave.select("s", "v"))
    parts, behind = [], None
    for wave in reversed(waves[1:]):
        here = wave.withColumn("passed", F.lit(0.0))
        if behind is not None:
            ahead = behind.select("s", "v", ((1 + F.col("passed")) / F.col("ways")).alias("each"))
            back = e.join(ahead, "v").groupBy("s", F.col("u").alias("v")).agg(F.sum("each").alias("each"))
            here = wave.join(back, ["s", "v"], "left").select("s", "v", "ways", F.coalesce(F.col("ways") * F.col("each"), F.lit(0.0)).alias("passed"))
        behind = written(here)
        parts.append(behind.select("v", "passed"))
    every = parts[0] if parts else waves[0].select("v", F.lit(0.0).alias("passed"))
    for part in parts[1:]:
        every = every.union(part)
    return written(every.groupBy(F.col("v").alias("id")).agg(F.sum("passed").alias("passed")))


def generations(e: DataFrame, sized: DataFrame, begin: DataFrame) -> DataFrame:
    """id, passed by joins, for so many sources at a time that they keep about AT_ONCE rows, however many there are."""
    rows = sized.join(begin, "id", "left_semi").agg(F.sum("m")).head()[0] or 0
    many, edges = -(-rows // AT_ONCE), e.count()
    sums = sized.select("id", F.lit(0.0).alias("passed"))
    for g in range(many):
        some = written(begin.where(F.pmod(F.xxhash64("id"), F.lit(many)) == g))
        sums = written(sums.union(joined(small(e, edges), some)).groupBy("id").agg(F.sum("passed").alias("passed")))
    return sums


def far(e: DataFrame, sized: DataFrame, begin: DataFrame) -> DataFrame:
    """id, passed over components of more than NEAR nodes, by the number of their edges."""
    sizes = written(e.join(sized.select(F.col("id").alias("u"), "c", "m"), "u").groupBy("c", "m").agg(F.count("*").alias("edges")))
    sums = None
    for some, beyond in ((sizes.where(F.col("edges") <= HELD), False), (sizes.where(F.col("edges") > HELD), True)):
        if some.isEmpty():
            continue
        if beyond:
            sized = written(sized.join(some, "c", "left_semi"))
            here = sized.select(F.col("id").alias("u"))
            found = generations(written(e.join(here, "u", "left_semi")), sized, begin.join(sized, "id", "left_semi"))
        else:
            found = alone(e, sized, begin, some)
        sums = found if sums is None else sums.union(found)
    return sums


def betweenness(edges: DataFrame, giver: str = "giver", taker: str = "taker", sources: DataFrame | None = None) -> DataFrame:
    """resource, betweenness, share: how much of all shortest paths between two others lead through a resource.

    Edges are directed and count alike. No path leaves a component, so components of up to NEAR resources are worked on
    in tasks of their own, each for a strip of sources; larger ones of up to HELD edges in tasks that each hold all their
    edges and take a share of the sources; others by joins of waves with edges, some sources at a time. share: of
    (n - 1) (n - 2) pairs. sources (column resource): only paths from these; all where none is given. Work grows with
    sources times edges of each component, as exact betweenness does.
    """
    e, nodes, n = links(edges, giver, taker)
    begin = (nodes if sources is None else nodes.join(sources.select(F.col("resource").alias("node")).distinct(), "node", "left_semi")).select("id")
    named = components(e, nodes, n)
    sized = written(named.join(named.groupBy("c").agg(F.count("*").cast("int").alias("m")), "c").join(nodes, "id"))
    sums = near(e, written(placed(sized.where(F.col("m") <= NEAR))), begin)
    rest = sized.where(F.col("m") > NEAR)
    if not rest.isEmpty():
        sums = sums.union(far(e, rest, begin))
    told = nodes.join(sums, "id", "left").select(F.col("node").alias("resource"), F.coalesce("passed", F.lit(0.0)).alias("b"))
    pairs = F.lit(float((n - 1) * (n - 2)))
    return told.select("resource", F.round("b", 6).alias("betweenness"), F.round(F.coalesce(F.try_divide("b", pairs), F.lit(0.0)), 9).alias("share"))


def meetings(log: DataFrame, by: str = "resource") -> DataFrame:
    """source, target, a, b (two resources, or whatever `by` names, in order), n: work passed between them at a pair of activities."""
    order = dfg.in_case()
    steps = dfg.require(log, ("case_id", "event_index", "activity", by)).select(F.col("activity").alias("source"), F.lead("activity").over(order).alias("target"), F.col(by).alias("x"), F.lead(by).over(order).alias("y"))
    passed = steps.where("x <> y and target is not null")
    return passed.groupBy("source", "target", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.count("*").alias("n"))


def sparse_teams(log: DataFrame, frequent: float = FREQUENT, expected: float = EXPECTED, by: str = "resource", met: DataFrame | None = None) -> DataFrame:
    """source, target, a, b, meetings, expected_elsewhere: two resources that pass work to each other at a frequent pair of
    activities, and nowhere else, though `expected` meetings or more could be expected there.

    frequent: least share of all meetings. Expected elsewhere, if partners were drawn at random: the meetings of one
    outside this pair of activities, times those of the other, by twice all meetings outside it. met: the log's
    meetings, where they are at hand.
    """
    if not 0 <= frequent <= 1 or expected < 0:
        raise ValueError("frequent must lie in [0, 1], and expected must not be negative")
    met = written(meetings(log, by)) if met is None else met
    pair = met.groupBy("source", "target").agg(F.sum("n").alias("here"))
    often = pair.withColumn("all", F.sum("here").over(Window.partitionBy())).where(F.col("here") >= F.lit(frequent) * F.col("all"))
    ends = met.select("source", "target", F.explode(F.array("a", "b")).alias("r"), "n")
    mine, at = ends.groupBy("r").agg(F.sum("n").alias("mine")), ends.groupBy("source", "target", "r").agg(F.sum("n").alias("at"))
    outside = at.join(mine, "r").select("source", "target", "r", (F.col("mine") - F.col("at")).alias("out"))
    both = met.groupBy("a", "b").agg(F.count("*").alias("places")).where("places > 1").select("a", "b")
    only = met.join(both, ["a", "b"], "left_anti").join(F.broadcast(often), ["source", "target"])  # pairs of activities
    for c in ("a", "b"):
        only = only.join(outside.toDF("source", "target", c, f"out_{c}"), ["source", "target", c])
    hoped = F.coalesce(F.try_divide((F.col("out_a") * F.col("out_b")).cast("double"), (2 * (F.col("all") - F.col("here"))).cast("double")), F.lit(0.0))
    return only.withColumn("hoped", hoped).where(F.col("hoped") >= F.lit(expected)).select("source", "target", "a", "b", F.col("n").alias("meetings"), F.round("hoped", 9).alias("expected_elsewhere"))


def team_sparsity(log: DataFrame, frequent: float = FREQUENT, expected: float = EXPECTED, by: str = "resource") -> DataFrame:
    """Per frequent pair of activities: the pairs of resources that meet at it, those of them that sparse_teams tells, their share."""
    every = written(meetings(log, by))
    met = every.groupBy("source", "target").agg(F.count("*").alias("pairs"), F.sum("n").alias("here"))
    often = met.withColumn("all", F.sum("here").over(Window.partitionBy())).where(F.col("here") >= F.lit(frequent) * F.col("all"))
    found = sparse_teams(log, frequent, expected, by, every).groupBy("source", "target").agg(F.count("*").alias("sparse"))
    told = often.join(found, ["source", "target"], "left").withColumn("sparse", F.coalesce("sparse", F.lit(0)))
    return told.select("source", "target", "pairs", "sparse", F.round(F.col("sparse") / F.col("pairs"), 9).alias("sparsity"))
