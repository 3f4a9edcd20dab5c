"""Near-duplicate groups by HyperMinHash.

1. Sketch. A text's set of word shingles is hashed; the hashes fall into buckets, and each bucket keeps, of its least
   hash, the count of leading zeros and a few mantissa bits, in 16 bits. Empty buckets copy the first filled one in an
   order of their own. Texts with equal sets are one class from here on, named by its least id; a class of very many
   copies is one row.
2. Bands. Bands of registers are bucketed. The center of a band is its member that shares the most bands with the most
   classes; every other member is attached to it, so a band of m classes makes m - 1 pairs.
3. Estimate. The share of equal registers, corrected for chance collisions, must not lie far under the threshold.
4. Verify. Full sets are fetched and compared exactly; what a class and its center don't share is the class's delta.
5. Meetings. Two classes of one band that are both linked to its center need no pair of their own. If one of them is
   not, a link between the two needs shared hashes in their deltas (see `meetings`, which says why this is exact); deltas
   are short, so few pairs meet. 3 and 4 again for them.
6. Components by contraction: each class points to its least neighbour, until no link is left.

All links between classes that share a band are found. At similarity 0.8, sets of very many shingles share none of the
40 bands of 5 registers with a chance of about 1e-7.

Cases: very long texts make large sets and are compared whole; a pair right on the threshold is a link; an empty table
gives an empty table; null and empty texts, and texts without words, have no shingles and stand alone; fewer words than a shingle has
make one shingle; rows with equal ids are one document with all their texts' links; a null id gives a null component
unless its text's group has an id; equal rows get equal results; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelake.llm import textvec
from tracelake.llm.common import cut, lookup, salted, small_batches, unused

BANDS, ROWS = 40, 5
BUCKETS = BANDS * ROWS
MANTISSA = 10
#: Chance that two different least hashes of a bucket share a register: same zeros (1/3) and same mantissa.
COLLISION = 1 / 3 / (1 << MANTISSA)
MARGIN = 6.0  # standard deviations that an estimate may lie under the threshold
BROADCAST_IDS = 1_000_000  # of 8 bytes
LINKS_A_TASK = 200_000
ROWS_AT_ONCE = 128  # texts that a worker holds as Python strings
NULL_IDS = 1 << 62  # classes without an id are named from here on
#: The buckets that each bucket asks when it is empty, itself first.
ASKED = np.argsort(textvec.mix(np.arange(BUCKETS * BUCKETS, dtype=np.uint64) + np.uint64(1)).reshape(BUCKETS, BUCKETS), axis=1)
ASKED = np.array([np.concatenate([[i], order[order != i]]) for i, order in enumerate(ASKED)])


def shingle_set(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of n words, A-Z lower-cased."""
    raw = textvec.LOWER[np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)]
    starts, ends = textvec.word_bounds(raw)
    if not len(starts):
        return np.empty(0, np.uint64)
    words = textvec.span_hashes(raw, starts, ends)
    k = min(n, len(words))
    out = words[: len(words) - k + 1]
    for i in range(1, k):
        out = textvec.pair_hashes(out, words[i : len(words) - k + 1 + i])
    if k < n:
        out = textvec.mix(out ^ np.uint64(k))
    return np.unique(out)


def registers(hashes: np.ndarray) -> np.ndarray:
    """One 16-bit register per bucket: leading zeros + 1 of the least hash, then its mantissa; 0 for an empty set.

    Where no hash fell, the register of the first filled bucket of those asked; so equal registers keep the chance J.
    """
    out = np.zeros(BUCKETS, np.uint16)
    if not len(hashes):
        return out
    bucket = (hashes >> np.uint64(40)) % np.uint64(BUCKETS)
    with np.errstate(over="ignore"):
        value = textvec.mix(hashes * np.uint64(0x9FB21C651E98DF25)) >> np.uint64(9)  # 55 bits
    packed = np.sort((bucket << np.uint64(55)) | value)
    bucket, first = np.unique(packed >> np.uint64(55), return_index=True)
    least = packed[first] & np.uint64((1 << 55) - 1)
    _, exponent = np.frexp((least >> np.uint64(3)).astype(np.float64))  # exact: 52 bits
    zeros = 52 - exponent  # 0 to 52
    aligned = least << (zeros + 9).astype(np.uint64)  # the leading one to bit 63
    mantissa = (aligned << np.uint64(1)) >> np.uint64(64 - MANTISSA)
    out[bucket.astype(np.int64)] = ((zeros + 1).astype(np.uint16) << np.uint16(MANTISSA)) | mantissa.astype(np.uint16)
    filled = out != 0
    return out if filled.all() else out[ASKED[np.arange(BUCKETS), filled[ASKED].argmax(axis=1)]]


def sketched(docs: DataFrame, key: str, text: str, n: int) -> DataFrame:
    """id, n, h1, h2 (digest of the set), regs of each row."""

    def make(batches):
        for batch in (whole.slice(at, ROWS_AT_ONCE) for whole in batches for at in range(0, whole.num_rows, ROWS_AT_ONCE)):
            counts, h1, h2, regs = [], [], [], []
            for value in batch.column(1).to_pylist():
                s = shingle_set(value, n)
                counts.append(len(s))
                with np.errstate(over="ignore"):
                    h1.append(int(textvec.mix(s).sum(dtype=np.uint64).view(np.int64)) if len(s) else 0)
                    h2.append(int(textvec.mix(s * np.uint64(0xA24BAED4963EE407)).sum(dtype=np.uint64).view(np.int64)) if len(s) else 0)
                regs.append(registers(s).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(regs, pa.binary())], ["id", "n", "h1", "h2", "regs"])

    return small_batches(docs).select(F.col(key).cast("bigint").alias("id"), F.col(text)).mapInArrow(make, "id bigint, n bigint, h1 bigint, h2 bigint, regs binary")


def banded(classes: DataFrame) -> DataFrame:
    """band, node of the classes."""
    width = 2 * ROWS
    keys = F.array(*[F.xxhash64(F.lit(i), F.substring(F.col("regs"), i * width + 1, width)) for i in range(BANDS)])
    return classes.select("node", F.explode(keys).alias("band"))


def attachments(classes: DataFrame) -> DataFrame:
    """center, node: every class beside the center of each band that it is in; written down."""
    bands = banded(classes)
    crowded = bands.groupBy("band").agg(F.count("*").alias("members")).where("members > 1")
    met = cut(bands.join(crowded, "band"))
    liked = met.groupBy("node").agg(F.sum("members").alias("liked"))
    centers = met.join(liked, "node").groupBy("band").agg(F.max(F.struct("liked", (-F.col("node")).alias("minus"))).alias("best"))
    pairs = met.join(centers.select("band", (-F.col("best.minus")).alias("center")), "band").where("node <> center")
    return cut(pairs.select("center", "node").distinct())


@F.pandas_udf(T.DoubleType())
def estimate_excess(a: pd.Series, b: pd.Series, least: pd.Series) -> pd.Series:
    """Collision-corrected share of equal registers, plus MARGIN standard deviations at 0.8, at most 1; least: hashes of the smaller set."""
    share = np.array([(np.frombuffer(x, np.uint16) == np.frombuffer(y, np.uint16)).mean() for x, y in zip(a, b, strict=True)])
    filled = BUCKETS * (1 - (1 - 1 / BUCKETS) ** least.to_numpy())
    deviation = (0.16 * (1 / filled + 1 / BUCKETS)) ** 0.5  # copied registers weigh filled ones unevenly
    return pd.Series(np.minimum(1.0, (share - COLLISION) / (1 - COLLISION) + MARGIN * deviation))


def estimated(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """pairs (a, b) with likely: whether sizes and registers let them be a link."""
    sketch = classes.select("node", "regs", "size")
    both = pairs.join(sketch.toDF("b", "regs_b", "size_b"), "b").join(sketch.toDF("a", "regs_a", "size_a"), "a")
    sizes = 100 * F.least("size_a", "size_b") >= percent * F.greatest("size_a", "size_b")
    return both.select("a", "b", (sizes & (estimate_excess("regs_a", "regs_b", F.least("size_a", "size_b")) >= percent / 100)).alias("likely"))


def full_sets(docs: DataFrame, ids: DataFrame, key: str, text: str, n: int) -> DataFrame:
    """node, set (hashes) of the documents named in ids."""

    def make(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([shingle_set(t, n).view(np.int64) for t in part.column(1).to_pylist()], pa.list_(pa.int64()))], ["node", "set"])

    wanted = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    named = docs.select(F.col(key).cast("bigint").alias("node"), F.col(text)).join(wanted, "node", "left_semi")
    return named.mapInArrow(make, "node bigint, set array<bigint>").where(F.size("set") > 0)


def unnamed_sets(docs: DataFrame, ids: DataFrame, classes: DataFrame, key: str, text: str, n: int) -> DataFrame:
    """The same for classes whose rows all lack an id; they are found by their digest."""
    unnamed = classes.where(F.col("node") >= NULL_IDS).select("node", "h1", "h2").join(ids, "node", "left_semi")

    def make(batches):
        for batch in batches:
            rows = [(int(textvec.mix(s).sum(dtype=np.uint64).view(np.int64)), s.view(np.int64)) for s in (shingle_set(t, n) for t in batch.column(0).to_pylist()) if len(s)]
            yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in rows], pa.int64()), pa.array([s for _, s in rows], pa.list_(pa.int64()))], ["h1", "set"])

    texts = docs.where(F.col(key).isNull()).select(F.col(text)).distinct()
    return texts.mapInArrow(make, "h1 bigint, set array<bigint>").join(unnamed, "h1").select("node", "set").dropDuplicates(["node"])


def compared(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """pairs (a, b) with both sizes, a key of a's set, what stands in one set only (delta), and linked."""
    left, right = sets.select("node", "set", F.xxhash64("set").alias("base")).toDF("a", "set_a", "base"), sets.toDF("b", "set_b")
    both = pairs.join(right, "b").join(left, "a")
    apart = F.concat(F.array_except("set_a", "set_b"), F.array_except("set_b", "set_a"))
    sized = both.select(*[c for c in pairs.columns], "base", F.size("set_a").cast("bigint").alias("size_a"), F.size("set_b").cast("bigint").alias("size_b"), apart.alias("delta"))
    return sized.withColumn("linked", links_at(F.size("delta").cast("bigint"), F.col("size_a") + F.col("size_b"), percent))


def links_at(apart: Column, sizes: Column, percent: int) -> Column:
    """Whether sets with `apart` hashes in one of them only, and `sizes` in all, are similar enough."""
    return (100 + percent) * apart <= (100 - percent) * sizes


def meetings(stars: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that may be links beside the stars: two classes of one center, one at least not linked to it.

    A class differs from its center by its delta, and two classes differ by what only one of their deltas holds. If x is
    not linked to the center, then x and y can only be a link if their deltas share a hash: without one, y is no nearer
    to x than the center is. How many they must share follows from the sizes. So deltas are put in order, rarest hash
    first; classes meet at a hash only if enough of both deltas is left from there on.
    """
    more, less = 100 + percent, 100 - percent
    open_ones = stars.groupBy("a", "base").agg(F.count("*").alias("members"), F.min("linked").alias("all")).where("members > 1 and not all").select("a", "base")
    one = ["a", "base", "b", "size_a", "size_b", "linked", "k"]
    sized = stars.join(open_ones, ["a", "base"]).withColumn("k", F.size("delta").cast("bigint")).withColumn("own", F.xxhash64("delta"))
    hashes = sized.select(*one, "own", F.explode("delta").alias("e"))
    common = hashes.groupBy("a", "base", "e").agg(F.count("*").alias("df")).where("df > 1")
    # hashes of one delta only come first in the order and meet nothing: what is left is counted from the end
    ranked = hashes.join(common, ["a", "base", "e"]).groupBy(*one, "own").agg(F.sort_array(F.collect_list(F.struct("df", "e"))).alias("es"))
    rows = ranked.select(*one, F.size("es").alias("shared"), F.posexplode("es").alias("at", "el"))
    rows = rows.select(*one, F.col("el.e").alias("e"), (F.col("shared") - F.col("at")).cast("bigint").alias("left"))
    within = percent * F.col("left") >= percent * F.col("k") - less * F.col("size_b")
    asks = ~F.col("linked") & within & (2 * more * F.col("left") >= more * F.col("k") - less * (F.col("size_b") + F.col("size_a")))
    answers = within & (2 * more * F.col("left") > more * F.col("k") - less * (F.col("size_b") - F.col("size_a")))
    rows = cut(rows.select("a", "base", "e", "b", "size_b", "linked", "k", "left", asks.alias("asks"), answers.alias("answers")).where("asks or answers"))
    x = rows.where("asks").select("a", "base", "e", F.col("b").alias("x"), F.col("size_b").alias("nx"), F.col("k").alias("kx"), F.col("left").alias("left_x"))
    y = rows.where("answers").select("a", "base", "e", F.col("b").alias("y"), F.col("size_b").alias("ny"), F.col("k").alias("ky"), F.col("left").alias("left_y"), F.col("linked").alias("never_asks"))
    enough = links_at(F.col("kx") + F.col("ky") - 2 * F.least("left_x", "left_y"), F.col("nx") + F.col("ny"), percent)
    met = x.join(y, ["a", "base", "e"]).where((F.col("x") != F.col("y")) & (F.col("never_asks") | (F.col("x") < F.col("y"))) & enough)
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """node, root (the least node that it reaches) of every node with a link. Links are contracted round by round."""
    maps, edges, first = [], cut(links.select("a", "b").where(F.col("a") != F.col("b"))), None
    while left := edges.count():
        tasks = 1 + 2 * left // LINKS_A_TASK  # links are few beside documents; so are the files of each round
        first = first or tasks
        both = edges.union(edges.select("b", "a")).toDF("node", "other")
        to = cut(both.groupBy("node").agg(F.min("other").alias("least")).select("node", F.least("node", "least").alias("to")).coalesce(tasks))
        step = lambda n: to.toDF(f"to{n - 1}" if n else "node", f"to{n}")  # noqa: B023, E731
        # four pointers are followed at once; where a chain is longer, the next rounds go on with it
        to = cut(step(0).join(step(1), "to0").join(step(2), "to1").join(step(3), "to2").select("node", F.col("to3").alias("to")).coalesce(tasks))
        maps.append(to)
        moved = edges.join(to.toDF("a", "ta"), "a").join(to.toDF("b", "tb"), "b")
        edges = cut(moved.where(F.col("ta") != F.col("tb")).select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct().coalesce(tasks))
    if not maps:
        return links.select(F.col("a").alias("node"), F.col("a").alias("root")).limit(0)
    found = maps[-1].toDF("node", "root")
    for to in reversed(maps[:-1]):
        found = to.join(found.toDF("to", "root"), "to", "left").select("node", F.coalesce("root", "to").alias("root"))
    return cut(found.coalesce(first))


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """Per row: key, n_shingles, component_id, kept (the row's id is its component's)."""
    rows = cut(salted(sketched(docs, key, text, words)))
    surrogate = F.lit(NULL_IDS) + F.col("h1").bitwiseAND(F.lit(NULL_IDS - 1))
    classes = rows.where(F.col("n") > 0).groupBy("h1", "h2").agg(F.min("id").alias("least"), F.first("n").alias("size"), F.first("regs").alias("regs"))
    classes = cut(classes.select("h1", "h2", F.coalesce("least", surrogate).alias("node"), "size", "regs"))

    # centers with one class only matter if the two may be a link; the others' deltas are needed all the same
    pairs = cut(estimated(attachments(classes).toDF("a", "b"), classes, percent))
    alone = pairs.groupBy("a").agg(F.count("*").alias("members"), F.max("likely").alias("any")).where("members > 1 or any").select("a")
    pairs = pairs.join(alone, "a", "left_semi")
    ids = cut(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    sets = full_sets(docs, ids, key, text, words).where(F.col("node") < NULL_IDS).union(unnamed_sets(docs, ids, classes, key, text, words))
    sets = cut(sets)
    stars = cut(compared(pairs, sets, percent).withColumn("linked", F.col("linked") & F.col("likely")))
    likely = estimated(meetings(stars, percent), classes, percent).where("likely").select("a", "b")
    links = stars.where("linked").select("a", "b").union(compared(likely, sets, percent).where("linked").select("a", "b"))
    roots = components(links)

    named = classes.join(roots, "node", "left").select("h1", "h2", F.coalesce("root", "node").alias("root"))
    joined = lookup(rows.select("id", "n", "h1", "h2", "salt"), named, ["h1", "h2"])  # copies by the million share a digest
    component = F.when(F.col("n") == 0, F.col("id")).when(F.col("root") < NULL_IDS, F.col("root"))
    kept = F.when(F.col("n") == 0, F.lit(True)).otherwise(F.coalesce(F.col("id") == component, F.lit(False)))
    return joined.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"), kept.alias("kept"))


def remove_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """docs with one document of each group; all columns stay as they are. Rows without an id are all kept."""
    to = unused("gone", docs)
    gone = cut(groups(docs, key, text, words, percent).where(~F.col("kept") & F.col(key).isNotNull()).select(F.col(key).alias(to)).distinct())
    small = gone.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(gone) if small else gone, F.col(f"`{key}`").cast("bigint") == F.col(to), "left_anti")


#: The rows of groups for pairs of words in SQL, all pairs of sets that share a hash compared.
SQL = r"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM words),
classes AS (SELECT min(doc_id) AS node, list_sort(s) AS s, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY list_sort(s), len(s)),
each AS (SELECT node, n, unnest(s) AS e FROM classes),
common AS (SELECT a.node AS x, b.node AS y FROM each a JOIN each b ON a.e = b.e AND a.node < b.node AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
links AS (SELECT x, y FROM common UNION ALL SELECT y, x FROM common),
reached(x, y) AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reached r JOIN links l ON r.y = l.x),
roots AS (SELECT x AS node, least(x, min(y)) AS root FROM reached GROUP BY x)
SELECT doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, CASE WHEN len(s.s) = 0 THEN doc_id ELSE coalesce(root, node) END AS component_id, doc_id = CASE WHEN len(s.s) = 0 THEN doc_id ELSE coalesce(root, node) END AS kept
FROM sets s LEFT JOIN classes c ON c.n = len(s.s) AND c.s = list_sort(s.s) LEFT JOIN roots USING (node)
"""
