"""Near duplicates by SimHash, found by a grid over counts of bits.

1. Fingerprint. The shingles of a text, repeats included, are hashed to 64 bits; a bit of the fingerprint is set if more
   than half of the hashes have it. Equal fingerprints are one class from here on, named by its least id, so a million
   copies are one row.
2. Embedding. A fingerprint is cut into 32 segments of two bits, and each segment gives its count of set bits. One changed
   bit changes one count by one, so the Manhattan distance of the counts is never above the number of differing bits.
   The counts are written in unary (01 for one, 11 for two) into one number; then that distance is the bit count of an
   exclusive or.
3. Grid. A pair within distance 3 lies within distance 1 in one half of the 32 counts. So the grid has two layers, one for
   each half, whose cells hold the fingerprints with equal counts in that half. Every fingerprint stands in its own two
   cells and visits those that come next along each axis; of two neighbours in a layer one visits the other's cell. No
   pair is lost, and only pairs within distance 1 in a half meet.
4. Verify. Within a cell the Manhattan distance of all counts sorts out, then the exclusive or of the fingerprints
   decides. A cell gives a forest of its links, not all of its pairs. A cell of more than CELL fingerprints is dealt out
   in blocks, each pair of blocks a task's work on its own, so no task holds more than two blocks.
5. Components by contraction, joined back through salted keys, so that copies by the million spread over tasks.

Cases: null and empty texts and texts without words have fingerprint zero and are linked like any other; fewer words
than a shingle has make one shingle; a very long text is one row, hashed in pieces; exactly half of the hashes leave a bit
unset; rows with equal ids stand each for themselves; a null id names no component unless its class has no other, then
the component is null; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import SALTS, cut, lookup, salted, small_batches, unused
from tracelake.llm.neardup import components

SHINGLE, SEED, NEAR = 3, 42, 3
SEGMENTS = 32
CELL = 512  # fingerprints of a cell that one block holds
SMALL = 16  # rows of a cell that are compared by shifting
HASHES_AT_ONCE = 1 << 15
LOW = 0x5555555555555555  # the lower bit of each segment


def fingerprint(text: bytes | None, n: int = SHINGLE) -> int:
    """The fingerprint of a text in UTF-8, as a signed number."""
    words = (text or b"").lower().split()  # of bytes: A-Z only, and white space as in common.SPACE_WORD
    if not words:
        return 0
    shingles = zip(*[words[i:] for i in range(n)]) if len(words) >= n else [words]
    hash_of, join = xxhash.xxh64_intdigest, b" ".join
    votes, total, piece = np.zeros(64, np.int64), 0, []

    def count(hashes: list[int]) -> None:
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8), bitorder="little")
        np.add(votes, bits.reshape(-1, 64).sum(axis=0, dtype=np.int64), out=votes)

    for s in shingles:
        piece.append(hash_of(join(s), SEED))
        if len(piece) == HASHES_AT_ONCE:
            count(piece)
            total, piece = total + len(piece), []
    if piece:
        count(piece)
        total += len(piece)
    return int(np.packbits(2 * votes > total, bitorder="little").view("<i8")[0])


def fingerprinted(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = SHINGLE) -> DataFrame:
    """id, fp of every row."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array((fingerprint(t.as_py(), n) for t in batch.column(1)), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), found], ["id", "fp"])

    return small_batches(docs).select(F.col(f"`{key}`").cast("bigint").alias("id"), F.col(f"`{text}`").cast("binary")).mapInArrow(make, "id bigint, fp bigint")


def counts(fp: Column) -> Column:
    """The counts of the segments, each in unary in its two bits."""
    upper = F.shiftrightunsigned(fp, 1)
    any_bit, both = fp.bitwiseOR(upper).bitwiseAND(F.lit(LOW)), fp.bitwiseAND(upper).bitwiseAND(F.lit(LOW))
    return any_bit.bitwiseOR(F.shiftleft(both, 1))


def stands(nodes: DataFrame) -> DataFrame:
    """layer, cell, fp: the two cells that a fingerprint stands in."""
    halves = F.array(F.col("u").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("u", 32))
    return nodes.select("fp", F.posexplode(halves).alias("layer", "cell"))


def visits(nodes: DataFrame) -> DataFrame:
    """layer, cell, fp: the cells one step on along an axis, where its count can grow: 0 to 01, 01 to 11."""
    one = lambda c, i: F.when(c.bitwiseAND(F.lit(1 << (2 * i))) == 0, c + (1 << (2 * i))).when(c.bitwiseAND(F.lit(2 << (2 * i))) == 0, c + (2 << (2 * i)))
    steps = F.array_compact(F.array(*[one(F.col("cell"), i) for i in range(SEGMENTS // 2)]))
    return stands(nodes).select("fp", "layer", F.explode(steps).alias("cell"))


def met(nodes: DataFrame) -> DataFrame:
    """layer, cell, i, j (blocks), fp, own: the rows of the cells in which somebody stands and two rows meet.

    Cells of up to CELL rows are one block; in larger ones a row goes to the pairs of blocks that its own takes part in.
    """
    rows = stands(nodes).withColumn("own", F.lit(True)).unionByName(visits(nodes).withColumn("own", F.lit(False)))
    sizes = rows.groupBy("layer", "cell").agg(F.count("*").alias("n"), F.count_if("own").alias("standing"))
    crowded = sizes.where("n > 1 and standing > 0").select("layer", "cell", F.ceil(F.col("n") / CELL).alias("blocks"))
    placed = rows.join(crowded, ["layer", "cell"]).withColumn("b", F.pmod(F.xxhash64("fp"), F.col("blocks")))
    others = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("o")
    return placed.select("layer", "cell", "fp", "own", "b", others).select("layer", "cell", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), "fp", "own")


def bits(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def unary(fp: np.ndarray) -> np.ndarray:
    low, upper = np.uint64(LOW), fp >> np.uint64(1)
    return ((fp | upper) & low) | (((fp & upper) & low) << np.uint64(1))


def near(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Which fingerprints link: the counts' Manhattan distance first, and exactly where it doesn't rule the pair out."""
    likely = bits(unary(a) ^ unary(b)) <= most
    likely[likely] = bits((a ^ b)[likely]) <= most
    return likely


def shifted(group: np.ndarray, fp: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """All links in groups of up to SMALL rows that stand one behind the other."""
    lefts, rights = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]
    for k in range(1, SMALL):
        same = np.flatnonzero(group[k:] == group[:-k])
        if not len(same):
            break
        linked = same[near(fp[same], fp[same + k], most)]
        lefts.append(fp[linked])
        rights.append(fp[linked + k])
    return np.concatenate(lefts), np.concatenate(rights)


def forest(fp: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Each fingerprint of a block pair beside the least one that it reaches within it."""
    u = unary(fp)
    linked = bits(u[:, None] ^ u[None, :]) <= most
    linked &= bits(fp[:, None] ^ fp[None, :]) <= most
    root = np.arange(len(fp))
    while True:
        least = np.where(linked, root[None, :], len(fp)).min(axis=1)
        least = least[least]
        if (least == root).all():
            break
        root = least
    moved = root != np.arange(len(fp))
    return fp[root[moved]], fp[moved]


def links(nodes: DataFrame, most: int = NEAR) -> DataFrame:
    """a, b: links that join all fingerprints that reach each other by up to `most` differing bits, not every pair."""
    if most > 3:
        raise ValueError(f"the grid's two layers hold pairs of up to 3 differing bits: {most}")
    dealt = ["layer", "cell", "i", "j"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                keys = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(4)], axis=1)
                fp = batch.column(4).to_numpy(zero_copy_only=False).view(np.uint64)
                rest = (keys, fp) if rest is None else (np.concatenate([rest[0], keys]), np.concatenate([rest[1], fp]))
            if rest is None or not len(rest[1]):
                continue
            keys, fp = rest
            turns = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            if batch is None:
                done = len(fp)
            elif len(turns):
                done = turns[-1]
            else:
                continue
            rest = (keys[done:], fp[done:])
            edges = np.concatenate([[0], turns[turns < done], [done]])
            sizes = np.diff(edges)
            group = np.repeat(np.arange(len(sizes)), sizes)
            small = np.repeat(sizes <= SMALL, sizes)
            found = [shifted(group[small], fp[:done][small], most)]
            found += [forest(np.unique(fp[edges[g] : edges[g + 1]]), most) for g in np.flatnonzero(sizes > SMALL)]
            a, b = (np.concatenate(side).view(np.int64) for side in zip(*found))
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    rows = met(nodes).select(*dealt, "fp").repartition(*dealt).sortWithinPartitions(*dealt)
    return rows.mapInArrow(compare, "a bigint, b bigint").where("a <> b").distinct()


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = SHINGLE, most: int = NEAR) -> DataFrame:
    """Per row: key, fingerprint (16 hexadecimal digits), component_id."""
    rows = cut(salted(fingerprinted(docs, key, text, words)))
    classes = cut(rows.groupBy("fp").agg(F.min("id").alias("least")))
    roots = components(links(classes.select("fp", counts(F.col("fp")).alias("u")), most)).toDF("fp", "root")
    linked = roots.join(classes, "fp").withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(SALTS)).cast("int"))
    ids = lookup(linked, linked.groupBy("root").agg(F.min("least").alias("of_all")), ["root"]).select("fp", "of_all")
    named = classes.join(ids, "fp", "left").select("fp", F.coalesce("of_all", "least").alias("component_id"))
    found = lookup(rows, named, ["fp"])
    return found.select(F.col("id").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def remove_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = SHINGLE, most: int = NEAR) -> DataFrame:
    """docs with the rows of each component's least id only; rows without an id stay, all columns too."""
    to = unused("gone", docs)
    gone = groups(docs, key, text, words, most).where(F.col(key) != F.col("component_id")).select(F.col(key).alias(to)).distinct()
    return docs.join(gone, F.col(f"`{key}`").cast("bigint") == F.col(to), "left_anti")
