"""Ranked lexical search by MaxScore, a shard at a time.

1. Index. Documents are read once, in shards of up to SHARD_DOCS: a shard is one row with the lengths of its documents and
   the postings of its terms, place in the shard and occurrences. Postings of terms that nobody asks for are left out.
2. Statistics. Numbers of documents and terms, and the documents of each term, are sums over all shards.
3. Search. In each shard an item's terms are put in order of their upper bounds: weight times the best share that any
   posting of the shard has. The terms at the low end whose bounds together stay under what the k-th best document has so
   far are non-essential: a document that holds no other term can't qualify. Documents of the essential terms are
   scored; the others' postings are only probed for those that can still qualify with all bounds that are left, and the
   rest goes. What a task holds of an item is its k best so far, from shard to shard.
4. Merge. The k best of each task meet in two steps, first by item and a spread of documents, then by item.

Bounds are never less than the scores, and a document level with the k-th best still qualifies, so the result is exact.
Items are asked in blocks of about TERMS_AT_ONCE pairs of item and term: what is broadcast has that bound, however many
items there are. An item is at most one block.

Cases: null texts and texts without terms count nowhere; items without terms, and terms that no document has, find
nothing; rows with an equal item id are one item with the terms of all; a null item id is an item too; repeated rows are
documents of their own and may both be ranked, a null id comes last among equal scores; a very long text is one row; an
empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelake.llm.common import alnum_words, cut, small_batches

TOP = 20
SHARD_DOCS, SHARD_POSTINGS = 8192, 2_000_000
TERMS_AT_ONCE = 1_000_000
SPREAD = 64
SHARD = "ids array<bigint>, lengths array<bigint>, terms array<binary>, dfs array<bigint>, docs array<int>, tfs array<bigint>"
#: Bytes between terms to spaces, A-Z to a-z, all others as they are.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def shard_row(ids: list, lengths: list[int], postings: dict[bytes, list[tuple[int, int]]]) -> pa.RecordBatch:
    """One shard: terms in order, their numbers of postings, and all postings one term behind the other."""
    terms = sorted(postings)
    each = [p for t in terms for p in postings[t]]
    cells = [ids, lengths, terms, [len(postings[t]) for t in terms], [d for d, _ in each], [n for _, n in each]]
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array([c], pa.list_(k)) for c, k in zip(cells, kinds)], ["ids", "lengths", "terms", "dfs", "docs", "tfs"])


def index(docs: DataFrame, asked: list[bytes] | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Shards of all documents with a term. asked: the terms whose postings are kept; None for all."""
    wanted = None if asked is None else docs.sparkSession.sparkContext.broadcast(frozenset(asked))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, lengths, postings, held = [], [], {}, 0
        for batch in batches:
            for doc, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = (t.as_py() or b"").translate(TERM_BYTES).split()
                if not words:
                    continue
                for term, n in Counter(words if wanted is None else filter(wanted.value.__contains__, words)).items():
                    postings.setdefault(term, []).append((len(ids), n))
                    held += 1
                ids.append(doc)
                lengths.append(len(words))
                if len(ids) == SHARD_DOCS or held >= SHARD_POSTINGS:
                    yield shard_row(ids, lengths, postings)
                    ids, lengths, postings, held = [], [], {}, 0
        if ids:
            yield shard_row(ids, lengths, postings)

    return small_batches(docs).select(F.col(f"`{key}`").cast("bigint"), F.col(f"`{text}`").cast("binary")).mapInArrow(make, SHARD)


def asked_terms(items: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """item, term (UTF-8), n: the terms of each item and how often it has them."""
    each = items.select(F.col(f"`{key}`").alias("item"), F.explode(alnum_words(F.col(f"`{text}`"))).alias("term"))
    return each.groupBy("item", F.col("term").cast("binary").alias("term")).agg(F.count("*").alias("n"))


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


class Shard:
    """A shard's postings with their shares of a score, tf against length, and each term's best share."""

    def __init__(self, row: dict, documents: int, total: int):
        self.ids, lengths = row["ids"], np.array(row["lengths"], np.int64)
        if 25 * documents * int(lengths.max()) < 1 << 63:
            m = 75 + 25 * documents * lengths // total
        else:
            m = np.array([75 + 25 * documents * n // total for n in lengths.tolist()], np.int64)
        self.docs, tfs = np.array(row["docs"], np.int64), np.array(row["tfs"], np.int64)
        self.shares = 1_000_000_000 * tfs // (1000 * tfs + 12 * m[self.docs])
        self.ends = np.cumsum(row["dfs"], dtype=np.int64)
        self.places = {t: i for i, t in enumerate(row["terms"])}
        self.best = np.maximum.reduceat(self.shares, np.concatenate([[0], self.ends[:-1]])) if len(self.shares) else self.shares
        self.scores = np.zeros(len(lengths), np.int64)

    def postings(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        span = slice(self.ends[i - 1] if i else 0, self.ends[i])
        return self.docs[span], self.shares[span]


def qualified(shard: Shard, terms: list[tuple[bytes, int]], floor: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of the documents that score `floor` or more, and at least all of the shard's k best that do.

    terms: each with its weight times its repeats in the item. floor: 1 or more.
    """
    lists = sorted((w * int(shard.best[i]), i, w) for t, w in terms if w > 0 and (i := shard.places.get(t)) is not None)
    upto = np.cumsum([b for b, _, _ in lists], dtype=np.int64)  # upto[j]: most that lists 0 to j can give
    essential = int(np.searchsorted(upto, floor))  # lists before this one can't reach the floor together
    scores, none = shard.scores, np.empty(0, np.int64)
    if essential == len(lists):
        return none, none
    found = []
    for _, i, w in lists[essential:]:
        docs, shares = shard.postings(i)
        scores[docs] += w * shares
        found.append(docs)
    touched = np.unique(np.concatenate(found))
    left = touched
    for j in range(essential - 1, -1, -1):
        if len(left) > k:
            floor = max(floor, int(np.partition(scores[left], len(left) - k)[len(left) - k]))  # k documents have it already
        left = left[scores[left] + upto[j] >= floor]
        if not len(left):
            break
        docs, shares = shard.postings(lists[j][1])
        at = np.minimum(np.searchsorted(docs, left), len(docs) - 1)
        held = docs[at] == left
        scores[left[held]] += lists[j][2] * shares[at[held]]
    left = left[scores[left] >= floor]
    told = left, scores[left].copy()
    scores[touched] = 0
    return told


def first(ids: list, scores: list[int], k: int) -> tuple[list, list[int]]:
    """The k best: highest score, then least id, null last."""
    order = sorted(range(len(ids)), key=lambda r: (-scores[r], ids[r] is None, ids[r] or 0))[:k]
    return [ids[r] for r in order], [scores[r] for r in order]


def searched(shards: DataFrame, asked: dict[int, list[tuple[bytes, int]]], documents: int, total: int, k: int) -> DataFrame:
    """item (its number), doc_id, score: of each task, the k best documents of each item."""
    shared = shards.sparkSession.sparkContext.broadcast(asked)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[list, list[int]]] = {}
        for row in (row for batch in batches for at in range(batch.num_rows) for row in batch.slice(at, 1).to_pylist()):
            shard = Shard(row, documents, total)
            for item, terms in shared.value.items():
                ids, scores = best.get(item, ([], []))
                places, more = qualified(shard, terms, max(1, scores[-1]) if len(scores) == k else 1, k)
                if len(places):
                    if len(places) > k:
                        enough = more >= np.partition(more, len(more) - k)[len(more) - k]
                        places, more = places[enough], more[enough]
                    best[item] = first(ids + [shard.ids[p] for p in places], scores + more.tolist(), k)
        rows = [(item, d, s) for item, (ids, scores) in best.items() for d, s in zip(ids, scores)]
        columns = zip(*rows) if rows else ([], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64()))], ["item", "doc_id", "score"])

    return shards.mapInArrow(search, "item bigint, doc_id bigint, score bigint")


def top(found: DataFrame, k: int) -> DataFrame:
    """item, rank, doc_id, score of the k best of each item; no task gets more than a spread's share of an item's rows."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    near = found.withColumn("spread", F.pmod(F.xxhash64("doc_id", "score"), F.lit(SPREAD)))
    near = near.withColumn("rank", F.row_number().over(Window.partitionBy("item", "spread").orderBy(*order))).where(F.col("rank") <= k)
    ranked = near.drop("rank").withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order)))
    return ranked.where(F.col("rank") <= k).select("item", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", k: int = TOP, terms_at_once: int = TERMS_AT_ONCE) -> DataFrame:
    """item, rank, doc_id, score: the k best documents of each item that score above 0."""
    asked = cut(asked_terms(items, item, item_text))
    pairs = asked.count()
    blocks = max(1, math.ceil(pairs / terms_at_once))
    # one block's terms are few, so only their postings are kept; with more blocks the index holds all terms
    terms = [bytes(r.term) for r in asked.select("term").distinct().collect()] if blocks == 1 else None
    shards = cut(index(docs, terms, key, text))
    sums = shards.agg(F.sum(F.size("ids").cast("bigint")).alias("n"), F.sum(F.aggregate("lengths", F.lit(0).cast("bigint"), lambda s, x: s + x)).alias("total")).head()
    held = shards.select(F.explode(F.arrays_zip("terms", "dfs")).alias("x")).select(F.col("x.terms").alias("term"), F.col("x.dfs").alias("df"))
    known = held.join(F.broadcast(asked.select("term").distinct()) if blocks == 1 else asked.select("term").distinct(), "term").groupBy("term").agg(F.sum("df").alias("df"))
    weighed = cut(asked.join(known, "term").withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks))))
    kind = T.StructType([T.StructField("number", T.LongType()), T.StructField(item, items.schema[item].dataType)])
    told = None
    for block in range(blocks):
        of, number = {}, {}
        for r in weighed.where(F.col("block") == block).collect():  # about terms_at_once rows
            of.setdefault(number.setdefault(r.item, len(number)), []).append((bytes(r.term), r.n * weight(sums.n, r.df)))
        names = docs.sparkSession.createDataFrame([(n, i) for i, n in number.items()], kind)
        found = top(searched(shards, of, sums.n or 0, sums.total or 0, k), k).join(F.broadcast(names), F.col("item") == F.col("number"))
        found = found.select(F.col(item), F.col("rank").cast("int").alias("rank"), "doc_id", "score")
        told = found if told is None else told.unionByName(found)
    return told


#: The same rows in SQL, every document scored.
SQL = r"""
WITH words AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
docs AS (SELECT rid, doc_id, w, CAST(len(w) AS BIGINT) AS n FROM words WHERE len(w) > 0),
corpus AS (SELECT CAST(count(*) AS BIGINT) AS big_n, CAST(sum(n) AS BIGINT) AS big_l FROM docs),
tfs AS (SELECT rid, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT rid, unnest(w) AS term FROM docs) GROUP BY rid, term),
dfs AS (SELECT term, CAST(count(*) AS BIGINT) AS df FROM tfs GROUP BY term),
weights AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * big_n + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS weight FROM dfs, corpus),
asked AS (SELECT item_id, term, count(*) AS q FROM (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY item_id, term),
scored AS (SELECT item_id, t.rid, CAST(sum(q * weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * big_n) // big_l)))) AS BIGINT) AS score
  FROM asked JOIN weights USING (term) JOIN tfs t USING (term) JOIN docs d ON d.rid = t.rid, corpus GROUP BY item_id, t.rid)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id ASC NULLS LAST) AS rank FROM scored JOIN docs USING (rid) WHERE score > 0)
WHERE rank <= 20
"""
