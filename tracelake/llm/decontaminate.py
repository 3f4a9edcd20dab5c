"""Benchmark decontamination: windows of test words in a broadcast hash set, which a scan of all texts' windows meets.

1. Every window of `width` consecutive benchmark words (a shorter item is one window) is hashed. The hashes are broadcast
   as the hash side of a join while their counted number is within `broadcast_windows`; beyond it the same join shuffles,
   with salted keys, since a common window may stand in very many texts.
2. A document's windows of the same lengths are hashed and meet that set, one after the other. What is left are the few
   places with a hit; they are gathered by document, and equal rows share them.
3. Verify. The texts that have hits are cut again at these places, and a hit counts if the window holds the same words.
   Words are the exact ones in both: lower-casing by the rules of other alphabets would depend on what stands beside a word.
4. The verdict joins back to all rows: by broadcast while the counted hits are few, else by a shuffle with salted keys.

Cases: null or empty texts have no words and no hits; items without words have no window; repeated items and rows count
each on their own, rows with equal key and text alike; a very long text is one row, scanned in time that grows with its
length; an empty benchmark hits nothing, an empty table gives an empty table; other columns pass by whatever their
names are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import ALNUM_WORD, alnum_words, any_case, bind, cut, row_key, unused

WIDTH = 13
BROADCAST_WINDOWS = 100_000  # about 250 bytes each: 13 words, hash and items
BROADCAST_HITS = 200_000  # places, of about 50 bytes
SALTS = 16


def window_hash(words: Column, i: Column, n: int) -> Column:
    """Hash of n words from place i on, each fetched by its place: a slice would walk to it from the first. Places past
    the end change nothing."""
    return F.xxhash64(*[F.get(words, i + j) for j in range(n)])


def benchmark_windows(benchmark: DataFrame, item: str = "item_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """Distinct (n, window_hash, window, items): windows of n words each, and the items that hold them."""
    words = benchmark.select(F.col(item).cast("string").alias("item"), alnum_words(F.col(text)).alias("w")).where(F.size("w") > 0)
    n = F.least(F.size("w"), F.lit(width))
    each = words.select("item", "w", n.alias("n"), F.explode(F.sequence(F.lit(1), F.size("w") - n + 1)).alias("i"))
    cut = each.select("item", "n", F.slice("w", F.col("i"), F.col("n")).alias("part"))
    named = cut.select("n", window_hash(F.col("part"), F.lit(0), width).alias("window_hash"), F.array_join("part", " ").alias("window"), "item")
    return named.groupBy("n", "window_hash", "window").agg(F.collect_set("item").alias("items"))


def hashed_windows(words: Column, n: int) -> Column:
    """The windows of n words: array of i (start, from 0), n, h."""
    starts = F.when(F.size(words) >= n, F.sequence(F.lit(0), F.size(words) - n)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.struct(i.alias("i"), F.lit(n).alias("n"), window_hash(words, i, n).alias("h")))


def text_of(words: Column, x: Column) -> Column:
    """The words of a window as one text; words hold no spaces."""
    return F.array_join(F.transform(F.sequence(F.lit(0), x["n"] - 1), lambda j: F.get(words, x["i"] + j)), " ")


def span(x: Column) -> Column:
    return F.struct(x["i"].alias("first"), (x["i"] + x["n"] - 1).alias("last"))


def salted_join(rows: DataFrame, few: DataFrame, on: Column, how: str) -> DataFrame:
    """A join whose keys are dealt out SALTS times, by the place of a row: few, the smaller side, stands at every salt."""
    a, b = unused("salt_of_row", rows), unused("salt", few)
    spread = rows.withColumn(a, F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    every = few.withColumn(b, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return spread.join(every, on & (F.col(a) == F.col(b)), how).drop(a, b)


def near_hits(docs: DataFrame, known: DataFrame, sizes: list[int], key: str, text: str, broadcast: bool) -> DataFrame:
    """h1, h2 (the row's key and text), xs: the places whose window has the hash of a benchmark window; written down."""
    k1, k2 = row_key(F.col(f"`{key}`"), F.col(f"`{text}`"))
    windows = bind(alnum_words(F.col(f"`{text}`")), lambda w: F.concat(*[hashed_windows(w, n) for n in sizes]))
    each = docs.select(k1.alias("h1"), k2.alias("h2"), F.explode(windows).alias("x"))
    hashes = known.select("window_hash").distinct()
    same = F.col("x.h") == F.col("window_hash")
    met = each.join(F.broadcast(hashes), same, "left_semi") if broadcast else salted_join(each, hashes, same, "inner")
    return cut(met.groupBy("h1", "h2").agg(F.collect_set("x").alias("xs")))


def true_hits(docs: DataFrame, known: DataFrame, near: DataFrame, key: str, text: str, few: bool, broadcast: bool) -> DataFrame:
    """h1, h2, hits (at: first and last word, items): those of near_hits whose words are the benchmark's; written down."""
    k1, k2 = row_key(F.col(f"`{key}`"), F.col(f"`{text}`"))
    rows, same = docs.select(k1.alias("k1"), k2.alias("k2"), F.col(f"`{text}`").alias("t")), (F.col("k1") == F.col("h1")) & (F.col("k2") == F.col("h2"))
    again = rows.join(F.broadcast(near), same) if few else salted_join(rows, near, same, "inner")
    cut_out = bind(alnum_words(F.col("t")), lambda w: F.transform("xs", lambda x: F.struct(x["h"].alias("window_hash"), text_of(w, x).alias("window"), span(x).alias("at"))))
    true = again.select("h1", "h2", F.explode(cut_out).alias("x")).select("h1", "h2", "x.*").distinct()  # equal rows once
    true = true.join(F.broadcast(known) if broadcast else known, ["window_hash", "window"])
    return cut(true.groupBy("h1", "h2").agg(F.collect_list(F.struct("at", "items")).alias("hits")))


def covered(positions: Column) -> Column:
    """Number of words that the spans cover; they come sorted by first."""
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-1).alias("end"))
    step = lambda s, p: F.struct((s["n"] + F.greatest(p["last"] - F.greatest(p["first"] - 1, s["end"]), F.lit(0))).cast("bigint").alias("n"), F.greatest(s["end"], p["last"]).alias("end"))
    return F.aggregate(positions, start, step)["n"]


def judge(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", share: int = 20, width: int = WIDTH, broadcast_windows: int = BROADCAST_WINDOWS, broadcast_hits: int = BROADCAST_HITS) -> tuple[DataFrame, str]:
    """All rows and columns of docs and one more, whose name is returned too: a struct of n_words, n_hit, items,
    positions, contaminated (a word in `share` or more is hit)."""
    known = cut(benchmark_windows(benchmark, width=width))
    counts = {r.n: r["count"] for r in known.groupBy("n").count().collect()}  # at most `width` rows
    sizes, to = sorted(counts), unused("judged", docs)
    # as many as alnum_words gives, without cutting the text up
    n_words = F.coalesce(F.regexp_count(F.col(f"`{text}`"), F.lit(any_case(ALNUM_WORD))), F.lit(0)).cast("bigint")
    none = F.array().cast("array<struct<at:struct<first:int,last:int>,items:array<string>>>")

    def verdict(words: Column, hits: Column) -> Column:
        spans = lambda h: F.array_sort(F.array_distinct(F.transform(h, lambda x: x["at"])))
        items = lambda h: F.array_sort(F.array_distinct(F.flatten(F.transform(h, lambda x: x["items"]))))
        told = lambda h, at, n: F.struct(words.alias("n_words"), n.alias("n_hit"), items(h).alias("items"), at.alias("positions"), ((n > 0) & (share * n >= words)).alias("contaminated"))
        return bind(hits, lambda h: bind(spans(h), lambda at: bind(covered(at), lambda n: told(h, at, n))))

    if not sizes:
        return docs.withColumn(to, bind(n_words, lambda w: verdict(w, none))), to
    broadcast = sum(counts.values()) <= broadcast_windows
    near = near_hits(docs, known, sizes, key, text, broadcast)
    few = (near.agg(F.sum(F.size("xs").cast("bigint"))).head()[0] or 0) <= broadcast_hits
    a, b, c, d, found = (unused(n, docs) for n in ("row_a", "row_b", "hit_a", "hit_b", "hits"))
    hits = true_hits(docs, known, near, key, text, few, broadcast).toDF(c, d, found)
    k1, k2 = row_key(F.col(f"`{key}`"), F.col(f"`{text}`"))
    rows, same = docs.withColumn(a, k1).withColumn(b, k2), (F.col(a) == F.col(c)) & (F.col(b) == F.col(d))
    joined = rows.join(F.broadcast(hits), same, "left") if few else salted_join(rows, hits, same, "left")
    # one expression that names the text once, so a filter on the verdict works it out once
    return joined.withColumn(to, bind(n_words, lambda w: verdict(w, F.coalesce(found, none)))).drop(a, b, c, d, found), to


def report(docs: DataFrame, benchmark: DataFrame, **bounds: int) -> DataFrame:
    """Per row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    marked, to = judge(docs.select("doc_id", "text"), benchmark, **bounds)
    return marked.select(
        "doc_id",
        f"{to}.n_words",
        f"{to}.n_hit",
        F.size(f"{to}.items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(f"{to}.items", ","), 256).alias("items_sha256"),
        f"{to}.contaminated",
    )


def remove_documents(docs: DataFrame, benchmark: DataFrame, **bounds: int) -> DataFrame:
    """docs without the contaminated rows; all columns stay as they are."""
    marked, to = judge(docs, benchmark, **bounds)
    # coalesce: otherwise Spark adds a test for null, which works the verdict out a second time
    return marked.where(F.coalesce(~F.col(f"{to}.contaminated"), F.lit(True))).drop(to)


def remove_spans(docs: DataFrame, benchmark: DataFrame, text: str = "text", **bounds: int) -> DataFrame:
    """docs with the hit words taken out of contaminated texts; such texts become lower-cased words joined by spaces."""
    marked, to = judge(docs, benchmark, text=text, **bounds)
    kept = F.filter(alnum_words(F.col(f"`{text}`")), lambda _, i: ~F.exists(f"{to}.positions", lambda p: i.between(p["first"], p["last"])))
    return marked.withColumn(text, F.when(F.col(f"{to}.contaminated"), F.array_join(kept, " ")).otherwise(F.col(f"`{text}`"))).drop(to)


#: The same rows in SQL.
SQL = r"""
WITH words AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
starts AS (SELECT item, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM items WHERE len(w) > 0),
windows AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS t FROM starts),
places AS (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM words, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n),
hits AS (SELECT rid, i, p.n, item FROM places p JOIN windows v ON v.n = p.n AND v.t = array_to_string(p.w[i:i + p.n - 1], ' ')),
covered AS (SELECT rid, count(DISTINCT place) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS place FROM hits) GROUP BY rid),
named AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list FROM (SELECT DISTINCT rid, item FROM hits) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated
FROM words LEFT JOIN covered USING (rid) LEFT JOIN named USING (rid)
"""
