"""What must not grow with a square: texts with many thousand spans, equal rows, two runs at once."""

import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tracelake.llm import decontaminate, neardup, secrets, sharding, urls
from tracelake.llm.spans import replace_spans


def plain_replaced(text, spans, by):
    out, at = [], 0
    joined = []
    for s, e in spans:
        if joined and s <= joined[-1][1]:
            joined[-1][1] = max(joined[-1][1], e)
        else:
            joined.append([s, e])
    for s, e in joined:
        out += [text[at:s], by]
        at = e
    return "".join([*out, text[at:]])


@pytest.mark.parametrize("n", [0, 1, 2, 255, 256, 257, 600])
def test_replacing(spark, n):
    text = "\U0001f600é-x" * (n + 3)
    spans = [(3 * i, 3 * i + 2 + i % 3) for i in range(n)] if n != 2 else [(0, 4), (len(text) - 1, len(text))]
    df = spark.createDataFrame([(text, spans)], "text string, spans array<struct<start:int,end:int>>")
    assert df.select(replace_spans(F.col("text"), F.col("spans"), "#").alias("t")).head().t == plain_replaced(text, spans, "#")


def test_redaction_is_linear(spark):
    took = {}
    for n in (500, 4000):
        docs = spark.createDataFrame([(1, "password=abcdefghijkl1234 and more of it; " * n, 0)], "doc_id long, text string, n_chars long")
        began = time.perf_counter()
        row = secrets.redact(docs).head()
        took[n] = time.perf_counter() - began
        assert row.text == f"{secrets.MASK} and more of it; " * n and row.n_chars == len(row.text)
    assert took[4000] < 20 * took[500]


def test_removed_spans_by_thousands(spark):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen"
    docs = spark.createDataFrame([(1, (item + " stop here ") * 3000)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    assert decontaminate.remove_spans(docs, bench).head().text == "stop here " * 2999 + "stop here"
    row = decontaminate.report(docs, bench).head()
    assert (row.n_words, row.n_hit, row.n_items, row.contaminated) == (45_000, 39_000, 1, True)


def test_equal_rows(spark):
    """A third of all rows equal: each operator gives them all their row, spread over parts and salts."""
    docs = spark.range(6000).selectExpr("if(id % 3 = 0, 0, id) AS doc_id", "if(id % 3 = 0, 'the very same text of all of these', concat('text number ', id, ' of its own')) AS text")
    rows = sharding.report(docs).collect()
    of = {}
    for r in rows:
        of.setdefault(r.shard, []).append(r.slot)
    assert len(rows) == 6000 and all(sorted(s) == list(range(len(s))) for s in of.values())
    parts = sharding.measured(docs).withColumn("__part", F.pmod(F.monotonically_increasing_id(), F.lit(sharding.PARTS))).groupBy("__virtual", "__part").count().agg(F.max("count")).head()[0]
    assert parts < 200
    near = Counter((r.component_id, r.kept) for r in neardup.groups(docs).where("doc_id = 0").collect())
    assert near == {(0, True): 2000}
    bench = spark.createDataFrame([(1, "very same text"), (2, "number 7 of its own")], "item_id long, text string")
    for bound in (10**6, 0):
        hit = Counter((r.n_hit, r.contaminated) for r in decontaminate.report(docs, bench, broadcast_windows=bound, broadcast_hits=bound).collect())
        assert hit == {(3, True): 2000, (5, True): 1, (0, False): 3999}


def test_map_named_meanwhile(spark, tmp_path):
    """A version that another run has named in between is not overwritten: the next one is made on top of it."""
    at, loads = str(tmp_path / "map"), {v: 10 + v % 3 for v in range(64)}
    first = sharding.current_map(spark, loads, 4, at, 64)
    assert not sharding.store_map(spark, first, loads, at) and sharding.stored_versions(spark, at) == [1]
    lost = sharding.rebalanced(first, loads, 5)
    other = sharding.current_map(spark, loads, 6, at, 64)
    assert other["version"] == 2 and not sharding.store_map(spark, lost, loads, at)
    assert sharding.current_map(spark, loads, 5, at, 64)["version"] == 3 and sharding.load_map(spark, at)[0]["shards"] == 5
    assert not [p.name for p in (tmp_path / "map").iterdir() if p.name.startswith("_new")]


def test_pages_without_a_host(spark):
    pages = spark.range(3000).selectExpr("id AS page_id", "if(id % 3 = 0, null, if(id % 3 = 1, 'no scheme', concat('http://h.example.org/p/', id))) AS url")
    for bound in (urls.BROADCAST_BLOCKS, 0):
        rows = urls.judge(pages, urls.default_list(spark).limit(50), broadcast_blocks=bound).collect()
        assert Counter((r["__host"], r["__verdict"], r["__listed"]) for r in rows) == {("", "allow", False): 2000, ("h.example.org", "allow", False): 1000}
    with pytest.raises(ValueError, match="underscores"):
        urls.judge(pages.withColumn("__host", F.lit(1)), urls.default_list(spark))
