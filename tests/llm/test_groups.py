"""Near duplicates, sharding, URL filters and the classifiers."""

import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest

from tracelake.llm import cotraining, neardup, sharding, toxicity, urls

ASCII_LOWER = {i: i + 32 for i in range(65, 91)}


def shingles(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(ASCII_LOWER))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} - {()}


def brute(rows, n):
    sets = [(d, shingles(t, n)) for d, t in rows]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    index = defaultdict(list)
    for i, (_, s) in enumerate(sets):
        for x in s:
            index[x].append(i)
    for i, (_, s) in enumerate(sets):
        for j, both in Counter(j for x in s for j in index[x] if j < i).items():
            if 100 * both >= 80 * (len(s) + len(sets[j][1]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (d, s) in enumerate(sets):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted((repr(d), len(s), repr(least.get(find(i)) if s else d)) for i, (d, s) in enumerate(sets))


@pytest.mark.parametrize("n", [2, 5])
def test_near_duplicates(spark, all_docs, n):
    long = [(5000 + i, " ".join(f"w{k}" for k in range(60)) + f" end{i} tail{i % 7}" + " x" * (i % 5)) for i in range(80)]
    chain = [(6000 + i, " ".join(f"c{k}" for k in range(3 * i, 3 * i + 60))) for i in range(30)]
    docs = all_docs.select("doc_id", "text").where("doc_id <> 3 or doc_id is null").union(spark.createDataFrame(long + chain, "doc_id long, text string"))
    got = neardup.groups(docs, words=n).collect()
    assert sorted((repr(r.doc_id), r.n_shingles, repr(r.component_id)) for r in got) == brute([(r.doc_id, r.text) for r in docs.collect()], n)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got if r.doc_id is not None)
    kept = neardup.remove_copies(docs, words=n)
    assert kept.columns == docs.columns and kept.where("doc_id between 5000 and 6999").count() == sum(r.kept for r in got if 5000 <= (r.doc_id or 0) < 7000)


def test_near_duplicates_in_large_bands(spark):
    """Copies with random edits, similar at 0.5 to 0.95, as large bands."""
    draw = random.Random(4)
    base = [f"b{k}" for k in range(120)]
    rows = [(i, " ".join(f"e{draw.randrange(9)}" if draw.random() < i % 10 / 60 else w for w in base[: 120 - i % 4])) for i in range(150)]
    rows += [(700, rows[30][1]), (None, rows[31][1] + " z"), (900, None)]
    got = neardup.groups(spark.createDataFrame(rows, "doc_id long, text string"), words=2).collect()
    assert sorted((repr(r.doc_id), r.n_shingles, repr(r.component_id)) for r in got) == brute(rows, 2)
    assert len({r.component_id for r in got}) > 10


def test_near_duplicates_of_nothing(spark):
    assert neardup.groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_sharding(all_docs):
    rows = sharding.report(all_docs).collect()
    assert len(rows) == all_docs.count()
    want = sorted((repr(d.doc_id), len((d.text or "").encode()) + 1, zlib.crc32((d.text or "").encode())) for d in all_docs.collect())
    assert sorted((repr(r.doc_id), r["size"], r.text_crc32) for r in rows) == want
    slots, load = defaultdict(list), Counter()
    for r in rows:
        slots[r.shard].append(r.slot)
        load[r.shard] += r["size"]
    assert sorted(slots) == list(range(8)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(load.values()) - min(load.values()) <= max(r["size"] for r in rows)


def test_map_versions():
    loads = {v: 100 + v % 7 for v in range(512)}
    first = sharding.first_map(loads, 8, 512)
    grown = sharding.rebalanced(first, loads, 9)
    total = Counter()
    for v, s in grown["slots"].items():
        total[s] += loads[v]
    moved = [v for v in loads if first["slots"][v] != grown["slots"][v]]
    assert grown["version"] == 2 and all(grown["slots"][v] == 8 for v in moved) and max(total.values()) - min(total.values()) < 220


URLS = [None, "", "no scheme", "http://Example.COM/en/7?x#y", "https://www.Spam-Farm.example.org/en/12.html", "http://a.example.net/de/8/", "http://net/de/", "ftp://x.net/de", "http://m.casino-win.example.net/fr/3/?q", "://", "http://xcom/en/", "http://org/es/1\n2", "http://a://b/c", "http://com?/en/"]


def test_urls(spark, tmp_path):
    pages = spark.createDataFrame([(i, u, "clash", "h") for i, u in enumerate([*URLS, URLS[3]])], "page_id long, url string, host string, html string").unionByName(spark.read.parquet("/root/testdata/sf0.001/pages.parquet").selectExpr("page_id + 100 as page_id", "url", "'c' as host", "html"))
    got = urls.report(pages).toPandas().sort_values("page_id").reset_index(drop=True)
    pages.select("page_id", "url").coalesce(1).write.parquet(str(tmp_path / "p"))
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/p/*.parquet'")
    want = con.execute(urls.SQL).df().sort_values("page_id").reset_index(drop=True)[got.columns]
    assert got.fillna("-").values.tolist() == want.fillna("-").values.tolist()
    assert got.verdict[4] == "block" and got.listed[4] and got.rule[5] == "example.net/de/8" and got["host"][12] == "a:"
    assert urls.report(pages, spark.createDataFrame([], "url string")).where("listed").count() == 0


def test_toxicity(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    odd = spark.createDataFrame([(None, None), (10**7, ""), (10**7 + 1, "x" * 20000), (10**7 + 1, "x" * 20000)], "doc_id long, text string")
    rows = toxicity.report(docs.select("doc_id", "text").union(odd), labels).collect()
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    held = [(r.predicted, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    assert len(rows) == docs.count() + 4 and sum(a == b for a, b in held) >= 0.93 * len(held)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows if r.doc_id is not None)
    assert [r.predicted for r in rows if r.doc_id is None or r.doc_id >= 10**7] == [0, 0, 0, 0]
    assert toxicity.report(docs.limit(5), labels.limit(0)).where("predicted = 1").count() == 0


def test_cotraining(spark, odd_docs):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = cotraining.report(docs, labels).collect()
    truth = {r.doc_id: r.quality for r in labels.collect()}
    judged = [(r.kept, bool(truth[r.doc_id])) for r in rows if r.doc_id in truth]
    assert len(rows) == docs.count() and sum(a == b for a, b in judged) > 0.95 * len(judged)
    assert cotraining.report(odd_docs, labels.limit(0)).where("not kept").count() == 0
    assert cotraining.report(odd_docs, labels).count() == odd_docs.count()
