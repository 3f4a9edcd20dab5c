"""Ranked search against a plain scorer, over many small shards, ties, repeats and blocks of items."""

import math
import random
import re
from collections import Counter

import duckdb
import pytest

from tracelake.llm import search

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def words(text):
    return [w.translate(LOWER) for w in WORD.findall(text or "")]


def plain(docs, items, k=20):
    each = [(d, Counter(words(t))) for d, t in docs]
    each = [(d, c, c.total()) for d, c in each if c]
    big_n, big_l = len(each), sum(n for _, _, n in each)
    df = Counter(w for _, c, _ in each for w in c)
    asked = {}
    for item, text in items:
        asked.setdefault(item, Counter()).update(words(text))
    out = []
    for item, terms in asked.items():
        scored = []
        for d, c, n in each:
            m = 75 + 25 * n * big_n // big_l
            score = sum(q * math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 12 * m)) for w, q in terms.items() if w in c)
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        out += [(item, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def got(df, item="item_id"):
    return sorted(((r[item], r["rank"], r.doc_id, r.score) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def corpus():
    draw = random.Random(5)
    vocabulary = [f"w{i}" for i in range(60)] + ["ÉTÉ", "naïve"]
    texts = [" ".join(draw.choices(vocabulary, weights=[1 / (i + 1) for i in range(62)], k=draw.randrange(1, 60))) for _ in range(400)]
    texts += [texts[3]] * 45 + ["W1, w2; W3!"] * 30 + [None, "", " .,; ", "w59 " * 100_000]
    docs = [(i, t) for i, t in enumerate(texts)] + [(7, "w59 w58"), (None, texts[3]), (2**60, texts[3])]
    draw.shuffle(docs)
    items = [(i, " ".join(draw.choices(vocabulary, k=draw.randrange(1, 12)))) for i in range(25)] + [(90, "w1 W1 w1 w40"), (91, None), (92, "nowhere"), (None, "w59 w3"), (3, "w2 w2 w50")]
    return docs, items


@pytest.mark.parametrize(("shard", "at_once"), [(8192, 1_000_000), (7, 1_000_000), (40, 30)])
def test_ranks(spark, corpus, monkeypatch, shard, at_once):
    docs, items = corpus
    monkeypatch.setattr(search, "SHARD_DOCS", shard)
    d, b = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    # a worker reads the module anew, so small shards are made by few rows a partition as well
    d = d.repartition(40) if shard < 100 else d
    assert got(search.search(d, b, terms_at_once=at_once)) == plain(docs, items)


def test_small_shards(corpus):
    """Shard after shard with the best so far as the floor: what qualified leaves out can't be among the best."""
    docs, items = corpus
    each = [(d, words(t)) for d, t in docs if words(t)]
    big_n, big_l = len(each), sum(len(w) for _, w in each)
    df = Counter(x for _, w in each for x in set(w))
    left_out = 0
    for item, text in items:
        if item in (3, None) or not text:
            continue
        terms = [(w.encode(), q * search.weight(big_n, df[w])) for w, q in Counter(words(text)).items() if df[w]]
        ids, scores = [], []
        for at in range(0, len(each), 30):
            part, postings = each[at : at + 30], {}
            for i, (_, w) in enumerate(part):
                for x, n in Counter(w).items():
                    postings.setdefault(x.encode(), []).append((i, n))
            row = search.shard_row([d for d, _ in part], [len(w) for _, w in part], postings).to_pylist()[0]
            shard = search.Shard(row, big_n, big_l)
            places, more = search.qualified(shard, terms, max(1, scores[-1]) if len(scores) == 5 else 1, 5)
            assert not shard.scores.any()
            left_out += len({d for t, _ in terms for d, _ in postings.get(t, [])}) - len(places)
            ids, scores = search.first(ids + [shard.ids[p] for p in places], scores + more.tolist(), 5)
        want = [(d, s) for i, _, d, s in plain(docs, [(item, text)], 5)]
        assert sorted(zip(ids, scores), key=repr) == sorted(want, key=repr)
    assert left_out > 1000


def test_names_and_types(spark):
    docs = spark.createDataFrame([(1, "red fish", "x"), (2, "blue fish fish", "y"), (3, "stone", "z")], "doc_id long, text string, score string")
    items = spark.createDataFrame([("a", "Fish", 1), ("b", "red stone", 2)], "item_id string, text string, rank int")
    rows = got(search.search(docs, items))
    assert [(i, r, d) for i, r, d, _ in rows] == [("a", 1, 2), ("a", 2, 1), ("b", 1, 3), ("b", 2, 1)]
    assert got(search.search(docs.limit(0), items)) == got(search.search(docs, items.limit(0))) == []


def test_sql(spark, tmp_path):
    docs, items = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "benchmark"))
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '/root/testdata/sf0.001/{t}.parquet'")
    names = ["item_id", "rank", "doc_id", "score"]
    assert got(search.search(docs, items)) == sorted(map(tuple, con.execute(search.SQL).df()[names].values.tolist()), key=repr)
