"""Co-training: what is handed over, against a plain loop, and that it helps."""

import random

import numpy as np
import pytest

from tracelake.llm import cotraining as ct

SCHEMA = "doc_id long, text string, source string, lang string, n_chars long"


def corpus(spark, n, seed=1):
    """Two kinds of pages, told apart by their words or by their site; half of the words of each kind are rare."""
    draw, rows = random.Random(seed), []
    for i in range(n):
        good = i % 2
        words = [f"{'good' if good else 'bad'}{draw.randrange(400)}" if draw.random() < 0.3 else f"word{draw.randrange(50)}" for _ in range(30)]
        rows.append((i, " ".join(words), f"{'site' if good else 'farm'}{draw.randrange(3)}", "en", 200 if good else 90))
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


def test_labels_are_handed_over_and_help(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    docs = corpus(spark, 800)
    alone, model = ct.fit(docs, labels, rounds=0), ct.fit(docs, labels)
    assert alone["handed"] == {"text": 0, "meta": 0} and min(model["handed"].values()) > 300

    def right(m):
        rows = docs.where("doc_id >= 60").collect()
        return np.mean([(ct.log_odds(m["text"], ct.content(r.text)) > 0) == (r.doc_id % 2 == 1) for r in rows])

    assert right(model) > max(right(alone), 0.97)
    more = ct.fit(corpus(spark, 1600), labels)  # nothing bounds what is learnt
    assert more["handed"]["text"] > 1.8 * model["handed"]["text"] and more["handed"]["meta"] > model["handed"]["meta"]  # how sure the content view is depends on its calibration
    rows = {r.doc_id: r for r in ct.report(docs, labels).collect()}
    assert np.mean([r.kept == (i % 2 == 1) for i, r in rows.items()]) > 0.98 and all(0 <= r.score <= 1 for r in rows.values())


def test_sums_against_a_plain_loop(spark):
    docs = corpus(spark, 120).union(spark.createDataFrame([(None, "good1 good2", "site1", "en", 200), (900, None, "farm1", None, None), (901, "", None, "en", 90), (902, "x " * 20000, "site0", "en", 200), (903, "good7", "site2", "en", 200), (903, "good7", "site2", "en", 200)], SCHEMA))
    sample = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, y int")
    model = ct.fit(docs, sample.toDF("doc_id", "quality"), rounds=0)
    sums, handed = ct.handed_sums(docs, sample, model)
    want, count = ct.no_sums(), dict.fromkeys(ct.VIEWS, 0)
    for r in docs.collect():
        if r.doc_id is not None and r.doc_id < 40:
            continue
        views = {"text": ct.content(r.text), "meta": ct.metadata(r.source, r.lang, r.n_chars)}
        for v, other in (("text", "meta"), ("meta", "text")):
            p = 1 / (1 + np.exp(-np.clip(ct.log_odds(model[other], views[other]), -30, 30)))
            if len(views[other][0]) and not 1 - ct.SURE < p < ct.SURE:
                count[v] += 1
                for b, share in zip(*views[v], strict=True):
                    want[v][int(p > 0.5), b] += round(share * ct.UNIT)
    assert handed == count and all((sums[v] == want[v]).all() for v in ct.VIEWS)


def test_held_out_accuracy(spark):
    """Labelled rows that neither fitting nor calibration has seen."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    bound = 1000
    seen = {r.doc_id for r in ct.bounded_sample(labels.select("doc_id"), "doc_id", bound).collect()}
    truth = {r.doc_id: r.quality for r in labels.collect() if r.doc_id not in seen}
    rows = [r for r in ct.report(docs, labels, labelled=bound).collect() if r.doc_id in truth]
    assert len(rows) > 2000 and np.mean([r.kept == bool(truth[r.doc_id]) for r in rows]) > 0.96
    sure = [(r.score, truth[r.doc_id]) for r in rows if r.score > 0.9]
    assert np.mean([y for _, y in sure]) == pytest.approx(np.mean([s for s, _ in sure]), abs=0.04)  # calibrated
