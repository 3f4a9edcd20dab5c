"""Quality and toxicity: rows that were not learnt from, calibration, and the label model on votes of known makers."""

import numpy as np
import pytest

from tracelake.llm import quality, toxicity
from tracelake.llm.common import bounded_sample

SF = "/root/testdata/sf0.1"


def test_quality_on_unseen_rows(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    bound = 1500
    model = quality.fit(docs, labels, bound=bound)
    seen = {r.doc_id for r in bounded_sample(labels.select("doc_id"), "doc_id", bound).collect()}
    truth = {r.doc_id: r.quality for r in labels.collect() if r.doc_id not in seen}
    rows = [(quality.probability(model, r.text), truth[r.doc_id]) for r in docs.where(docs.doc_id.isin(list(truth)[:1200])).collect()]
    p, y = np.array(rows).T
    assert len(rows) > 1000 and np.mean((p >= 0.5) == (y > 0.5)) > 0.96
    # calibrated: where the model says p, about p of the rows are good
    for low, high in ((0.0, 0.2), (0.8, 1.0)):
        here = (p >= low) & (p <= high)
        assert here.sum() > 50 and p[here].mean() == pytest.approx(y[here].mean(), abs=0.06)


def test_label_model_finds_the_voters(spark):
    """Twelve voters of known rates; three more repeat the first one with few changes, and so share its weight."""
    draw = np.random.default_rng(3)
    y = draw.random(6000) < 0.2
    hit1, hit0 = np.linspace(0.3, 0.8, 12), np.linspace(0.02, 0.1, 12)
    votes = (draw.random((6000, 12)) < np.where(y[:, None], hit1, hit0)).astype(float)
    copies = np.abs(votes[:, [0] * 3] - (draw.random((6000, 3)) < 0.01))
    post, got1, got0, share = toxicity.label_model(np.concatenate([votes, copies], axis=1), np.ones(6000), 0.3)
    assert np.abs(got1[:12] - hit1).max() < 0.06 and np.abs(got0[:12] - hit0).max() < 0.03
    # the best that can be done with these votes, by their true rates
    llr = np.log(0.2 / 0.8) + votes @ np.log(hit1 / hit0) + (1 - votes) @ np.log((1 - hit1) / (1 - hit0))
    assert np.mean((post > 0.5) == y) > np.mean((llr > 0) == y) - 0.005
    assert share[[0, 12, 13, 14]].max() < 0.5 < share[1:12].min()


def test_toxicity_is_not_learnt_from_the_held_out_fifth(spark):
    """Other labels there change no score."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.selectExpr("doc_id", "quality", "CASE WHEN crc32(CAST(doc_id AS STRING)) % 5 = 0 THEN 1 - toxic ELSE toxic END AS toxic")
    a, b = (sorted((r.doc_id, r.score) for r in toxicity.report(docs, x).collect()) for x in (labels, turned))
    assert a == b
