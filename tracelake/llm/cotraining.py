"""Quality classifier by co-training of two views.

One naive Bayes classifier reads a page's content (hashed words and word pairs of its text), the other its metadata
(source, language, stated length), and neither sees anything of the other's view. Both start from a bounded labelled
sample and are calibrated on a fold of it that they have not seen. Then, for some rounds, every other document of the
corpus is scored by both in Spark tasks, and each classifier hands the labels that it is sure of to the other one: what
the receiving classifier learns from them are sums over the corpus, gathered per task and added up by a shuffle, so no
pool, no number of handed labels and no text is bounded or collected. At last the calibrated views are combined by a
share that fits the unseen fold best, and every whole text is scored in Arrow batches.

Sums are whole numbers, so that they are the same in whatever order tasks end.

Cases: null and empty texts have no content and are scored by their metadata; null metadata is a value of its own; without
labels of both classes every score is null and every document is kept; a score on the threshold keeps a document, one on
the bound of being sure counts as sure; very long texts are read whole; rows without an id are scored and learnt from as
others; of several labels of one document the largest counts; repeated rows score alike, and weigh as often as they
come; an empty table gives an empty table; columns other than those named are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm import quality, textvec
from tracelake.llm.common import bounded_sample, small_batches

LABELLED = 2000  # rows that the first classifiers are fitted and all are calibrated on, at most
ROUNDS = 2
SURE = 0.97
TEXT_BITS, META_BITS = 16, 12
UNIT = 1 << 20  # a document's mass in the sums
SMOOTH = 0.05  # of a class's mass, spread over all buckets
THRESHOLD = 0.5
VIEWS = ("text", "meta")
FIELDS = ["text", "source", "lang", "n_chars"]
SIZE = {"text": 1 << TEXT_BITS, "meta": 1 << META_BITS}


def shape(raw: np.ndarray, words: np.ndarray) -> list[bytes]:
    """What a text looks like: shares of kinds of bytes, of distinct words and of short lines, and lengths."""
    of = np.bincount(raw, minlength=256)
    n, lines = len(raw), np.diff(np.concatenate([[-1], np.flatnonzero(raw == 10), [len(raw)]])) - 1
    kinds = {"letters": of[97:123].sum(), "digits": of[48:58].sum(), "blanks": of[32], "beyond": of[128:].sum(), "marks": of[[33, 44, 46, 63]].sum(), "signs": of[[35, 36, 37, 38, 42, 60, 62, 124]].sum(), "rest": of[33:48].sum() + of[58:65].sum() + of[91:97].sum() + of[123:127].sum()}
    parts = {**{k: v / n for k, v in kinds.items()}, "distinct": len(np.unique(words)) / len(words), "short": (lines < 40).mean()}
    return [f"{k}={int(np.ceil(20 * x))}".encode() for k, x in parts.items()] + [b"words=%d" % len(words).bit_length(), b"lines=%d" % len(lines).bit_length()]


def content(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text's words and word pairs, and the share of each among them."""
    raw = textvec.LOWER[np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)]
    starts, ends = textvec.word_bounds(raw)
    if not len(starts):
        return np.empty(0, np.int64), np.empty(0)
    words = textvec.span_hashes(raw, starts, ends)
    hashes = np.concatenate([words, textvec.pair_hashes(words[:-1], words[1:])])
    form = [zlib.crc32(x) % SIZE["text"] for x in shape(raw, words)]
    buckets = np.concatenate([(hashes >> np.uint64(64 - TEXT_BITS)).astype(np.int64), form])
    ids, at = np.unique(buckets, return_inverse=True)
    part = np.full(len(buckets), 0.5 / len(hashes))
    part[len(hashes) :] = 0.5 / len(form)
    return ids, np.bincount(at, weights=part)


def metadata(source: str | None, lang: str | None, n_chars: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of what is stated about a page: each field with its value, and each two of them."""
    length = None if n_chars is None else int(4 * np.log2(max(int(n_chars), 0) + 1))
    named = [f"source={source}", f"lang={lang}", f"length={length}"]
    named += [f"{a}&{b}" for i, a in enumerate(named) for b in named[i + 1 :]]
    ids = np.unique([zlib.crc32(x.encode("utf-8", "surrogatepass")) % SIZE["meta"] for x in named])
    return ids, np.full(len(ids), 1 / len(ids))


def both_views(text, source, lang, n_chars) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    return {"text": content(text), "meta": metadata(source, lang, n_chars)}


def mass(shares: np.ndarray) -> np.ndarray:
    """Shares as whole numbers, for sums."""
    return np.rint(shares * UNIT).astype(np.int64)


def no_sums() -> dict[str, np.ndarray]:
    return {v: np.zeros((2, SIZE[v]), np.int64) for v in VIEWS}


def weights(sums: np.ndarray) -> np.ndarray:
    """Log-odds of each bucket: its smoothed share of the mass of class 1 against that of class 0."""
    part = sums / UNIT
    total = np.maximum(part.sum(axis=1, keepdims=True), 1.0)
    part = (part + SMOOTH * total / sums.shape[1]) / (total * (1 + SMOOTH))
    return (np.log(part[1]) - np.log(part[0])).astype(np.float32)


def log_odds(view: dict, feature: tuple[np.ndarray, np.ndarray]) -> float:
    return view["a"] * float(view["w"][feature[0]] @ feature[1]) + view["b"]


def fitted(sums: dict[str, np.ndarray], held: list[dict], y: np.ndarray) -> dict[str, dict]:
    """Both views from their sums, calibrated on the held rows."""
    model = {}
    for v in VIEWS:
        view = {"w": weights(sums[v]), "a": 1.0, "b": 0.0}
        if len(held) and y.min() != y.max():
            view["a"], view["b"] = quality.platt(np.array([log_odds(view, x[v]) for x in held]), y)
        model[v] = view
    return model


def labelled_rows(docs: DataFrame, sample: DataFrame) -> pa.Table:
    """y, fold and both views of the sample's documents; made in tasks. The sample is bounded."""

    def make(batches):
        for batch in batches:
            cells = [both_views(*x) for x in zip(*(c.to_pylist() for c in batch.columns[3:]), strict=True)]
            ids = [pa.array([x[v][0] for x in cells], pa.list_(pa.int32())) for v in VIEWS]
            shares = [pa.array([x[v][1] for x in cells], pa.list_(pa.float64())) for v in VIEWS]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *ids, *shares], ["at", "y", "fold", "text_ids", "meta_ids", "text_shares", "meta_shares"])

    fold = F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(5)).cast("int")
    rows = small_batches(docs).select("doc_id", *FIELDS).join(F.broadcast(sample), "doc_id").select(F.xxhash64("doc_id", *FIELDS).alias("at"), "y", fold.alias("fold"), *FIELDS)
    return rows.mapInArrow(make, "at bigint, y int, fold int, text_ids array<int>, meta_ids array<int>, text_shares array<double>, meta_shares array<double>").toArrow().sort_by("at")


def handed_sums(docs: DataFrame, sample: DataFrame, model: dict[str, dict]) -> tuple[dict[str, np.ndarray], dict[str, int]]:
    """What each view learns from the other's sure labels of all documents outside the sample, and how many these are.

    A task sends one row for each bucket that it has met; the driver gets one for each bucket there is.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def gather(batches):
        model, sums, handed = shared.value, no_sums(), np.zeros((2, 2), np.int64)
        for batch in batches:
            for x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                views = both_views(*x)
                for v, other in enumerate(("meta", "text")):  # VIEWS[v] learns from the other one
                    p = 1 / (1 + np.exp(-np.clip(log_odds(model[other], views[other]), -30, 30)))
                    if len(views[other][0]) and (p >= SURE or p <= 1 - SURE):
                        ids, shares = views[VIEWS[v]]
                        sums[VIEWS[v]][int(p > 0.5), ids] += mass(shares)
                        handed[v, int(p > 0.5)] += 1
        for v, name in enumerate(VIEWS):
            for label in (0, 1):
                at = np.flatnonzero(sums[name][label])
                buckets, masses = np.append(at, -1), np.append(sums[name][label, at], handed[v, label])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(buckets), z, np.int32)) for z in (v, label)] + [pa.array(buckets.astype(np.int32)), pa.array(masses)], ["view", "label", "bucket", "mass"])

    others = docs.select("doc_id", *FIELDS).join(F.broadcast(sample.select("doc_id")), "doc_id", "left_anti").select(*FIELDS)
    found = others.mapInArrow(gather, "view int, label int, bucket int, mass bigint").groupBy("view", "label", "bucket").agg(F.sum("mass").alias("mass")).where("mass > 0").toArrow()
    view, label, bucket, amount = (found.column(c).to_numpy() for c in ("view", "label", "bucket", "mass"))
    sums, handed = no_sums(), {}
    for v, name in enumerate(VIEWS):
        here = (view == v) & (bucket >= 0)
        sums[name][label[here], bucket[here]] = amount[here]
        handed[name] = int(amount[(view == v) & (bucket < 0)].sum())
    return sums, handed


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", labelled: int = LABELLED, rounds: int = ROUNDS) -> dict | None:
    """Both calibrated views, their combination, and how many labels each view was handed in the last round."""
    usable = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    sample = bounded_sample(usable, "doc_id", labelled)
    got = labelled_rows(docs, sample)
    y, fold = (np.array(got[c].to_pylist(), float) for c in ("y", "fold"))
    lists = {c: got[c].to_numpy(zero_copy_only=False) for c in got.column_names[3:]}
    rows = [{v: (np.asarray(lists[f"{v}_ids"][i], np.int64), np.asarray(lists[f"{v}_shares"][i], float)) for v in VIEWS} for i in range(len(y))]
    learn, hold = np.flatnonzero(fold != 0), np.flatnonzero(fold == 0)
    if not len(learn) or y[learn].min() == y[learn].max():
        return None
    known = no_sums()
    for i in learn:
        for v in VIEWS:
            known[v][int(y[i]), rows[i][v][0]] += mass(rows[i][v][1])
    held, model, handed = [rows[i] for i in hold], None, dict.fromkeys(VIEWS, 0)
    model = fitted(known, held, y[hold])
    for _ in range(rounds):
        sums, handed = handed_sums(docs, sample, model)
        model = fitted({v: known[v] + sums[v] for v in VIEWS}, held, y[hold])
    out = {**model, "share": 0.5, "a": 1.0, "b": 0.0, "handed": handed}
    if len(hold) and y[hold].min() != y[hold].max():
        z = {v: np.array([log_odds(model[v], x[v]) for x in held]) for v in VIEWS}
        loss = lambda s: np.log1p(np.exp(-(2 * y[hold] - 1) * np.clip(s * z["text"] + (1 - s) * z["meta"], -30, 30))).mean()
        out["share"] = min((k / 10 for k in range(11)), key=loss)
        out["a"], out["b"] = quality.platt(out["share"] * z["text"] + (1 - out["share"]) * z["meta"], y[hold])
    return out


def report(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **bounds: int) -> DataFrame:
    """Per row: doc_id, p_text, p_meta, score, kept."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, **bounds))

    def judge(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        m = model.value
        sigmoid = lambda z: round(float(1 / (1 + np.exp(-np.clip(z, -30, 30)))), 9)
        for text, source, lang, n_chars in batches:
            rows = []
            for t, s, g, n in zip(text, source, lang, n_chars, strict=True):
                if m is None:
                    rows.append((None, None, None, True))
                    continue
                x = both_views(t, s, g, None if pd.isna(n) else int(n))
                z = {v: log_odds(m[v], x[v]) for v in VIEWS}
                score = sigmoid(m["a"] * (m["share"] * z["text"] + (1 - m["share"]) * z["meta"]) + m["b"])
                rows.append((sigmoid(z["text"]), sigmoid(z["meta"]), score, score >= threshold))
            yield pd.DataFrame(rows, columns=["p_text", "p_meta", "score", "kept"])

    scored = F.pandas_udf(judge, "p_text double, p_meta double, score double, kept boolean")
    return docs.select("doc_id", scored("text", "source", "lang", "n_chars").alias("r")).select("doc_id", "r.*")
