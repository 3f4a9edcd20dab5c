"""Quality rules: base counts, and a hashed n-gram logistic regression trained on labelled rows.

The model reads word unigrams and bigrams and character 3- and 5-grams, hashed into 2**16 buckets, with the square
root of each bucket's share as value. It is fitted on a bounded sample (parameter), its probability is calibrated on
a fifth of the sample that it has not seen (Platt), and whole texts are scored in Arrow batches against a fixed
threshold.

Cases: null and empty texts have no words and fail the base rules; a text of any length is read whole, in time and
memory that grow with its length; a probability on the threshold keeps a document; an empty table gives an empty table;
texts without usable labels around (no sample, or
one class only) are kept or not by the base rules alone; repeated rows give repeated results; other columns are not
read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm import textvec
from tracelake.llm.common import bounded_sample, small_batches

BITS = 16
SAMPLE = 3000
THRESHOLD = 0.5
IS_SYMBOL = np.zeros(256, bool)
IS_SYMBOL[list(b"#*$%&|<>")] = True
IS_HEAD = (np.arange(256) & 0xC0) != 0x80  # the first byte of a character


def repeated_words(ids: np.ndarray, n: int = 5) -> int:
    """Words that lie in an n-word window found twice or more; ids number the distinct words."""
    if len(ids) < n + 1:
        return 0
    top = np.int64(len(ids) + 1)
    gram = ids.astype(np.int64)
    for k in range(1, n):  # number the (k+1)-word windows exactly
        _, gram = np.unique(gram[: len(ids) - k] * top + ids[k:], return_inverse=True)
        if gram.max(initial=-1) + 1 == len(gram):
            return 0  # no shorter window comes twice
    hit = np.flatnonzero(np.bincount(gram)[gram] > 1)
    edges = np.zeros(len(ids) + 1, np.int64)
    np.add.at(edges, hit, 1)
    np.add.at(edges, hit + n, -1)
    return int((np.cumsum(edges)[:-1] > 0).sum())


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    data = (text or "").encode("utf-8", "surrogatepass")
    raw = np.frombuffer(data, np.uint8)
    words = data.split()  # of bytes: at \x20 and \x09 to \x0D
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    lines = [x for x in data.split(b"\n") if x.split()]
    chars = int((IS_HEAD[raw] & ~textvec.IS_SPACE[raw]).sum())
    return len(words), chars, int(IS_SYMBOL[raw].sum()), len(lines) - len(set(lines)), repeated_words(ids)


def features(text: str | None) -> np.ndarray:
    """Buckets of a text's n-grams, with repeats."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    starts, ends = textvec.word_bounds(raw)
    if not len(starts):
        return np.empty(0, np.int64)
    prefix = textvec.prefix_sums(raw)
    words = textvec.span_hashes(raw, starts, ends, prefix)
    hashes = [words, textvec.pair_hashes(words[:-1], words[1:]), textvec.char_grams(raw, 3, prefix), textvec.char_grams(raw, 5, prefix)]
    return np.concatenate([(h >> np.uint64(64 - BITS)).astype(np.int64) for h in hashes])


def values(buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets and their values, of length 1 together."""
    if not len(buckets):
        return buckets, np.empty(0)
    counts = np.bincount(buckets, minlength=1 << BITS)
    ids = np.flatnonzero(counts)
    return ids, np.sqrt(counts[ids] / len(buckets))


def fit_rows(ids: list[np.ndarray], vals: list[np.ndarray], y: np.ndarray, size: int = 1 << BITS, l2: float = 1e-4, steps: int = 150) -> tuple[np.ndarray, float]:
    """Logistic regression on sparse rows, both classes weighing alike, by Adam over all rows."""
    sizes = np.array([len(i) for i in ids])
    full, at, val = sizes > 0, np.concatenate(ids).astype(np.int64), np.concatenate(vals).astype(np.float32)
    first = (np.cumsum(sizes) - sizes)[full]
    w = np.where(y > 0.5, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    coef, bias, m, v, mb, vb = np.zeros(size), 0.0, np.zeros(size), np.zeros(size), 0.0, 0.0
    for t in range(1, steps + 1):
        z = np.full(len(y), bias)
        if len(first):
            z[full] += np.add.reduceat(coef.astype(np.float32)[at] * val, first)
        d = w * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        grad, gb = np.bincount(at, weights=np.repeat(d.astype(np.float32), sizes) * val, minlength=size) + l2 * coef, d.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb**2
        coef -= 0.3 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8) * (v > 1e-14)
        bias -= 0.3 * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-8)
    return coef, bias


def platt(z: np.ndarray, y: np.ndarray, steps: int = 200) -> tuple[float, float]:
    """Slope and offset that make z a log-odds, by Newton's method with smoothed targets."""
    p, n = y.sum(), (1 - y).sum()
    target = np.where(y > 0.5, (p + 1) / (p + 2), 1 / (n + 2))
    a, b = 1.0, 0.0
    for _ in range(steps):
        q = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        s = np.maximum(q * (1 - q), 1e-6)
        g = np.array([((q - target) * z).sum() + 1e-3 * (a - 1), (q - target).sum()])
        h = np.array([[(s * z * z).sum() + 1e-3, (s * z).sum()], [(s * z).sum(), s.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return (float(a), float(b)) if a > 0 else (1.0, 0.0)


def sampled(docs: DataFrame, labels: DataFrame, label: str, key: str, text: str, bound: int) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Labels, buckets, values and the calibration fold of a bounded labelled sample; features are made in tasks."""
    usable = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.max(label).cast("int").alias("__y"))
    sample = bounded_sample(usable, key, bound).withColumn("__fold", F.pmod(F.xxhash64(F.lit(3), F.col(key)), F.lit(5)).cast("int"))
    rows = small_batches(docs).select(F.col(key), F.col(text).alias("__text")).join(F.broadcast(sample), key).select(F.xxhash64(key, "__text").alias("__at"), "__y", "__fold", "__text")

    def make(batches):
        for batch in batches:
            pairs = [values(features(t)) for t in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([i for i, _ in pairs], pa.list_(pa.int32())), pa.array([v.astype(np.float32) for _, v in pairs], pa.list_(pa.float32()))], ["at", "y", "fold", "ids", "vals"])

    got = rows.mapInArrow(make, "at bigint, y int, fold int, ids array<int>, vals array<float>").toArrow().sort_by("at")
    unpack = lambda c, kind: [np.asarray(x, kind) for x in got[c].to_numpy(zero_copy_only=False)]
    return np.array(got["y"].to_pylist(), float), unpack("ids", np.int32), unpack("vals", np.float32), np.array(got["fold"].to_pylist())


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text", bound: int = SAMPLE) -> dict | None:
    y, ids, vals, fold = sampled(docs, labels, label, key, text, bound)
    learn, hold = np.flatnonzero(fold != 0), np.flatnonzero(fold == 0)
    if not len(learn) or y[learn].min() == y[learn].max():
        return None
    coef, bias = fit_rows([ids[i] for i in learn], [vals[i] for i in learn], y[learn])
    a, b = 1.0, 0.0
    if len(hold) and y[hold].min() != y[hold].max():
        a, b = platt(np.array([coef[ids[i]] @ vals[i] for i in hold]) + bias, y[hold])
    return {"coef": coef.astype(np.float32), "bias": bias, "a": a, "b": b}


def probability(model: dict, text: str | None) -> float:
    ids, vals = values(features(text))
    z = model["a"] * (float(model["coef"][ids] @ vals) + model["bias"]) + model["b"]
    return round(float(1 / (1 + np.exp(-np.clip(z, -30, 30)))), 9)


def report(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Per row: key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, probability, kept."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, key=key, text=text))

    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for t in texts:
                counts = base_counts(t)
                failed = counts[0] < 10 or 100 * counts[4] > 20 * counts[0]
                p = None if failed or model.value is None else probability(model.value, t)
                rows.append((*counts, failed, p, not failed and (p is None or p >= threshold)))
            yield pd.DataFrame(rows, columns=["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "probability", "kept"])

    schema = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, probability double, kept boolean"
    return docs.select(key, F.pandas_udf(judge, schema)(F.col(text)).alias("r")).select(key, "r.*")
