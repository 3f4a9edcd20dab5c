"""Toxicity by weak supervision.

Many voters look at each document of a bounded labelled sample: lexicons of insults, patterns of address, and lexicons
mined from the sample's labels (words and word beginnings that stand out in toxic texts). A generative model of the
votes estimates each voter's accuracy by expectation-maximisation; voters that err together share their weight. Its
posterior labels train a linear classifier over hashed words and word beginnings, which alone scores every whole text.

The sample's bound is a parameter; features come from Spark tasks, the driver sees hashed features of the sample only.
Rows whose crc32(key as text) mod 5 is 0 are never learnt from. Labels, language, source and id are no inputs.

Cases: a text of any length is read whole, a word counts once in it; a score of 0.5 is toxic; of several labels of one
document the largest counts; an empty table gives an empty table; null and empty texts score as a text without any hit; without labels of both classes the prior alone scores
(0.0 with no toxic label); labels of null or unknown documents are passed by; repeated rows score alike; clashing
columns are not read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import bounded_sample, small_batches, unused

WORD = re.compile(r"[^\W\d_]+")
BITS = 21
MASK = (1 << BITS) - 1
AGAIN = 1 << BITS  # the feature "by two or more distinct words" stands this far behind the feature itself
BEGINNINGS = (4, 5, 6, 7, 8)
SAMPLE = 6000
FEATURES = 1500
LEAST_G = 18.0
MINED_VOTERS = 24
VOTER_PRECISION = 0.8
CACHED = 50_000

#: Insults, grouped by what they say.
LEXICONS = {
    "mind": "idiot idiots moron morons stupid dumb imbecile fool fools brainless halfwit dunce dimwit",
    "worth": "worthless pathetic loser losers useless failure nobody pitiful hopeless",
    "disgust": "disgusting scum filth vermin vile repulsive gross revolting lowlife",
    "waste": "trash garbage rubbish junk dirt waste",
    "mockery": "clown clowns joke laughable ridiculous buffoon freak weirdo",
    "harm": "kill die hate hurt destroy murder beat threat",
    "swearing": "damn hell crap bastard jerk coward liar pig rat snake",
    "dismissal": "shut leave quit begone nobody disgrace shame ashamed",
}
#: Patterns of address and stress.
PATTERNS = {
    "you_are": r"\byou(?:'re| are)\s+(?:an?\s+|such\s+|so\s+)?(?:idiot|moron|stupid|pathetic|worthless|loser|clown|trash|scum)",
    "go_away": r"\b(?:shut up|go away|get lost|drop dead)\b",
    "insult_stress": r"\b(?:idiot|moron|loser|scum|trash|clown)s?\s*!+",
    "two_insults": r"\b(?:idiot|moron|stupid|pathetic|worthless|loser|clown|trash|scum|disgusting)\b.*?\b(?:idiot|moron|stupid|pathetic|worthless|loser|clown|trash|scum|disgusting)\b",
}
VOTERS = [*LEXICONS, *PATTERNS]


class Features:
    """Hashed features of a text; remembers words."""

    def __init__(self, wanted: np.ndarray | None = None):
        self.wanted = None if wanted is None else set(int(x) & MASK for x in wanted)
        self.seen: dict[str, tuple[int, ...]] = {}

    def of_word(self, word: str) -> tuple[int, ...]:
        found = self.seen.get(word)
        if found is None:
            raw = word.encode("utf-8", "surrogatepass")
            found = [zlib.crc32(raw) & MASK, *(zlib.crc32(word[:n].encode("utf-8", "surrogatepass") + b"*") & MASK for n in BEGINNINGS if len(word) > n)]
            found = tuple(x for x in found if self.wanted is None or x in self.wanted)
            if len(self.seen) >= CACHED:
                self.seen.clear()
            self.seen[word] = found
        return found

    def of(self, text: str | None) -> np.ndarray:
        hits = [f for f in map(self.of_word, set(WORD.findall((text or "").lower()))) if f]
        if not hits:
            return np.empty(0, np.int32)
        ids, counts = np.unique(np.fromiter((x for f in hits for x in f), np.int32), return_counts=True)
        return np.concatenate([ids, ids[counts > 1] + AGAIN]).astype(np.int32)


def sketch(text: str | None) -> list[int]:
    """Eight least hashes of a text's words, to weigh copies in the sample."""
    hashes = np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in set(WORD.findall((text or "").lower()))), np.uint64)
    if not len(hashes):
        return [0] * 8
    return [int(((hashes * np.uint64(2 * 0x9E3779B1 * k + 1)) & np.uint64(0xFFFFFFFF)).min()) for k in range(1, 9)]


def fixed_votes(text: str | None, lexicons: list[frozenset], patterns: list[re.Pattern]) -> list[int]:
    low = (text or "").lower()
    words = set(WORD.findall(low))
    return [int(not words.isdisjoint(x)) for x in lexicons] + [int(bool(p.search(low))) for p in patterns]


def sampled_features(labelled: DataFrame) -> pa.Table:
    """toxic, features, votes, sketch of each row of labelled (text, toxic); made in the tasks."""

    def make(batches):
        lexicons = [frozenset(x.split()) for x in LEXICONS.values()]
        patterns = [re.compile(p, re.S) for p in PATTERNS.values()]
        features = Features()
        for batch in batches:
            texts = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(1),
                    pa.array([features.of(t) for t in texts], pa.list_(pa.int32())),
                    pa.array([fixed_votes(t, lexicons, patterns) for t in texts], pa.list_(pa.int32())),
                    pa.array([sketch(t) for t in texts], pa.list_(pa.int64())),
                ],
                ["toxic", "features", "votes", "sketch"],
            )

    rows = small_batches(labelled).select("text", F.col("toxic").cast("int").alias("toxic"))
    return rows.mapInArrow(make, "toxic int, features array<int>, votes array<int>, sketch array<bigint>").toArrow()


def copy_weights(sketches: np.ndarray) -> np.ndarray:
    """1 / size of the group of near copies that a row belongs to (rows that share two neighbouring least hashes)."""
    root = list(range(len(sketches)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for k in range(0, 8, 2):
        first: dict[tuple[int, int], int] = {}
        for i, pair in enumerate(map(tuple, sketches[:, k : k + 2].tolist())):
            a, b = find(i), find(first.setdefault(pair, i))
            root[max(a, b)] = min(a, b)
    groups = np.array([find(i) for i in range(len(sketches))])
    _, where, counts = np.unique(groups, return_inverse=True, return_counts=True)
    return 1.0 / counts[where]


def standing_out(features: list[np.ndarray], y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features with a high log-likelihood ratio G2 for the toxic rows, best first, and the toxic share of their rows."""
    rows = np.repeat(np.arange(len(features)), [len(f) for f in features])
    seen, ids = np.unique(np.concatenate(features) if len(features) else np.empty(0, np.int32), return_inverse=True)
    pos = np.bincount(ids, weights=(w * y)[rows], minlength=len(seen))
    neg = np.bincount(ids, weights=(w * (1 - y))[rows], minlength=len(seen))
    p, n = (w * y).sum(), (w * (1 - y)).sum()
    total = pos + neg
    with np.errstate(divide="ignore", invalid="ignore"):
        expected = total * p / (p + n)
        g = 2 * (np.where(pos > 0, pos * np.log(pos / expected), 0) + np.where(neg > 0, neg * np.log(neg / (total - expected)), 0))
    g[~((pos > expected) & (total > 0))] = 0
    best = np.argsort(-g, kind="stable")[:FEATURES]
    best = best[g[best] >= LEAST_G]
    return seen[best].astype(np.int64), pos[best] / total[best]


def label_model(votes: np.ndarray, w: np.ndarray, prior: float, rounds: int = 25) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of label 1 per row, and per voter its rate of votes on either class, and its share of weight.

    A voter that correlates with others beyond what the label explains counts 1 / (1 + sum of those correlations).
    """
    hit1, hit0 = np.full(votes.shape[1], 0.5), np.full(votes.shape[1], 0.05)
    share = np.ones(votes.shape[1])
    post = np.full(len(votes), prior)
    for r in range(rounds):
        llr = math.log(prior / (1 - prior)) + votes @ (share * np.log(hit1 / hit0)) + (1 - votes) @ (share * np.log((1 - hit1) / (1 - hit0)))
        post = 1 / (1 + np.exp(-np.clip(llr, -30, 30)))
        a, b = w * post, w * (1 - post)
        hit1 = np.clip((votes.T @ a + 0.5) / (a.sum() + 1), 1e-3, 1 - 1e-3)
        hit0 = np.clip((votes.T @ b + 0.05) / (b.sum() + 1), 1e-3, 1 - 1e-3)
        hit1 = np.maximum(hit1, hit0)  # a vote never speaks for label 0
        prior = float(np.clip(a.sum() / (a.sum() + b.sum()), 0.01, 0.5))
        if r >= 2:
            rest = (votes - (post[:, None] * hit1 + (1 - post)[:, None] * hit0)) * np.sqrt(w)[:, None]
            c = rest.T @ rest
            d = np.sqrt(np.maximum(np.diag(c), 1e-9))
            excess = np.maximum(c / d[:, None] / d[None, :] - 0.1, 0)
            np.fill_diagonal(excess, 0)
            share = 1 / (1 + excess.sum(axis=1))
    return post, hit1, hit0, share


def fit_linear(x: np.ndarray, target: np.ndarray, w: np.ndarray, l2: float = 0.5, steps: int = 400) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels, by Adam over all rows."""
    coef, bias = np.zeros(x.shape[1], np.float32), float(np.log(max((w * target).sum(), 0.5) / max((w * (1 - target)).sum(), 0.5)))
    m, v = np.zeros(x.shape[1] + 1), np.zeros(x.shape[1] + 1)
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ coef + bias, -30, 30)))
        d = (w * (p - target)).astype(np.float32)
        grad = np.append(x.T @ d + l2 * coef, d.sum()) / w.sum()
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        coef -= step[:-1].astype(np.float32)
        bias -= float(step[-1])
    return coef, bias


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", bound: int = SAMPLE) -> dict:
    """The classifier: {"bias", "ids", "weights"} and the voters' figures."""
    usable = labels.where(F.col("toxic").isNotNull() & F.col(key).isNotNull() & (F.crc32(F.col(key).cast("string")) % 5 != 0))
    sample = bounded_sample(usable.groupBy(key).agg(F.max("toxic").alias("toxic")), key, bound)
    rows = sampled_features(docs.select(F.col(key), F.col(text).alias("text")).join(F.broadcast(sample), key))
    y = np.array(rows["toxic"].to_pylist(), np.float64)
    if not len(y) or y.min() == y.max():
        return {"bias": 12.0 if len(y) and y[0] else -12.0, "ids": [], "weights": [], "voters": {}}
    features = [np.asarray(f, np.int32) for f in rows["features"].to_numpy(zero_copy_only=False)]
    order = np.argsort([hash((int(f.sum()), len(f), int(t))) for f, t in zip(features, y, strict=True)], kind="stable")  # rows come in any order
    features, y = [features[i] for i in order], y[order]
    w = copy_weights(np.array(rows["sketch"].to_pylist(), np.int64)[order])
    ids, precision = standing_out(features, y, w)
    column = {int(f): k for k, f in enumerate(ids)}
    x = np.zeros((len(y), len(ids)), np.float32)
    for i, f in enumerate(features):
        x[i, [column[int(v)] for v in f if int(v) in column]] = 1
    fixed = np.array(rows["votes"].to_pylist(), np.float64)[order]
    sure = np.flatnonzero(precision >= VOTER_PRECISION)  # the rest serve the classifier only
    mined = np.stack([(x[:, sure[k::MINED_VOTERS]].sum(axis=1) > 0) for k in range(MINED_VOTERS)], axis=1).astype(np.float64)
    votes = np.concatenate([fixed, mined], axis=1)
    prior = float(np.clip((w * y).sum() / w.sum(), 0.01, 0.5))
    post, hit1, hit0, share = label_model(votes, w, prior)
    coef, bias = fit_linear(x, post, w)
    names = VOTERS + [f"mined_{k}" for k in range(MINED_VOTERS)]
    return {"bias": bias, "ids": ids.tolist(), "weights": coef.astype(float).tolist(), "voters": {n: (float(a), float(b), float(s)) for n, a, b, s in zip(names, hit1, hit0, share, strict=True)}}


def score(docs: DataFrame, model: dict, text: str = "text", to: str = "score") -> DataFrame:
    """docs with the column `to`: the chance of label 1, of each whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = shared.value
        features = Features(np.array(model["ids"], np.int64))
        weight = dict(zip(model["ids"], model["weights"], strict=True))
        for texts in batches:
            out = []
            for value in texts:
                s = model["bias"] + sum(weight.get(int(f), 0.0) for f in features.of(value))
                out.append(round(1 / (1 + math.exp(-max(-30.0, min(30.0, s)))), 9))
            yield pd.Series(out, dtype="float64")

    return small_batches(docs).withColumn(to, F.pandas_udf(scored, "double")(F.col(text)))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted."""
    scored = score(docs.select("doc_id", "text"), fit(docs, labels), to="score")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def remove_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those that score 0.5 or more; all columns stay as they are."""
    to = unused("toxic_score", docs)
    return score(docs, fit(docs, labels), to=to).where(F.col(to) < 0.5).drop(to)
