"""SimHash groups against all pairs in plain Python."""

import random
import re

import numpy as np
import pytest
import xxhash

from tracelake.llm import simhash

LOWER = {i: i + 32 for i in range(65, 91)}


def plain_fingerprint(text, n=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] or [" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(rows, fps):
    """rows of (id, key), fps by key: component of each row over all pairs of distinct fingerprints."""
    known = sorted(set(fps))
    root = {f: f for f in known}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(known):
        for b in known[:i]:
            if (a ^ b).bit_count() <= 3:
                root[find(a)] = find(b)
    least = {}
    for d, f in zip(rows, fps):
        if d is not None:
            least[find(f)] = min(d, least.get(find(f), d))
    return sorted(((d, f"{f:016x}", least.get(find(f))) for d, f in zip(rows, fps)), key=repr)


def near_texts(draw, base, n, most):
    out = []
    for _ in range(n):
        w = base.split()
        for _ in range(draw.randrange(most)):
            w[draw.randrange(len(w))] = f"z{draw.randrange(50)}"
        out.append(" ".join(w))
    return out


def test_groups(spark, all_docs):
    draw = random.Random(3)
    base = " ".join(f"b{draw.randrange(400)}" for _ in range(300))
    texts = near_texts(draw, base, 120, 12) + [base] * 30 + ["", None, "  \n ", "One", "one", "Two  WORDS", "two words", "a b c", "x" * 50_000, "w " * 120_000]
    rows = [(10_000 + i, t) for i, t in enumerate(texts)] + [(10_000, "another text of the same id"), (None, base), (None, "nobody's text at all")]
    docs = all_docs.select("doc_id", "text").union(spark.createDataFrame(rows, "doc_id long, text string"))
    held = [(r.doc_id, r.text) for r in docs.collect()]
    want = plain_groups([d for d, _ in held], [plain_fingerprint(t) for _, t in held])
    clash = docs.selectExpr("*", "'c' AS component_id", "1 AS fp", "2 AS salt")
    got = sorted(map(tuple, simhash.groups(clash).collect()), key=repr)
    assert got == want
    assert len({c for _, _, c in got}) < len(got) - 50
    kept = simhash.remove_copies(clash)
    assert kept.columns == clash.columns and kept.count() == sum(c is None or d is None or d == c for d, _, c in got)


@pytest.mark.parametrize(("seed", "cell"), [(1, 512), (2, 40)])
def test_links_of_dense_fingerprints(spark, monkeypatch, seed, cell):
    """Fingerprints a few bits from some centers, and chains three bits apart: components as over all pairs."""
    draw = random.Random(seed)
    found = {0, (1 << 64) - 1}
    for _ in range(6):
        center = draw.getrandbits(64)
        for _ in range(200):
            found.add(center ^ sum(1 << b for b in draw.sample(range(64), draw.randrange(6))))
        for _ in range(40):
            center ^= sum(1 << b for b in draw.sample(range(64), 3))
            found.add(center)
    found |= {0b01, 0b10, 0b11, 0b0110}
    known = sorted(found)
    signed = [int(np.uint64(f).view(np.int64)) for f in known]
    monkeypatch.setattr(simhash, "CELL", cell)
    nodes = spark.createDataFrame([(f,) for f in signed], "fp long")
    links = simhash.links(nodes.select("fp", simhash.counts(nodes.fp).alias("u")))
    roots = {r.node: r.root for r in simhash.components(links).collect()}
    mine, theirs = {}, {}
    for f, s, (_, _, c) in zip(known, signed, sorted(plain_groups(known, known))):
        mine.setdefault(roots.get(s, s), set()).add(f)
        theirs.setdefault(c, set()).add(f)
    assert {frozenset(x) for x in mine.values()} == {frozenset(x) for x in theirs.values()}
    assert links.count() < 60 * len(known)


def test_lower_bound():
    draw = np.random.default_rng(0)
    a = draw.integers(0, 1 << 63, 5000, dtype=np.uint64)
    b = a ^ (np.uint64(1) << draw.integers(0, 64, 5000, dtype=np.uint64)) ^ (np.uint64(1) << draw.integers(0, 64, 5000, dtype=np.uint64))
    counts = lambda x: np.stack([np.bitwise_count((x >> np.uint64(2 * i)) & np.uint64(3)).astype(int) for i in range(32)])
    manhattan = np.abs(counts(a) - counts(b)).sum(axis=0)
    assert (np.bitwise_count(simhash.unary(a) ^ simhash.unary(b)) == manhattan).all()
    assert (manhattan <= np.bitwise_count(a ^ b)).all() and (manhattan < np.bitwise_count(a ^ b)).any()


def test_nothing(spark):
    assert simhash.groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    with pytest.raises(ValueError, match="3 differing bits"):
        simhash.links(None, 4)
