"""Brute-force versions of the scans, in plain Python."""

import hashlib
import re
from collections import Counter

import pytest

from tracelake.llm import decontaminate, licenses, quality, secrets

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ASCII_LOWER = {i: i + 32 for i in range(65, 91)}


def words_of(text):
    return ALNUM.findall((text or "").translate(ASCII_LOWER))


def base_spans(text):
    text, found = text or "", []
    kinds = [("assign", r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12), ("access", "AKIA[A-Z0-9]+", 0, 18), ("hex", "[0-9a-f]+", 0, 16)]
    for rank, (kind, pattern, group, least) in enumerate(kinds):
        found += [(m.start(), rank, kind, m.end()) for m in re.finditer(pattern, text) if len(m.group(group)) >= least]
    return sorted(found)


def shown(found):
    return ",".join(f"{k}:{s}:{e}" for s, _, k, e in found)


def test_secrets(all_docs):
    rows = {(r.doc_id, r.base_sha256): r for r in secrets.report(all_docs).collect()}
    for d in all_docs.collect():
        want = base_spans(d.text)
        r = rows[(d.doc_id, hashlib.sha256(shown(want).encode()).hexdigest())]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(x[2] == k for x in want) for k in ("assign", "access", "hex"))
        assert [x for x in r.spans.split(",") if x and not x.startswith("random")] == [x for x in shown(want).split(",") if x]


def test_markov_finds_random_strings_only(all_docs):
    odd = {r.doc_id: r for r in secrets.report(all_docs).where("doc_id = 21").collect()}[21]
    assert odd.spans == "random:4:24"


def test_redaction(all_docs):
    rows = {r.doc_id: r for r in secrets.redact(all_docs).where("doc_id < 1000").collect()}
    assert rows[12].text == "[SECRET] [SECRET] [SECRET] [SECRET]" and rows[12].n_chars == 35
    assert rows[11].text == '[SECRET]" [SECRET] passwd=short [SECRET]'
    assert rows[5].text.startswith("one two") and rows[0].text is None
    assert secrets.redact(all_docs).columns == all_docs.columns


def places(words, phrase):
    p = phrase.split()
    return [i for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]


def test_licenses(all_docs):
    got = sorted((repr(r.doc_id), r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in licenses.report(all_docs).collect())
    want = []
    for d in all_docs.collect():
        w = words_of(d.text)
        at = [(i, label) for p, label in licenses.BASE for i in places(w, p)]
        starts = [i for i, _ in at]
        want.append((repr(d.doc_id), len(w), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in at}))))
    assert repr(got) == repr(sorted(want))


def test_license_rules(all_docs):
    rows = {r.doc_id: r for r in licenses.report(all_docs).where("doc_id < 1000").collect()}
    assert rows[18].labels == "Apache,GPL-3.0,MIT,apache,gpl,mit"
    assert rows[20].labels == "CC-BY-NC,all-rights-reserved" and rows[20].score == 1.0
    assert rows[5].labels == "" and rows[5].score == 0.0
    assert all(0 <= r.score <= 1 for r in rows.values())
    assert len(licenses.rules()) > 300


def judged(words, items):
    hit, found = set(), set()
    for item, text in items:
        w = words_of(text)
        n = min(13, len(w))
        windows = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
        for i in range(len(words) - n + 1):
            if tuple(words[i : i + n]) in windows:
                found.add(str(item))
                hit.update(range(i, i + n))
    return len(hit), sorted(found)


def test_decontamination(spark, all_docs, benchmark):
    items = [(r.item_id, r.text) for r in benchmark.collect()] + [(900, "Two words"), (901, None), (902, "..."), (903, "seven eight nine"), (904, "été Été")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    texts = [d.text for d in all_docs.collect()]
    got = sorted((repr(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontaminate.report(all_docs, bench).collect())
    want = []
    for d in all_docs.collect():
        w = words_of(d.text)
        n, found = judged(w, items)
        want.append((repr(d.doc_id), len(w), n, len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), n > 0 and 20 * n >= len(w)))
    assert got == sorted(want) and sum(x[2] > 0 for x in want) > 5 and len(texts) == len(got)
    kept = decontaminate.remove_documents(all_docs, bench)
    assert kept.columns == all_docs.columns and kept.count() == sum(not x[5] for x in want)
    empty = decontaminate.report(all_docs, bench.limit(0))
    assert empty.where("contaminated or n_hit > 0").count() == 0 and empty.count() == len(want)
    assert decontaminate.remove_spans(all_docs, bench).count() == len(want)
    joined = sorted((repr(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontaminate.report(all_docs, bench, broadcast_windows=0, broadcast_hits=0).collect())
    assert joined == got


@pytest.mark.parametrize("bound", [decontaminate.BROADCAST_WINDOWS, 0])
def test_words_of_other_alphabets(spark, bound):
    """A capital sigma before a full stop and before a space, capitals that only other alphabets have, repeated rows."""
    ten = "one two three four five six seven eight nine ten eleven"
    item = f"{ten} \u039f\u0394\u039f\u03a3 twelve"
    bench = spark.createDataFrame([(1, item), (1, item), (2, "\u00c9T\u00c9 \u0130x"), (3, None)], "item_id long, text string")
    texts = [f"{ten.upper()} \u039f\u0394\u039f\u03a3.twelve", f"{ten} \u03bf\u03b4\u03bf\u03c2 twelve", "\u00c9t\u00c9 \u0130X", "\u00e9t\u00e9 i\u0307x", item, item, None, ""]
    docs = spark.createDataFrame([(i, t, "clash", "clash") for i, t in enumerate(texts)], "doc_id long, text string, judged string, known string")
    rows = {r.doc_id: r for r in decontaminate.report(docs, bench, broadcast_windows=bound, broadcast_hits=bound).collect()}
    assert [rows[i].n_hit for i in range(8)] == [13, 0, 2, 0, 13, 13, 0, 0]
    kept = decontaminate.remove_documents(docs, bench, broadcast_windows=bound, broadcast_hits=bound)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3, 6, 7]
    cut = decontaminate.remove_spans(docs, bench, broadcast_windows=bound, broadcast_hits=bound)
    assert cut.columns == docs.columns and {r.doc_id: r.text for r in cut.collect()}[2] == ""


def repeated(words):
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    count = Counter(windows)
    return len({k for i, x in enumerate(windows) if count[x] > 1 for k in range(i, i + 5)})


def test_quality(all_docs, small_labels):
    labels = small_labels.selectExpr("doc_id + 1000 as doc_id", "quality")
    rows = quality.report(all_docs, labels).collect()
    got = sorted((repr(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows)
    want = []
    for d in all_docs.collect():
        t = d.text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        n = repeated(w)
        want.append((repr(d.doc_id), len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), n, len(w) < 10 or 100 * n > 20 * len(w)))
    assert got == sorted(want)
    truth = {r.doc_id: r.quality for r in labels.collect()}
    judged = [(r.kept, bool(truth[r.doc_id])) for r in rows if r.doc_id in truth and not r.base_failed]
    assert sum(a == b for a, b in judged) > 0.9 * len(judged)
    assert not any(r.kept for r in rows if r.base_failed)
    assert quality.report(all_docs, labels.limit(0)).where("kept = base_failed").count() == 0
