import hashlib
import json
import random

import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tracelake.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    "Hello, World's  fair 12!! É́ x<|endoftext|>y ", "", "  ", None, "I'M don't 'S ''s ſs İstanbul ß ǅ \x85a​b 北京 \x1ca\x00b ³½ a_b",
    " <|startoftext|> <|ENDOFTEXT|><|endoftext|><|endoftext|>", "ΑΣ ΑΣ. Σ", "a" * 5000, "!?" * 3000, "abc " * 2000, "café \U0001f600\U0001f600 naïve x", "THE the The", "THE the The",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def expected(library, text):
    found = library.encode(text or "", add_special_tokens=False)
    decoded = library.decode(found.ids, skip_special_tokens=False)
    return len(found.ids), hashlib.sha256(" ".join(map(str, found.ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


def test_same_as_the_library(spark, library):
    letters = random.Random(7)
    texts = TEXTS + ["".join(letters.choices("aeiouthnrs '!.,-éüñ1\t\n", k=letters.randrange(300))) for _ in range(200)]
    docs = spark.createDataFrame([(i, "x", t) for i, t in enumerate(texts)], "doc_id long, n_tokens string, text string")
    rows = bpe.encode_texts(docs, PATH, with_ids=True).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == expected(library, texts[r.doc_id]), texts[r.doc_id]
        assert len(r.ids) == r.n_tokens


def test_empty_table(spark):
    assert bpe.encode_texts(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_lexicon_gives_ids_of_its_words_only():
    words = {b"tops": [1], b"top": [2, 3], b"taps": [4], b"tap": [5, 6, 7]}
    lexicon = bpe.Lexicon(bpe.compile_lexicon(words))
    assert {w: lexicon.get(w) for w in words} == words
    assert lexicon.get(b"to") is None and lexicon.get(b"topss") is None and lexicon.get(b"") is None
    assert len(lexicon.final) == 5  # -ops and -aps share their states


def test_decoding_of_ids(spark, library):
    texts = TEXTS[:9] + ["mixed 12 CASE <|endoftext|> words"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    encoded = bpe.encode_texts(docs, PATH, with_ids=True)
    rows = bpe.decode_texts(encoded, PATH).collect()
    for r in rows:
        assert r.decoded == library.decode(r.ids, skip_special_tokens=False) and hashlib.sha256(r.decoded.encode()).hexdigest() == r.decoded_sha256
    odd = spark.createDataFrame([([5, 10**6, 7],), (None,), ([],)], "ids array<int>")
    assert [r.decoded for r in bpe.decode_texts(odd, PATH).collect()] == [library.decode([5, 7], skip_special_tokens=False), None, ""]


def test_two_vocabularies_in_one_session(spark, tmp_path, library):
    """A vocabulary with fewer merges, and a list of frequent words, between two runs with the whole one."""
    with open(PATH, encoding="utf-8") as f:
        spec = json.load(f)
    spec["model"]["merges"] = spec["model"]["merges"][:2000]
    (tmp_path / "small.json").write_text(json.dumps(spec))
    small = Tokenizer.from_file(str(tmp_path / "small.json"))
    docs = spark.createDataFrame([(0, "international understanding of transformers"), (1, "the cat")], "doc_id long, text string")
    for path, of, frequent in ((PATH, library, None), (str(tmp_path / "small.json"), small, ["the", "cat"]), (PATH, library, ["the", "cat"])):
        rows = {r.doc_id: r.ids for r in bpe.encode_texts(docs, path, frequent=frequent, with_ids=True).collect()}
        assert rows == {r.doc_id: of.encode(r.text, add_special_tokens=False).ids for r in docs.collect()}


def test_an_encoder_outlives_its_task(spark):
    """Reused Python workers keep their encoder: far fewer are made than there are tasks."""
    docs = spark.range(64).selectExpr("id as doc_id", "'some text' as text").repartition(64)
    encoded = bpe.encode_texts(docs, PATH)

    def opened(batches):
        from tracelake.llm import bpe as worker

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(worker._OPEN) == 1] * batch.num_rows)], ["held"])

    assert encoded.count() == 64
    assert encoded.select("n_tokens").mapInArrow(opened, "held boolean").where("held").count() == 64


def test_other_parts_are_refused(tmp_path):
    with open(PATH, encoding="utf-8") as f:
        spec = json.load(f)
    spec["normalizer"] = {"type": "NFKC"}
    (tmp_path / "odd.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError, match="normalizer"):
        bpe.Merger.read(str(tmp_path / "odd.json"))


def test_the_word_cache_is_bounded_and_keeps_frequent_words(monkeypatch):
    monkeypatch.setattr(bpe, "CACHED_WORDS", 10)
    made = []
    cache = bpe._Cache(lambda w: made.append(w) or w.upper())
    for k in range(200):
        assert cache["often"] == "OFTEN" and cache[f"w{k}"] == f"W{k}"
        assert len(cache) + len(cache.before) <= 20
    assert made.count("often") == 1 and len(made) == 201
    assert cache["x" * 100] == "X" * 100 and "x" * 100 not in cache
    cache.hold(3)
    assert len(cache) + len(cache.before) <= 6
    assert [cache[f"w{k}"] for k in range(20)] == [f"W{k}" for k in range(20)] and len(cache) + len(cache.before) <= 6
