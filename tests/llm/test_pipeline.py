"""The pipeline's stages against what their operators report, each on its own input."""

import hashlib

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tracelake.llm import decontaminate, neardup, secrets

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, inputs = docs.columns, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        inputs.append(docs)
        out = stage(spark, docs, SF)
        assert k == 4 or out.columns == columns
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
    ids = [{r.doc_id for r in d.select("doc_id").collect()} for d in [*inputs, docs]]
    # so few labels may not be enough to learn what is toxic
    assert ids[1] <= ids[0] and ids[2] < ids[1] and ids[3] < ids[2] and ids[3] == ids[4] == ids[5]
    assert ids[2] == {r.doc_id for r in neardup.groups(inputs[1]).where("kept").collect()}
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert ids[3] == {r.doc_id for r in decontaminate.report(inputs[2], bench).where("not contaminated").collect()}
    left = secrets.report(inputs[4]).where("n_assign + n_access + n_hex + n_random > 0").count()
    assert left == 0 and inputs[4].where("text like '%[SECRET]%' and n_chars <> char_length(text)").count() == 0
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = {r.doc_id: r.text for r in inputs[4].collect()}
    for r in docs.collect():
        want = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.ids == want and r.ids_sha256 == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
