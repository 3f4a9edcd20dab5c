"""A corpus, stage by stage: toxicity, near duplicates, benchmark passages, secrets, token ids.

Every stage works on all that its predecessor kept. Toxic documents go; one document of each near-duplicate group
stays; documents that hold benchmark passages go; secrets in texts are replaced by a mark; what is left is encoded.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tracelake.llm import bpe, decontaminate, neardup, secrets, toxicity
from tracelake.llm.common import shared_dir, table

#: Fewer than the encoder keeps by itself: here its workers share an executor with those of the other stages.
ENCODER_WORDS = 30_000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that score 0.5 or more; null and empty texts stay, as do all columns. Without labels of both classes none goes."""
    return toxicity.remove_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the least id. Documents without words or id stay."""
    return neardup.remove_copies(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those of whose words a benchmark's windows hold one in twenty or more; null and empty texts stay."""
    return decontaminate.remove_documents(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with secrets replaced in the text, and n_chars put right; no document goes, null texts stay null."""
    return secrets.redact(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, number and digests of the tokens, and the ids themselves, of every document; null and empty texts have none."""
    return bpe.encode_texts(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=True, cached_words=ENCODER_WORDS)


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("secret scans", redact_secrets),
    ("bpe encoding", encode),
]

#: No SQL expresses the classifier; the pipeline is tested against its stages' brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, at = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{k}")
        docs = spark.read.parquet(f"{at}/{k}")
    return docs
