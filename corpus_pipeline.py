"""From documents to token digests: language ID, near-dedup, decontamination, secret masking, BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of documents. run() writes each stage's rows as Parquet and reads them back for the next; a stage's
table goes when the next one's is there.

Rows with null texts have no language and leave in the first stage; rows with a null doc_id are
kept by every stage that keeps their text. Texts are processed whole, however long. Of repeated rows
and of rows with one doc_id near_dedup keeps one. Of a class of near duplicates the document with
the least id stays. Further columns are passed on as they are, whatever their names, up to the last
stage. Empty tables give empty results.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pairfield.llm import bpe, dartminhash, decontam, langid, secrets
from pairfield.llm.common import removed, scratch


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that have a language."""
    return langid.identified(docs, langid.learn(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return dartminhash.one_of_each(docs, dartminhash.near_duplicates(docs))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without a passage of the benchmark."""
    return decontam.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with credentials that look live masked."""
    return secrets.masked(docs, secrets.candidates(docs))


def bpe_encode_decode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the number of tokens, and digests of the ids and of the text decoded from them."""
    return bpe.encode_decode(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("bpe_encode_decode", bpe_encode_decode),
]

#: SQL can't express the language, near-duplicate and BPE stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the table documents of sf_dir."""
    docs, held = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            path = scratch(spark, name)
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
            if held:
                removed(spark, held)
            held = path
    return docs
