"""The registered queries of the corpus operators, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, dartminhash, decontam, fingerprints, huffman_ids, langid, quality, secrets, token_counts, url_filter
from .common import table


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(secrets.candidates(table(spark, sf_dir, "documents", "doc_id", "text", "source")))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.languages(table(spark, sf_dir, "documents", "doc_id", "text", "lang"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scores(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "quality"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.neighbours(table(spark, sf_dir, "documents", "doc_id", "text"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages", "page_id", "url"))


def op7_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(decontam.contamination(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text")))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dartminhash.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))


def op10_huffman_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return huffman_ids.round_trip(table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_token_counts,
        op2_secrets,
        op3_language,
        op4_quality,
        op5_fingerprints,
        op6_url_filter,
        op7_bpe_encode_decode,
        op8_decontamination,
        op9_near_duplicates,
        op10_huffman_ids,
        pipeline,
    )
}

_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE: dict[str, str] = {
    "op2_secrets": secrets.sql(),
    "op6_url_filter": url_filter.SQL,
    "op8_decontamination": f"""
WITH b AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + 9], ' ') AS k
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
d AS (SELECT doc_id, {_WORDS} AS w, string_split_regex(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS g FROM documents),
dw AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS k
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
hits AS (SELECT DISTINCT doc_id, i, dw.n, item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.n = bw.n),
hp AS (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM hits),
hr AS (SELECT doc_id, min(p) AS a, max(p) AS b FROM (SELECT doc_id, p, p - row_number() OVER (PARTITION BY doc_id ORDER BY p) AS run FROM hp) GROUP BY doc_id, run),
hs AS (SELECT doc_id, a, CAST(list_sum(list_transform(g[1:a], lambda z: length(z))) + coalesce(list_sum(list_transform(w[1 : a - 1], lambda z: length(z))), 0) AS BIGINT) AS s,
              CAST(list_sum(list_transform(g[1:b], lambda z: length(z))) + list_sum(list_transform(w[1:b], lambda z: length(z))) AS BIGINT) AS e FROM hr JOIN d USING (doc_id)),
hh AS (SELECT doc_id, string_agg(s || ':' || e, ',' ORDER BY a) AS places FROM hs GROUP BY doc_id),
hit AS (SELECT doc_id, count(*) AS n_hit FROM hp GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(len(w), 0) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(places, '') AS hits
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN hh USING (doc_id)""",
}
