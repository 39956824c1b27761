"""The registered queries of the operators, thin digests of their outputs."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadcurve.llm import divergence, extraction, jaccard, language, licenses, mixing, neardup, pieces, pii, resampling, search, tokencounts, whitening


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_pii(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return pii.replace_entities(docs).select("doc_id", "text", "n_replaced", "kinds_replaced")


#: Documents with this remainder are held out of learning.
HELD_OUT = "coalesce(crc32(cast(doc_id as string)) % 4 = 2, false)"


def op2_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = language.learn(docs.where(f"not {HELD_OUT}"))
    return language.identify(docs, model).selectExpr("doc_id", f"{HELD_OUT} as held_out", "lang_pred", "score")


def op3_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents")).selectExpr("doc_id", "size", "source_size", "target", "size * times as taken")


def op4_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.judge(table(spark, folder, "documents"))


def op5_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return tokencounts.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).drop("field")


def op6_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.link_components(table(spark, folder, "documents"))


def op7_resampling(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return resampling.resample(docs, table(spark, folder, "labels"))


def op8_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, folder, "embeddings"))


def op9_licenses(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(table(spark, folder, "documents")).selectExpr(
        "doc_id", "n_words", "cast(size(places) as bigint) as n_base",
        "array_min(transform(places, x -> x.at)) as first_word", "array_max(transform(places, x -> x.at)) as last_word",
        "array_join(base_labels, ',') as base_labels", "array_join(labels, ',') as labels", "score",
    )


def op10_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"), ("ids_sha256", "decoded_sha256"))


def op11_search(spark: SparkSession, folder: str) -> DataFrame:
    return search.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op12_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return extraction.extract(table(spark, folder, "pages"))


def op13_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(table(spark, folder, "embeddings"))


QUERIES = {
    "op1_pii": op1_pii,
    "op2_language": op2_language,
    "op3_mixing": op3_mixing,
    "op4_divergence": op4_divergence,
    "op5_token_counts": op5_token_counts,
    "op6_jaccard": op6_jaccard,
    "op7_resampling": op7_resampling,
    "op8_embeddings": op8_embeddings,
    "op9_licenses": op9_licenses,
    "op10_sentencepiece": op10_sentencepiece,
    "op11_search": op11_search,
    "op12_extraction": op12_extraction,
    "op13_whitening": op13_whitening,
}
