"""Registered queries over whole tables, one per operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockroom.llm import (alignment, bpe_codec, common, exact_dedup, hamming_topk, hard_negatives, lang_id,
                           line_quality, mixture, pii, pu_quality, simhash, token_count, warc)
from stockroom.llm.oracles import ORACLES


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = lang_id.train(lang_id.learnable(docs))
    out = lang_id.identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", lang_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op2_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_quality.score(common.read(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text")
    return token_count.count_tokens(docs).drop("text")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.detect(docs).select("doc_id", "pii")
    base = F.filter("pii", lambda s: s["kind"].isin(*pii.BASE_KINDS))
    counts = [pii.count_of(F.col("pii"), k).alias(f"n_{k}") for k in pii.BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(pii.written(base).cast("binary"), 256).alias("base_sha256"),
                        pii.written(F.col("pii")).alias("spans"))


def op5_source_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixture.mix(common.read(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op6_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text")
    labels = common.read(spark, sf_dir, "labels").select("doc_id", "quality")
    net = pu_quality.train(pu_quality.learnable(docs), pu_quality.learnable(labels))
    out = pu_quality.score(docs, net)
    return out.select("doc_id", pu_quality.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.archive(common.read(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "ts")


def op8_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text")
    return digests(bpe_codec.encode(docs)).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def digests(coded: DataFrame) -> DataFrame:
    return (coded.withColumn("ids_sha256", F.sha2("ids", 256))
            .withColumn("decoded_sha256", F.sha2(F.col("decoded").cast("binary"), 256)))


def op9_hamming_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hamming_topk.top_k(common.read(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash.near_duplicates(docs).select("doc_id", simhash.written(F.col("fp")).alias("fingerprint"),
                                                "component_id")


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicates(common.read(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = common.read(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows.select("vec_id", "embedding", label.alias("label")))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text")
    return alignment.align(docs, keep=["doc_id"])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_language_id, op2_line_quality, op3_token_counts, op4_pii, op5_source_mixture, op6_pu_quality,
           op7_warc, op8_bpe_codec, op9_hamming_topk, op10_simhash, op11_exact_dedup, op12_hard_negatives,
           op13_alignment]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
