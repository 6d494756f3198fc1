"""A training corpus from ``documents`` in five stages.

1. language ID: documents whose language is unknown or unsure are rejected;
2. SimHash near-duplicates: one document of every group stays;
3. personal data is redacted in place;
4. sources are mixed to their target weights, documents repeated as taken;
5. texts are encoded to token ids (and decoded again for a check).

Every stage reads what its predecessor wrote.  All but the last return the
columns of ``documents``; columns the input lacks are not invented.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from stockroom.llm import bpe_codec, common, entries, lang_id, mixture, pii, simhash  # noqa: E402
from stockroom.session import Intermediates  # noqa: E402

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
SURE = 0.3      # a document's mean probability of its language, below which it is rejected


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = lang_id.train(lang_id.learnable(docs))
    named = lang_id.identify(docs.select(*COLUMNS), model)
    keep = (F.col("lang_pred") != lang_id.UNKNOWN) & (F.col("score") >= SURE)
    return named.where(keep).select(*COLUMNS)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest id of every near-duplicate group; of rows that share
    it, the first one stored."""
    placed = common.stored_rows(docs.select(*COLUMNS), "dedup-rows")
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("_row").alias("row"))
    groups = simhash.near_duplicates(placed.select(key.alias("doc_id"), "text"))
    first = groups.where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id.row").alias("_first"))
    return placed.join(first, F.col("_row") == F.col("_first"), "left_semi").select(*COLUMNS)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = pii.redact(docs.select(*COLUMNS))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixture.emit(docs.select(*COLUMNS))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    coded = entries.digests(bpe_codec.encode(docs.select("doc_id", "lang", "source", "text")))
    return coded.select("doc_id", "lang", "source", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", known_language),
    ("simhash_near_dedup", one_of_each),
    ("personal_data", without_personal_data),
    ("source_mixture", mixed_sources),
    ("bpe_codec", token_ids),
]

# Language ID, hashing and BPE have no SQL form; tests compare run() with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``, each written and read again; what a stage
    wrote on its way, and its input from the stage before, is then removed."""
    docs = common.read(spark, sf_dir, "documents")
    with Intermediates(spark) as all_stages:
        for name, stage in STAGES:
            with Intermediates(spark) as own:
                docs = own.keep(common.cut(stage(spark, docs, sf_dir), f"stage-{name}"))
        return all_stages.keep(docs)
