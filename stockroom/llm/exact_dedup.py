"""Exact deduplication: counting quotient filters route, bytes decide.

Texts are equal when they are identical after every white character (space and
U+0009..U+000D) is deleted.  Each partition counts the fingerprints of its texts in
counting quotient filters (``quotient``); the filters are shuffled block by block and
merged by their sorted remainders.  Only texts whose fingerprint counts more than one
are routed on: their bytes are compared (grouped by the bytes themselves), so that
texts which merely share a fingerprint stay apart.  All other rows are known to be
alone without their text being moved.

Hot groups: copies collapse inside each filter, and inside each task before their bytes
are shuffled.  A fingerprint that holds over 1/HOT of all rows is dealt over SPREAD
keys in every join; there are fewer than HOT of them, so their list is broadcast.

Of equal texts the row with the most code points in the original text stays, then the
smallest id (null last), then the row stored first.

Defined cases: a null text is empty, and all texts of white characters only are equal;
null ids are ids like any other; repeated rows are rows of one group, of which one
stays; an empty table gives an empty result; other columns are not read by
``duplicates`` and kept by ``deduplicated``.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockroom.llm import common, quotient

WHITE = b" \t\n\x0b\x0c\r"
HOT = 1000              # a group above 1/HOT of all rows is spread
SPREAD = 64             # keys a hot group is dealt over
AT_ONCE = 1 << 21       # fingerprints a task holds before it writes their filters
BLOCK = 1 << 20         # rows per block of the filters


def plain(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Texts (UTF-8) without white characters, which are single bytes."""
    for part in parts:
        yield pd.Series([t.translate(None, WHITE) for t in part], dtype=object)


def digest(bits: int, whole: bool):
    """UTF-8 text -> struct<fp, bytes>, with the normalised text's fingerprint of
    ``bits`` bits, and its bytes if ``whole``, else their SHA-256."""
    @F.pandas_udf("fp long, bytes binary")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in plain(parts):
            prints = [xxhash.xxh64_intdigest(t) >> (64 - bits) for t in texts]
            held = texts if whole else [hashlib.sha256(t).digest() for t in texts]
            yield pd.DataFrame({"fp": np.array(prints, np.uint64).view(np.int64), "bytes": held})
    return run


def utf8(text: str) -> Column:
    return F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")


def repeated(prints: DataFrame, total: int, bits: int = 64) -> DataFrame:
    """(fp, n) of the fingerprints that occur more than once, from merged filters."""
    spark = prints.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    block_bits = min(bits - 1, max(math.ceil(math.log2(max(1, tasks))), math.ceil(math.log2(max(1, total) / BLOCK))))
    fields = list(quotient.Filter._fields)

    def build(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def written(held):
            made = quotient.build(np.concatenate(held).view(np.uint64), bits, block_bits)
            for i in range(0, len(made), 1000):
                yield pd.DataFrame(made[i:i + 1000], columns=fields)
        held, n = [], 0
        for part in parts:
            held.append(part["fp"].to_numpy(np.int64))
            n += len(part)
            if n >= AT_ONCE:
                yield from written(held)
                held, n = [], 0
        if n:
            yield from written(held)

    def merged(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, held, n = None, [], 0

        def above_one():
            found, counts = quotient.merge(held)
            more = counts > 1
            return pd.DataFrame({"fp": found[more].view(np.int64), "n": counts[more]})
        for part in parts:
            for row in part[fields].itertuples(index=False):
                f = quotient.Filter(*row)
                if f.block != block:
                    if held:
                        yield above_one()
                    block, held, n = f.block, [], 0
                held.append(quotient.items(f, bits, block_bits))
                n += len(held[-1][0])
                if n > AT_ONCE and len(held) > 1:
                    held = [quotient.merge(held)]       # grows with distinct fingerprints only
                    n = 0
        if held:
            yield above_one()

    filters = prints.select("fp").mapInPandas(build, quotient.SCHEMA)
    dealt = filters.repartition(min(tasks, 1 << block_bits), "block").sortWithinPartitions("block")
    return dealt.mapInPandas(merged, "fp long, n long")


class Route:
    """Joins on fingerprints in which the hot ones are dealt over SPREAD keys."""

    def __init__(self, suspects: DataFrame, total: int):
        self.hot = suspects.where(F.col("n") * HOT > F.lit(total)).select(F.col("fp").alias("hot_fp"))

    def _marked(self, df: DataFrame) -> DataFrame:
        # fewer than HOT rows: each holds more than 1/HOT of all
        return df.join(F.broadcast(self.hot), F.col("fp") == F.col("hot_fp"), "left")

    def dealt(self, df: DataFrame) -> DataFrame:
        """Many rows per fingerprint: each gets one key."""
        key = F.when(F.col("hot_fp").isNotNull(), F.pmod(F.monotonically_increasing_id(), F.lit(SPREAD)))
        return self._marked(df).withColumn("part", F.coalesce(key, F.lit(0).cast("long"))).drop("hot_fp")

    def copied(self, df: DataFrame) -> DataFrame:
        """Few rows per fingerprint: those of hot ones are repeated for every key."""
        keys = F.when(F.col("hot_fp").isNotNull(), F.sequence(F.lit(0).cast("long"), F.lit(SPREAD - 1).cast("long")))
        one = F.array(F.lit(0).cast("long"))
        return self._marked(df).withColumn("part", F.explode(F.coalesce(keys, one))).drop("hot_fp")


def classes(docs: DataFrame, key: str, text: str, bits: int) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, sha, _row."""
    common.python_ready(docs.sparkSession)
    placed = common.stored_rows(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), "exact-input")
    marked = placed.select("doc_id", "_row", F.coalesce(F.length("text"), F.lit(0)).alias("chars"),
                           digest(bits, False)(utf8("text")).alias("d"))
    digests = common.cut(marked.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "chars", "_row",
                                       "d.fp", F.col("d.bytes").alias("sha")), "exact-digests")
    total = digests.count()
    suspects = common.cut(repeated(digests, total, bits), "exact-suspects")
    route = Route(suspects, total)
    wanted = route.copied(suspects.select("fp"))

    # the bytes of the routed texts: how many texts does a fingerprint stand for?
    texts = placed.select(digest(bits, True)(utf8("text")).alias("d")).select("d.fp", "d.bytes")
    apart = route.dealt(texts).join(wanted, ["fp", "part"]).groupBy("fp", "bytes").count()
    texts_of = common.cut(apart.select("fp", F.sha2("bytes", 256).alias("sha")).groupBy("fp").agg(
        F.count("*").alias("texts"), F.count_distinct("sha").alias("shas")), "exact-texts")
    # where a fingerprint stands for several texts, their SHA-256 tells them apart; that it
    # does has just been counted on the bytes
    told = F.assert_true(F.col("texts") == F.col("shas"), F.lit("two texts share a SHA-256"))
    shared = texts_of.where((F.col("texts") > 1) & told.isNull()).select("fp", F.lit(True).alias("shared"))

    order = F.struct((-F.col("chars")).alias("less"), F.col("doc_id").isNull().alias("none"), "doc_id", "rid")
    routed = route.dealt(digests).join(wanted, ["fp", "part"]).groupBy("fp", "sha").agg(
        F.count("*").alias("rows"), F.min(order).alias("first"))
    # one text per fingerprint: every row of the fingerprint; else the rows of one SHA-256
    groups = routed.join(shared, "fp", "left").select(
        "fp", F.when(F.col("shared"), F.col("sha")).alias("only"), "rows",
        F.col("first.doc_id").alias("keep_id"), F.col("first.rid").alias("keep_rid"))
    groups = common.cut(route.copied(groups), "exact-groups").withColumnsRenamed({"fp": "_fp", "part": "_part"})
    met = ((F.col("fp") == F.col("_fp")) & (F.col("part") == F.col("_part"))
           & (F.col("only").isNull() | (F.col("only") == F.col("sha"))))
    alone = F.col("_fp").isNull()
    return route.dealt(digests).join(groups, met, "left").select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("rows", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("keep_rid") == F.col("rid"))).alias("kept"), "sha", "_row")


def duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", bits: int = 64) -> DataFrame:
    """One row per row of ``docs``: its group's staying id, size, whether it stays, and
    ``text_sha256`` of the normalised text.  ``bits``: width of a fingerprint; the
    result does not depend on it."""
    return classes(docs, key, text, bits).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", bits: int = 64) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    stored = common.settled(docs, "exact-docs")
    gone = classes(stored, key, text, bits).where(~F.col("kept")).select(F.col("_row").alias("r"))
    place = common.free_name(docs, "place")
    return (common.placed(stored, place).join(gone, F.col(place) == F.col("r"), "left_anti").drop(place))
