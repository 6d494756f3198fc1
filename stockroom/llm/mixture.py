"""Mixing sources to target weights by systematic sampling.

Every document of a source expects the same number of copies, the source's
target over its size (never above ``most``).  Expected copies are prefix-summed
along the source in order of size, one random offset is added, and a document
is emitted once per integer boundary its interval crosses.  Because the list
is ordered by size, the words taken miss the target by less than the source's
longest document.

Prefix sums are two-level: documents are range partitioned by (source, size,
id), counted per (partition, source), and only those counts are summed
over partitions; a source that holds most rows is spread over many partitions.

Defined cases: a null text has size 0 and takes no words; a null source is a
source of its own, last in the order; sources of no words have target 0; equal
rows are told apart by their place in their partition; ``mix`` returns its own
columns only, ``emit`` keeps all columns of the documents, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stockroom.llm import common


def size_of(text: Column) -> Column:
    return F.size(common.words(text)).cast("long")


def numbered(df: DataFrame, order: list[Column]) -> DataFrame:
    """Rows in global order with ``pid`` and ``n``, the place within the partition."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    mono = F.monotonically_increasing_id()
    return (spread.withColumn("_m", mono)
            .withColumn("pid", F.shiftright("_m", 33).cast("int"))
            .withColumn("n", F.col("_m").bitwiseAND((1 << 33) - 1)).drop("_m"))


def targets(sources: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5,
            most: float = 2.0) -> DataFrame:
    """(source, source_size) -> the same with weight and target words.

    Weights are dealt in order of the source name (code points, null last).
    Targets share ``share`` times all words by weight; none is above ``most``
    times its source, and the excess is shared again until that holds.  Each
    round is one sum over the sources table; the loop ends because every round
    fixes at least one more source.
    """
    spark = sources.sparkSession
    order = [F.col("source").isNull(), F.col("source").cast("binary")]
    placed = common.cut(numbered(sources, order), "mix-sources")
    before = W.orderBy("pid").rowsBetween(W.unboundedPreceding, -1)
    # one row per partition, not per source, goes through this window
    starts = (placed.groupBy("pid").agg(F.count(F.lit(1)).alias("c"))
              .select("pid", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("start")))
    kinds = F.array(*[F.lit(float(w)) for w in weights])
    at = ((F.col("start") + F.col("n")) % len(weights) + 1).cast("int")
    weighed = (placed.join(starts, "pid")
               .select("source", "source_size", F.element_at(kinds, at).alias("weight"),
                       (F.col("source_size") * F.lit(float(most))).alias("cap")))
    weighed = common.cut(weighed, "mix-weights")
    total = weighed.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, -1
    while True:      # level: words per unit of weight; a source is full when level * weight > cap
        full = F.col("weight") * F.lit(level) >= F.col("cap")
        row = weighed.agg(F.sum(F.when(full, F.col("cap"))).alias("filled"),
                          F.sum(F.when(~full, F.col("weight"))).alias("open"),
                          F.sum(full.cast("long")).alias("n")).first()
        if not row["open"] or (row["n"] or 0) == capped:
            break
        capped = row["n"]
        level = (share * total - (row["filled"] or 0.0)) / row["open"]
    return weighed.select(
        "source", "source_size", "weight",
        F.least(F.col("weight") * F.lit(float(level)), F.col("cap")).alias("target"))


def mix(docs: DataFrame, seed: int = 20, text: str = "text", source: str = "source",
        key: str = "doc_id", weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5,
        most: float = 2.0) -> DataFrame:
    """One row per document: key, size, source_size, target, copies, taken."""
    sized = docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"),
                        size_of(F.col(text)).alias("size"))
    sized = common.cut(sized, "mix-sizes")
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    goal = targets(per_source, weights, share, most)
    order = [F.col("source"), F.col("size"), F.col("doc_id")]
    placed = common.cut(numbered(sized, order), "mix-order")
    # place within the source = place in the partition, less where the source starts
    # there, plus its documents in earlier partitions
    parts = placed.groupBy("pid", "source").agg(F.count(F.lit(1)).alias("c"),
                                                F.min("n").alias("lo"))
    before = (W.partitionBy("source").orderBy("pid")
              .rowsBetween(W.unboundedPreceding, -1))
    parts = parts.select("pid", F.col("source").alias("_s"), "lo",
                         F.coalesce(F.sum("c").over(before), F.lit(0)).alias("start"))
    parts = (parts.join(goal, F.col("_s").eqNullSafe(F.col("source")))
             .select(F.col("pid").alias("_p"), "_s", "lo", "start", "source_size", "target"))
    ranked = placed.join(parts, (F.col("pid") == F.col("_p"))
                         & F.col("source").eqNullSafe(F.col("_s")), "left")
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    place = F.col("start") + F.col("n") - F.col("lo")
    # a random 20-bit offset per source, from a hash of the seed and its name
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("source"), F.lit("")))
    offset = F.conv(F.substring(F.md5(name.cast("binary")), 1, 5), 16, 10).cast("long") / float(1 << 20)
    crossed = F.least(F.floor(each * (place + 1) + offset) - F.floor(each * place + offset), F.ceil(each))
    return (ranked.withColumn("copies", crossed.cast("int"))
            .select("doc_id", "source", "size", "source_size", "target", "copies",
                    (F.col("size") * F.col("copies")).alias("taken")))


def emit(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus itself: every row of ``docs`` as often as it is taken.

    Rows meet their copies on the place they are stored at, so rows that are equal or
    share an id are still told apart; the place decides nothing else, so reruns agree.
    """
    stored = common.settled(docs, "mix-rows")
    row = common.free_name(docs, "row")
    key, text, source = (options.get(k, d) for k, d in (("key", "doc_id"), ("text", "text"), ("source", "source")))
    # the columns that mixing reads, under names of their own
    read = common.placed(stored.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text"),
                                       F.col(f"`{source}`").alias("source")), "row")
    asked = {k: v for k, v in options.items() if k not in ("key", "text", "source")}
    taken = (mix(read.select(F.struct("id", "row").alias("key"), "text", "source"), key="key", **asked)
             .where(F.col("copies") > 0).select(F.col("doc_id.row").alias("row"), "copies"))
    d, t = common.placed(stored, row).alias("d"), taken.alias("t")
    return (d.join(t, F.col(f"d.{row}") == F.col("t.row"))
            .select(*[F.col(f"d.`{c}`") for c in docs.columns],
                    F.explode(F.sequence(F.lit(1), F.col("t.copies"))).alias(row)).drop(row))
