"""Places in a total order without a window over all rows, and lists cut into pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def numbered(df: DataFrame, order: list[str], path: str) -> DataFrame:
    """``df``, written to ``path``, with ``place``: 0, 1, … in ``order``.

    Rows are range partitioned and counted per partition; only those counts — one row
    per partition — meet in one window.
    """
    (df.repartitionByRange(*order).sortWithinPartitions(*order)
     .select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_id"))
     .write.mode("overwrite").parquet(path))
    held = df.sparkSession.read.parquet(path)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = held.groupBy("_part").agg(F.min("_id").alias("_lo"), F.count(F.lit(1)).alias("_n")).select(
        F.col("_part").alias("_p"), "_lo", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return (held.join(F.broadcast(starts), F.col("_part") == F.col("_p"))
            .withColumn("place", F.col("_start") + F.col("_id") - F.col("_lo"))
            .drop("_part", "_id", "_p", "_lo", "_start"))


def pages(pairs: DataFrame, key: str, value: str, size: int, path: str) -> DataFrame:
    """(key, page, entries, n): the sorted values of each key in lists of at most ``size``.

    ``pairs`` are distinct.  A value's page follows from its place among all pairs and its
    key's first place, so a key that holds a large share of the pairs is numbered by many
    tasks and no row or task holds all its values.
    """
    known = pairs.where(F.col(key).isNotNull() & F.col(value).isNotNull()).select(key, value)
    placed = numbered(known, [key, value], path)
    first = placed.groupBy(F.col(key).alias("_key")).agg(F.min("place").alias("_first"))
    page = F.floor((F.col("place") - F.col("_first")) / F.lit(size)).cast("long")
    return (placed.join(first, F.col(key) == F.col("_key")).groupBy(key, page.alias("page"))
            .agg(F.array_sort(F.collect_list(value)).alias("entries"))        # at most ``size``
            .withColumn("n", F.size("entries")))
