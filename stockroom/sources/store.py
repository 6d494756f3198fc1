"""Stored business tables — what the upload job leaves behind, read by the operators.

``Store.materialize`` writes the four business tables once, as parquet under a
shared folder, and registers them as catalog tables.  Sales, inventory and
purchase orders are bucketed (and sorted) by ``sku`` with the same bucket
count, so that the frequent ``groupBy("sku")`` aggregates and the joins on
``sku`` between these tables (demand → reorder list, orders → stock) read
co-located buckets instead of shuffling.

Bucketing is *checked*, like a broadcast: a bucketed scan reads each bucket in
one task, so a sku holding a large share of the rows would put that share in
a single task.  Each table is derived once and written to a staging folder;
one aggregate over the staged key column measures the hottest key, and the
table is bucketed (rewritten from the staged files) only if that key alone
stays under ``skew_factor`` times an average bucket.  Otherwise the staged,
splittable files become the table and queries fall back to shuffles, where
partial aggregation and AQE's skew-join split handle the hot key.
``Store.layout`` records the decision per table.

The bucket count follows from the bytes of the largest staged table, so that one bucket
is about a task's worth of data (1 GB); each bucket is written as one file.

The landed dirty upload and the upload ledger are written too (plain parquet
over several files): they are inputs that exist as files before any query.

A ``Store`` offers the same attributes as ``sources.derived.Tables``, so every
registered query runs on either.
"""

from __future__ import annotations

import os
import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockroom.session import bucket_count, scratch_path
from stockroom.sources.derived import Tables

BUSINESS = ("sales_data", "inventory_data", "supplier_data", "purchase_order_data")
BUCKETED = {"sales_data": "sku", "inventory_data": "sku", "purchase_order_data": "sku"}
# inputs that exist as files before any query runs: the landed dirty upload and the ledger
LANDED = {"raw_sales": "raw_sales", "file_uploads": "ledger"}


class Store:
    def __init__(self, spark: SparkSession, path: str, raw: Tables, prefix: str = "stockroom"):
        self.spark = spark
        self.path = path.rstrip("/")
        self.raw_tables = raw
        self.sf_dir = raw.sf_dir
        self.prefix = re.sub(r"\W", "_", prefix)
        self.layout: dict[str, str] = {}

    def _name(self, table: str) -> str:
        return f"{self.prefix}_{table}"

    @classmethod
    def materialize(cls, tables: Tables, path: str | None = None, buckets: int | None = None,
                    prefix: str = "stockroom", skew_factor: float = 2.0) -> "Store":
        """Write (overwrite) the business tables under ``path`` and register them.

        ``path`` defaults to a new folder under the session's shared folder; ``buckets`` to
        what the largest bucketed table needs, measured on its staged files.
        """
        path = path or scratch_path(tables.spark, "store", lasting=True)
        store = cls(tables.spark, path, tables, prefix)
        spark = tables.spark
        for name in BUCKETED:       # derive once into staging (cuts lineage), decide on the written files
            tables.table(name).write.mode("overwrite").parquet(os.path.join(store.path, "_staged", name))
        if buckets is None:         # joins need one count: the one that suits the largest
            size = spark.read.format("binaryFile").option("recursiveFileLookup", True)
            buckets = bucket_count(max(size.load(os.path.join(store.path, "_staged", n)).agg(F.sum("length")).first()[0] or 0
                                       for n in BUCKETED))
        for name in BUSINESS:
            key = BUCKETED.get(name)
            table = store._name(name)
            spark.sql(f"DROP TABLE IF EXISTS {table}")     # external: files are kept
            if not key:
                (tables.table(name).write.mode("overwrite").format("parquet")
                 .option("path", os.path.join(store.path, name)).saveAsTable(table))
                store.layout[name] = "plain"
                continue
            staged = os.path.join(store.path, "_staged", name)
            staged_df = spark.read.parquet(staged)
            if _balanced(staged_df, key, buckets, skew_factor):
                (staged_df.repartition(buckets, key)              # one file per bucket
                 .write.mode("overwrite").format("parquet")
                 .option("path", os.path.join(store.path, name))
                 .bucketBy(buckets, key).sortBy(key).saveAsTable(table))
                store.layout[name] = f"bucketed({buckets}, {key})"
            else:                                                  # hot key: keep plain files
                spark.catalog.createTable(table, path=staged, source="parquet")
                store.layout[name] = "plain"
        # the landed upload is data: spread it over several files (as a multi-file
        # upload arrives) so that reads are parallel; the ledger is metadata, one row
        # per uploaded file, and is written as it comes
        (tables.raw_sales.repartition(buckets).write.mode("overwrite")
         .parquet(os.path.join(store.path, "raw_sales")))
        tables.ledger.write.mode("overwrite").parquet(os.path.join(store.path, "file_uploads"))
        store.layout.update({"raw_sales": "plain", "file_uploads": "plain"})
        return store

    def table(self, name: str) -> DataFrame:
        if name in BUSINESS:
            return self.spark.table(self._name(name))
        if name in LANDED:
            return self.spark.read.parquet(os.path.join(self.path, name))
        return self.raw_tables.table(name)

    @cached_property
    def sales(self) -> DataFrame:
        return self.table("sales_data")

    @cached_property
    def inventory(self) -> DataFrame:
        return self.table("inventory_data")

    @cached_property
    def supplier(self) -> DataFrame:
        return self.table("supplier_data")

    @cached_property
    def purchase_orders(self) -> DataFrame:
        return self.table("purchase_order_data")

    # the landed upload and the ledger, as files
    @cached_property
    def raw_sales(self) -> DataFrame:
        return self.table("raw_sales")

    @cached_property
    def ledger(self) -> DataFrame:
        return self.table("file_uploads")

    def raw(self, name: str) -> DataFrame:
        return self.raw_tables.raw(name)


def _balanced(df: DataFrame, key: str, buckets: int, skew_factor: float) -> bool:
    """True if no single key value exceeds ``skew_factor`` average buckets.

    One partial+final aggregate; only its one-row result reaches the driver.
    """
    stats = (df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
             .agg(F.max("n").alias("top"), F.sum("n").alias("total")).first())
    if not stats["total"]:
        return True
    return stats["top"] * buckets <= skew_factor * stats["total"]
