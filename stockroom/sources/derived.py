"""The four business tables (and two test fixtures) derived from the raw tables.

The mapping is fixed by ``FIXTURES.md`` §2–§4.  It is written here with the
DataFrame API; the oracle writes the same mapping as SQL, independently.

Join order is chosen by hand (Catalyst does not reorder joins without CBO
statistics): the customer → nation → region chain is folded into *orders*
before orders meet *lineitem*, so the widest table is shuffled only on
``l_orderkey`` and ``l_partkey``.  ``nation`` (25 rows) and ``region``
(5 rows) are fixed-size dimensions of the schema, so their broadcast does not
grow with the data; every other join is left to AQE, which broadcasts a side
only when its measured size is under ``autoBroadcastJoinThreshold``.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockroom.functions.exprs import code


class Tables:
    """Lazily derived tables over one directory of raw parquet files."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    # -- raw -----------------------------------------------------------------
    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def _nation(self) -> DataFrame:
        # fixed-size dimension (25 rows) — broadcast is bounded
        return F.broadcast(self.raw("nation").select("n_nationkey", "n_name", "n_regionkey"))

    def _region(self) -> DataFrame:
        # fixed-size dimension (5 rows) — broadcast is bounded
        return F.broadcast(self.raw("region").select("r_regionkey", "r_name"))

    def _orders_with_customer(self) -> DataFrame:
        cust = (self.raw("customer").select("c_custkey", "c_name", "c_nationkey")
                .join(self._nation(), F.col("c_nationkey") == F.col("n_nationkey"))
                .join(self._region(), F.col("n_regionkey") == F.col("r_regionkey"))
                .select("c_custkey", "c_name", "r_name"))
        return (self.raw("orders").select("o_orderkey", "o_custkey", "o_orderdate")
                .join(cust, F.col("o_custkey") == F.col("c_custkey"))
                .select("o_orderkey", "o_orderdate", "c_name", "r_name"))

    # -- business tables ------------------------------------------------------
    @cached_property
    def sales(self) -> DataFrame:
        li = self.raw("lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_extendedprice")
        part = self.raw("part").select("p_partkey", "p_type")
        return (li.join(self._orders_with_customer(), F.col("l_orderkey") == F.col("o_orderkey"))
                .join(part, F.col("l_partkey") == F.col("p_partkey"))
                .select(F.col("o_orderdate").cast("date").alias("date"),
                        code("SKU-", "l_partkey", 7).alias("sku"),
                        F.col("l_quantity").alias("quantity"),
                        F.col("l_extendedprice").alias("revenue"),
                        F.col("c_name").alias("customer_name"),
                        F.col("r_name").alias("region"),
                        F.col("p_type").alias("category")))

    @cached_property
    def inventory(self) -> DataFrame:
        # Main supplier of a part: most quantity shipped, ties to the smaller
        # supplier key.  Two aggregates, each with a partial (map-side) phase,
        # instead of a window: a hot part is collapsed before any shuffle.  The
        # max(struct) one is sort-based (a struct buffer is not fixed-width).
        per_pair = (self.raw("lineitem")
                    .groupBy("l_partkey", "l_suppkey")
                    .agg(F.sum("l_quantity").alias("q")))
        main = (per_pair.groupBy("l_partkey")
                .agg(F.max(F.struct(F.col("q"), (-F.col("l_suppkey")).alias("neg_supp")))
                     .alias("best"))
                .select("l_partkey", (-F.col("best.neg_supp")).alias("l_suppkey")))
        part = self.raw("part").select("p_partkey", "p_size", "p_retailprice")
        pk, size = F.col("p_partkey"), F.col("p_size")
        return (part.join(main, pk == F.col("l_partkey"), "left")
                .select(code("SKU-", pk, 7).alias("sku"),
                        ((pk * 37 + size * 11) % (size * 12 + 1)).cast("int").alias("qty_on_hand"),
                        (size * 4).cast("int").alias("reorder_point"),
                        F.concat(F.lit("WH-"), (pk % 5).cast("string")).alias("location"),
                        F.col("p_retailprice").alias("unit_cost"),
                        F.when(pk % 17 != 0, code("SUP-", "l_suppkey", 5)).alias("supplier_id")))

    @cached_property
    def supplier(self) -> DataFrame:
        sk = F.col("s_suppkey")
        return (self.raw("supplier").select("s_suppkey", "s_name", "s_nationkey")
                .join(self._nation(), F.col("s_nationkey") == F.col("n_nationkey"))
                .select(code("SUP-", sk, 5).alias("supplier_id"),
                        F.col("s_name").alias("supplier_name"),
                        (F.lit(3) + (sk * 13) % 43).cast("int").alias("lead_time"),
                        F.concat(F.lit("contact@s"), sk.cast("string"), F.lit(".com"))
                        .alias("contact_email"),
                        F.when(sk % 11 != 0, (F.lit(20) + (sk * 7) % 31).cast("double") / F.lit(10.0))
                        .alias("rating"),
                        F.col("n_name").alias("country")))

    @cached_property
    def purchase_orders(self) -> DataFrame:
        li = self.raw("lineitem").select("l_orderkey", "l_partkey", "l_suppkey",
                                         "l_quantity", "l_shipdate")
        orders = self.raw("orders").select("o_orderkey", "o_orderdate")
        return (li.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
                .select(F.concat(F.lit("PO-"), F.col("l_orderkey").cast("string")).alias("po_number"),
                        code("SKU-", "l_partkey", 7).alias("sku"),
                        F.col("l_quantity").alias("quantity"),
                        F.col("o_orderdate").cast("date").alias("order_date"),
                        F.when(F.col("l_shipdate") >= F.col("o_orderdate"),
                               F.col("l_shipdate").cast("date")).alias("delivery_date"),
                        code("SUP-", "l_suppkey", 5).alias("supplier_id")))

    # -- fixtures for the ingest and ledger operators ---------------------------
    @cached_property
    def raw_sales(self) -> DataFrame:
        """Dirty sales upload (FIXTURES §3): text dates and rule-driven defects."""
        li = self.raw("lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_extendedprice")
        orders = self.raw("orders").select("o_orderkey", "o_custkey", "o_orderdate")
        cust = self.raw("customer").select("c_custkey", "c_name")
        k = F.col("l_orderkey")
        rows = (li.join(orders, k == F.col("o_orderkey"))
                .join(cust, F.col("o_custkey") == F.col("c_custkey"))
                .select(k,
                        F.when(k % 79 == 0, F.lit("not-a-date"))
                        .when(k % 73 == 0, F.lit("2999-01-01"))
                        .otherwise(F.col("o_orderdate").cast("date").cast("string")).alias("date"),
                        F.when(k % 89 != 0, code("SKU-", "l_partkey", 7)).alias("sku"),
                        F.when(k % 83 == 0, -F.col("l_quantity"))
                        .otherwise(F.col("l_quantity")).alias("quantity"),
                        F.when(k % 71 != 0, F.col("l_extendedprice")).alias("revenue"),
                        F.col("c_name").alias("customer_name")))
        # rows with key % 97 == 0 appear twice (an exact duplicate); one scan
        # emits both copies instead of a union that would scan and join twice
        copies = F.explode(F.when(k % 97 == 0, F.array(F.lit(1), F.lit(2)))
                           .otherwise(F.array(F.lit(1))))
        return (rows.select("date", "sku", "quantity", "revenue", "customer_name", copies)
                .drop("col"))

    @cached_property
    def ledger(self) -> DataFrame:
        """Upload ledger over ``events`` (FIXTURES §4)."""
        eid = F.col("event_id")
        return self.raw("events").select(
            eid.alias("id"),
            F.col("event_type").alias("file_category"),
            F.concat(eid.cast("string"), F.lit(".csv")).alias("filename"),
            F.col("ts").alias("upload_timestamp"),
            F.when(eid % 4 == 0, F.lit("append")).otherwise(F.lit("replace")).alias("upload_mode"),
            F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("uploaded_by"),
            (F.col("user_id") * 10).cast("long").alias("row_count"),
            (F.lit(50) + eid % 51).cast("double").alias("quality_score"),
        )

    def table(self, name: str) -> DataFrame:
        """Business table by its stored name."""
        return {
            "sales_data": lambda: self.sales,
            "inventory_data": lambda: self.inventory,
            "supplier_data": lambda: self.supplier,
            "purchase_order_data": lambda: self.purchase_orders,
            "file_uploads": lambda: self.ledger,
        }[name]()
