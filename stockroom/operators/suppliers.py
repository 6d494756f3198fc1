"""Supplier performance, profile, dependents, risk and product lists.

Each order/stock side is aggregated to supplier grain *before* it meets the
supplier table: a left join of suppliers with inventory and orders at line
grain would build (products × orders) rows per supplier first.  The
aggregates are partial+final hash aggregates, so a supplier holding a large
share of the order lines is pre-combined inside every task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockroom.functions.exprs import list_text, order_sides
from stockroom.functions.ordering import pages
from stockroom.session import scratch_path

SUPPLIER_COLS = ("supplier_id", "supplier_name", "lead_time", "contact_email", "rating", "country")

# Risk labels.
HIGH_RISK = "HIGH RISK"
MEDIUM_LEAD = "MEDIUM RISK (Long Lead Time)"
MEDIUM_RATING = "MEDIUM RISK (Low Rating)"
LOW_RISK = "LOW RISK"


def _only(suppliers: DataFrame, supplier_id: str | None) -> DataFrame:
    return suppliers.where(F.col("supplier_id") == F.lit(supplier_id)) if supplier_id else suppliers


def supplier_performance(suppliers: DataFrame, orders: DataFrame) -> DataFrame:
    """Order *lines* and units per supplier; rating descending, nulls last."""
    per = (orders.where(F.col("supplier_id").isNotNull())
           .groupBy("supplier_id")
           .agg(F.count("po_number").alias("n_lines"), F.sum("quantity").alias("qty")))
    return (suppliers.select("supplier_id", "supplier_name", "lead_time", "rating", "country")
            .join(per, "supplier_id", "left")
            .select("supplier_id", "supplier_name", "lead_time", "rating", "country",
                    F.coalesce(F.col("n_lines"), F.lit(0)).alias("total_orders"),
                    F.col("qty").alias("total_quantity_ordered"))
            .orderBy(F.col("rating").desc_nulls_last(), "supplier_id"))


def supplier_profile(suppliers: DataFrame, orders: DataFrame,
                     supplier_id: str | None = None) -> DataFrame:
    """Supplier columns plus distinct POs, units and distinct skus ordered."""
    po = orders.where(F.col("supplier_id").isNotNull())
    if supplier_id:
        po = po.where(F.col("supplier_id") == F.lit(supplier_id))
    per = order_sides(po, "supplier_id")
    return (_only(suppliers, supplier_id).select(*SUPPLIER_COLS)
            .join(per, "supplier_id", "left")
            .select(*SUPPLIER_COLS,
                    F.coalesce(F.col("n_po"), F.lit(0)).alias("total_orders"),
                    F.col("qty").alias("total_qty_ordered"),
                    F.coalesce(F.col("n_sku"), F.lit(0)).alias("unique_products")))


def supplier_dependents(inventory: DataFrame, supplier_id: str | None = None) -> DataFrame:
    """Inventory rows that depend on a supplier (all suppliers when None)."""
    inv = inventory.where(F.col("supplier_id").isNotNull())
    if supplier_id:
        inv = inv.where(F.col("supplier_id") == F.lit(supplier_id))
    return inv.select("supplier_id", "sku", "qty_on_hand", "reorder_point")


def risk_level(rating: str = "rating", lead_time: str = "lead_time"):
    """Rating < 3 high; else lead time > 20 or rating < 4 medium; else low.

    A null rating fails both rating tests, so such a supplier can be LOW.
    """
    r, lt = F.col(rating), F.col(lead_time)
    return (F.when(r < 3.0, F.lit(HIGH_RISK))
            .when(lt > 20, F.lit(MEDIUM_LEAD))
            .when(r < 4.0, F.lit(MEDIUM_RATING))
            .otherwise(F.lit(LOW_RISK)))


def supplier_risk(suppliers: DataFrame, inventory: DataFrame, orders: DataFrame) -> DataFrame:
    """Products supplied, distinct POs and risk level; rating ascending, nulls last."""
    prod = (inventory.where(F.col("supplier_id").isNotNull())
            .groupBy("supplier_id").agg(F.countDistinct("sku").alias("n_sku")))
    act = (orders.where(F.col("supplier_id").isNotNull())
           .groupBy("supplier_id").agg(F.countDistinct("po_number").alias("n_po")))
    return (suppliers.select("supplier_id", "supplier_name", "rating", "lead_time", "country")
            .join(prod, "supplier_id", "left")
            .join(act, "supplier_id", "left")
            .select("supplier_id", "supplier_name", "rating", "lead_time", "country",
                    F.coalesce(F.col("n_sku"), F.lit(0)).alias("products_supplied"),
                    F.coalesce(F.col("n_po"), F.lit(0)).alias("active_orders"),
                    risk_level().alias("risk_level"))
            .orderBy(F.col("rating").asc_nulls_last(), "supplier_id"))


def supplier_products(suppliers: DataFrame, inventory: DataFrame,
                      with_list: bool = True) -> DataFrame:
    """Distinct products, total stock and sorted sku list per supplier.

    The sku list holds the distinct skus, found by a distributed aggregate, in one text.
    Ordered by products supplied, descending.  ``with_list=False`` leaves the list out, for
    suppliers whose text would not fit a row: read ``supplier_product_pages``.
    """
    pairs = (inventory.where(F.col("supplier_id").isNotNull())
             .groupBy("supplier_id", "sku")
             .agg(F.sum("qty_on_hand").alias("stock")))
    aggs = [F.count("sku").alias("n_sku"), F.sum("stock").alias("total_stock")]
    if with_list:
        aggs.append(list_text("sku").alias("sku_list"))
    per = pairs.groupBy("supplier_id").agg(*aggs)
    return (suppliers.select("supplier_id", "supplier_name", "country")
            .join(per, "supplier_id", "left")
            .select("supplier_id", "supplier_name", "country",
                    F.coalesce(F.col("n_sku"), F.lit(0)).alias("products_supplied"),
                    "total_stock", *(["sku_list"] if with_list else []))
            .orderBy(F.col("products_supplied").desc(), "supplier_id"))


def supplier_product_pages(inventory: DataFrame, size: int = 1000) -> DataFrame:
    """J7 in pages: (supplier_id, page, entries, n), at most ``size`` skus a row, sorted."""
    pairs = inventory.select("supplier_id", "sku").distinct()
    return pages(pairs, "supplier_id", "sku", size, scratch_path(inventory.sparkSession, "supplier-pages"))
