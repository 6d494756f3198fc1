"""Filtered lookups over inventory, suppliers and purchase orders (L2–L4).

Each is filter → sort → limit; the sort always ends in a key so that the rows
kept under the limit are determined.  Predicates compare stored columns with
literals, so they are pushed into the parquet scan of a stored table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockroom.functions.exprs import first, stock_label, times


def _where(df: DataFrame, conds: list[Column]) -> DataFrame:
    return df.where(reduce(lambda a, b: a & b, conds)) if conds else df


def inventory_rows(inventory: DataFrame, sku: str | None = None, location: str | None = None,
                   status_filter: str = "all", limit: int | None = 50) -> DataFrame:
    """L2: inventory with stock_status; ``status_filter`` all / reorder_needed / low_stock."""
    q, rp = F.col("qty_on_hand"), F.col("reorder_point")
    conds = []
    if sku:
        conds.append(F.col("sku") == F.lit(sku))
    if location:
        conds.append(F.col("location") == F.lit(location))
    if status_filter == "reorder_needed":
        conds.append(q <= rp)
    elif status_filter == "low_stock":
        conds.append(q <= times(rp, 1.5))
    elif status_filter != "all":
        raise ValueError(f"unknown status_filter {status_filter!r}")
    out = (_where(inventory, conds)
           .select("sku", "qty_on_hand", "reorder_point",
                   stock_label(q, rp, "REORDER NOW", "LOW STOCK").alias("stock_status"),
                   "location", "unit_cost", "supplier_id")
           .orderBy(F.when(q <= rp, 0).otherwise(1), q.asc_nulls_last(),
                    F.col("sku").asc_nulls_last(), F.col("location").asc_nulls_last()))
    return first(out, limit)


def supplier_rows(suppliers: DataFrame, supplier_id: str | None = None,
                  country: str | None = None, min_rating: float | None = None,
                  limit: int | None = 50) -> DataFrame:
    """L3: suppliers, rating descending with nulls last.

    A ``min_rating`` of 0 (or None) applies no filter, as documented.
    """
    conds = []
    if supplier_id:
        conds.append(F.col("supplier_id") == F.lit(supplier_id))
    if country:
        conds.append(F.col("country") == F.lit(country))
    if min_rating:
        conds.append(F.col("rating") >= F.lit(float(min_rating)))
    out = _where(suppliers, conds).orderBy(F.col("rating").desc_nulls_last(),
                                           F.col("supplier_id").asc_nulls_last())
    return first(out, limit)


def po_rows(orders: DataFrame, po_number: str | None = None, sku: str | None = None,
            supplier_id: str | None = None, limit: int | None = 50) -> DataFrame:
    """L4: purchase-order lines, newest order date first (nulls last)."""
    conds = []
    if po_number:
        conds.append(F.col("po_number") == F.lit(po_number))
    if sku:
        conds.append(F.col("sku") == F.lit(sku))
    if supplier_id:
        conds.append(F.col("supplier_id") == F.lit(supplier_id))
    rest = [F.col(c).asc_nulls_last() for c in orders.columns if c != "order_date"]
    out = _where(orders, conds).orderBy(F.col("order_date").desc_nulls_last(), *rest)
    return first(out, limit)
