"""Sales summaries (A1–A5) and the KPI blocks (K1–K6).

All are hash aggregates with a partial (map-side) and a final phase, so a hot
sku or region is pre-combined inside each task before the shuffle.  Money is
summed exactly (``exact_sum``); quantities are whole numbers.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockroom.functions.exprs import exact_avg, exact_sum, first, order_sides, ratio


def sales_filter(sales: DataFrame, start_date: str | None = None, end_date: str | None = None,
                 sku: str | None = None, region: str | None = None) -> DataFrame:
    """AND of the optional predicates; both date bounds inclusive.

    Literal predicates on stored columns, so they reach the parquet scan as
    pushed filters when ``sales`` is a stored table.
    """
    conds: list[Column] = []
    if start_date:
        conds.append(F.col("date") >= F.lit(start_date).cast("date"))
    if end_date:
        conds.append(F.col("date") <= F.lit(end_date).cast("date"))
    if sku:
        conds.append(F.col("sku") == F.lit(sku))
    if region:
        conds.append(F.col("region") == F.lit(region))
    return sales.where(reduce(lambda a, b: a & b, conds)) if conds else sales


def sales_rows(sales: DataFrame, limit: int | None = 50, **filters) -> DataFrame:
    """L1: filtered rows, first ``limit`` (None: all) in a total order of all columns."""
    df = sales_filter(sales, **filters)
    return first(df.orderBy(*[F.col(c).asc_nulls_last() for c in df.columns]), limit)


def sales_summary(sales: DataFrame, empty_as_zero: bool = True, **filters) -> DataFrame:
    """A1 (tool, ``empty_as_zero``) / A2 (service) one-row summary."""
    df = sales_filter(sales, **filters)
    z = (lambda c: F.coalesce(c, F.lit(0.0))) if empty_as_zero else (lambda c: c)
    names = (("total_quantity", "total_revenue", "avg_revenue_per_record",
              "earliest_date", "latest_date") if empty_as_zero else
             ("total_quantity", "total_revenue", "avg_revenue", "date_from", "date_to"))
    return df.agg(
        F.count(F.lit(1)).alias("total_records"),
        F.countDistinct("sku").alias("unique_skus"),
        z(F.sum("quantity")).alias(names[0]),
        z(exact_sum("revenue")).alias(names[1]),
        z(exact_avg("revenue")).alias(names[2]),
        F.min("date").alias(names[3]),
        F.max("date").alias(names[4]),
    )


def sales_by(sales: DataFrame, key: str, limit: int | None = 50, **filters) -> DataFrame:
    """A3–A5: totals per ``key`` (sku / date / region), top ``limit`` (None: all).

    ``date`` is ordered newest first, the others by revenue descending; the key
    breaks ties.  ``orderBy().limit()`` plans as TakeOrderedAndProject: each
    task keeps its own top ``limit`` and only those reach the driver.
    """
    df = sales_filter(sales, **filters)
    agg = df.groupBy(key).agg(
        F.sum("quantity").alias("total_qty"),
        exact_sum("revenue").alias("total_revenue"),
        F.count(F.lit(1)).alias("num_records"),
    )
    order = ([F.col(key).desc_nulls_last()] if key == "date"
             else [F.col("total_revenue").desc_nulls_last(), F.col(key).asc_nulls_last()])
    return first(agg.orderBy(*order), limit)


# ---------------------------------------------------------------------------
# KPI blocks
# ---------------------------------------------------------------------------
def kpi_sales(sales: DataFrame) -> DataFrame:
    """K1 + K2: one wide row of sales indicators."""
    return sales.agg(
        F.count(F.lit(1)).alias("total_transactions"),
        F.countDistinct("sku").alias("unique_products"),
        F.coalesce(exact_sum("revenue"), F.lit(0.0)).alias("total_revenue"),
        F.coalesce(exact_avg("revenue"), F.lit(0.0)).alias("avg_revenue"),
        F.coalesce(F.sum("quantity"), F.lit(0.0)).alias("total_units_sold"),
        F.round(F.avg(ratio("revenue", "quantity")), 6).alias("avg_unit_price"),
    )


def kpi_inventory(inventory: DataFrame) -> DataFrame:
    """K3: stock count, units, items at/below reorder point, value at cost."""
    q = F.col("qty_on_hand")
    return inventory.agg(
        F.count(F.lit(1)).alias("total_skus_tracked"),
        F.coalesce(F.sum(q), F.lit(0)).cast("long").alias("total_units_in_stock"),
        F.sum(F.when(q <= F.col("reorder_point"), 1).otherwise(0)).cast("long")
        .alias("items_needing_reorder"),                       # null on an empty table
        F.coalesce(F.avg(q), F.lit(0.0)).alias("avg_stock_level"),
        F.coalesce(exact_sum(q.cast("double") * F.col("unit_cost")), F.lit(0.0))
        .alias("estimated_inventory_value"),
    )


def kpi_suppliers(suppliers: DataFrame) -> DataFrame:
    """K4: supplier count, mean lead time, mean rating, countries."""
    return suppliers.agg(
        F.count(F.lit(1)).alias("total_suppliers"),
        F.coalesce(F.avg("lead_time"), F.lit(0.0)).alias("avg_lead_time_days"),
        F.coalesce(exact_avg("rating"), F.lit(0.0)).alias("avg_supplier_rating"),
        F.countDistinct("country").alias("supplier_countries"),
    )


def kpi_orders(orders: DataFrame) -> DataFrame:
    """K5: distinct purchase orders, units ordered, distinct skus."""
    return order_sides(orders).select(
        F.col("n_po").alias("total_purchase_orders"),
        F.coalesce(F.col("qty"), F.lit(0.0)).alias("total_units_ordered"),
        F.col("n_sku").alias("unique_skus_ordered"),
    )


def _long(block: DataFrame, area: str) -> DataFrame:
    pairs = ", ".join(f"'{c}', CAST(`{c}` AS DOUBLE)" for c in block.columns)
    return block.selectExpr(f"'{area}' AS area", f"stack({len(block.columns)}, {pairs}) AS (metric, value)")


def kpi_dashboard(sales: DataFrame, inventory: DataFrame, suppliers: DataFrame,
                  orders: DataFrame) -> DataFrame:
    """K6: the four one-row blocks in long form ``(area, metric, value)``."""
    blocks = [
        _long(kpi_sales(sales).drop("avg_unit_price"), "sales"),
        _long(kpi_inventory(inventory), "inventory"),
        _long(kpi_suppliers(suppliers), "suppliers"),
        _long(kpi_orders(orders), "purchase_orders"),
    ]
    return reduce(DataFrame.unionByName, blocks)
