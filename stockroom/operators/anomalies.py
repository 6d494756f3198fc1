"""Outliers (X1), critical stock (X2, in ``stock``), supplier concerns (X3), combined report.

Global thresholds are scalar subqueries (``DataFrame.scalar()``), not cross
joins: Catalyst evaluates each once, merges the subqueries that read the
same table into one aggregate scan, and feeds the result into the filter.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockroom.functions.exprs import exact_avg, first, ratio
from stockroom.operators.stock import critical_inventory


def outliers(df: DataFrame, measures: dict[str, str], k: float, keep: list[str],
             order_by: list, limit: int | None) -> DataFrame:
    """Rows where any measure exceeds ``k`` × its global mean (mean of that table).

    ``measures`` maps column → "money" (mean of wide decimals) or
    "plain".  ``limit`` is the top-k of the report (None = every outlier).
    """
    cond = None
    for col, kind in measures.items():
        mean = exact_avg(col) if kind == "money" else F.avg(col)
        thr = df.select((mean * F.lit(float(k))).alias("t")).scalar()
        c = F.col(col) > thr
        cond = c if cond is None else (cond | c)
    return first(df.where(cond).select(*keep).orderBy(*order_by), limit)


def sales_anomalies(sales: DataFrame, k: float = 3.0, limit: int | None = 20) -> DataFrame:
    """X1 on sales: revenue or quantity above k × mean; revenue descending."""
    keep = ["sku", "date", "quantity", "revenue",
            ratio("revenue", "quantity").alias("unit_price")]
    order = [F.col("revenue").desc_nulls_last(), "sku", "date", "quantity"]
    return outliers(sales, {"revenue": "money", "quantity": "plain"}, k, keep, order, limit)


def event_anomalies(events: DataFrame, k: float = 3.0, limit: int | None = None) -> DataFrame:
    """X1 on the ``events`` table: value above k × mean; value descending."""
    keep = ["event_id", "ts", "user_id", "event_type", "value"]
    order = [F.col("value").desc_nulls_last(), "event_id"]
    return outliers(events, {"value": "money"}, k, keep, order, limit)


def supplier_concerns(suppliers: DataFrame, factor: float = 2.0,
                      min_rating: float = 3.0) -> DataFrame:
    """Rating below 3 or lead time above 2 × mean lead time; rating ascending."""
    thr = suppliers.select((F.avg("lead_time") * F.lit(float(factor))).alias("t")).scalar()
    return (suppliers
            .where((F.col("rating") < F.lit(min_rating)) | (F.col("lead_time") > thr))
            .select("supplier_id", "supplier_name", "rating", "lead_time", "country")
            .orderBy(F.col("rating").asc_nulls_last(), "supplier_id"))


def anomalies_all(sales: DataFrame, inventory: DataFrame, suppliers: DataFrame,
                  k: float = 3.0, category: str = "all",
                  limit: int | None = 20) -> DataFrame:
    """The three reports in long form ``(area, entity, metric, value, threshold)``.

    One row per flagged record with the measure that flagged it (revenue
    before quantity, rating before lead time).  Sales keep the report's top
    ``limit`` (None: all).
    """
    parts = []
    if category in ("sales", "all"):
        rev_thr = sales.select((exact_avg("revenue") * F.lit(float(k))).alias("t")).scalar()
        qty_thr = sales.select((F.avg("quantity") * F.lit(float(k))).alias("t")).scalar()
        top = sales_anomalies(sales, k, limit)
        by_rev = F.col("revenue") > rev_thr
        parts.append(top.select(
            F.lit("sales").alias("area"),
            F.concat_ws(" ", "sku", F.col("date").cast("string")).alias("entity"),
            F.when(by_rev, F.lit("revenue")).otherwise(F.lit("quantity")).alias("metric"),
            F.when(by_rev, F.col("revenue")).otherwise(F.col("quantity")).alias("value"),
            F.when(by_rev, rev_thr).otherwise(qty_thr).alias("threshold")))
    if category in ("inventory", "all"):
        parts.append(critical_inventory(inventory).select(
            F.lit("inventory").alias("area"), F.col("sku").alias("entity"),
            F.lit("stock_ratio").alias("metric"), F.col("stock_ratio").alias("value"),
            F.lit(0.5).alias("threshold")))
    if category in ("supplier", "all"):
        lt_thr = suppliers.select((F.avg("lead_time") * F.lit(2.0)).alias("t")).scalar()
        low = F.col("rating") < 3.0
        parts.append(supplier_concerns(suppliers).select(
            F.lit("supplier").alias("area"), F.col("supplier_id").alias("entity"),
            F.when(low, F.lit("rating")).otherwise(F.lit("lead_time")).alias("metric"),
            F.when(low, F.col("rating")).otherwise(F.col("lead_time").cast("double")).alias("value"),
            F.when(low, F.lit(3.0)).otherwise(lt_thr).alias("threshold")))
    if not parts:
        raise ValueError(f"unknown category {category!r}")
    return reduce(DataFrame.unionByName, parts)


__all__ = ["outliers", "sales_anomalies", "event_anomalies", "critical_inventory",
           "supplier_concerns", "anomalies_all"]
