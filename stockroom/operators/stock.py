"""Stock operators: reorder recommendations (J5), status board (L5), critical stock."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockroom.functions.exprs import ratio, stock_label, times

# Reorder priority labels, in rank order.
PRIORITIES = (
    "URGENT - OUT OF STOCK",
    "URGENT - CRITICAL LOW",
    "ORDER NOW",
    "ORDER SOON",
    "OK",
)


def _priority_rank():
    q, rp = F.col("qty_on_hand"), F.col("reorder_point")
    return (F.when(q <= 0, 0)
            .when(q <= times(rp, 0.5), 1)
            .when(q <= rp, 2)
            .when(q <= times(rp, 1.5), 3)
            .otherwise(4))


def demand_per_sku(sales: DataFrame) -> DataFrame:
    """Mean quantity per sales *record* of each sku (not per day)."""
    return sales.groupBy("sku").agg(F.avg("quantity").alias("avg_daily_demand"))


def reorder_recommendations(inventory: DataFrame, suppliers: DataFrame,
                            sales: DataFrame) -> DataFrame:
    """Items at or below 1.5× their reorder point, with supplier and demand.

    Plan: the stock filter runs before any join; demand is a partial+final
    hash aggregate at sku grain joined *left* (rows without sales get 0) —
    first, so that on sku-bucketed stored tables it reads co-located buckets;
    then suppliers join left on ``supplier_id``.  Join strategies are left to AQE
    (broadcast when a side measures under the threshold, sort-merge otherwise).
    Output is ordered by priority rank, stock level, sku.
    """
    low = (inventory
           .where(F.col("qty_on_hand") <= times("reorder_point", 1.5))
           .select("sku", "qty_on_hand", "reorder_point", "unit_cost", "supplier_id"))
    sup = suppliers.select("supplier_id", "supplier_name",
                           F.col("lead_time").alias("supplier_lead_time_days"))
    demand = demand_per_sku(sales.select("sku", "quantity"))
    rank = _priority_rank()
    labels = F.element_at(F.array(*[F.lit(p) for p in PRIORITIES]), rank + 1)
    # demand first: on stored tables bucketed by sku this join needs no shuffle
    return (low.join(demand, "sku", "left")
            .join(sup, "supplier_id", "left")
            .select("sku", "qty_on_hand", "reorder_point",
                    (F.col("reorder_point") - F.col("qty_on_hand")).alias("units_below_reorder"),
                    "unit_cost", "supplier_id", "supplier_name", "supplier_lead_time_days",
                    F.coalesce(F.col("avg_daily_demand"), F.lit(0.0)).alias("avg_daily_demand"),
                    labels.alias("priority"),
                    rank.alias("_rank"))
            .orderBy("_rank", "qty_on_hand", "sku")
            .drop("_rank"))


def inventory_status(inventory: DataFrame) -> DataFrame:
    """Every inventory row with REORDER / LOW / OK, needs-reorder first."""
    q, rp = F.col("qty_on_hand"), F.col("reorder_point")
    return (inventory
            .select("sku", "qty_on_hand", "reorder_point",
                    stock_label(q, rp, "REORDER", "LOW").alias("status"),
                    "location", "unit_cost")
            .orderBy(F.when(q <= rp, 0).otherwise(1), q.asc_nulls_last(), "sku"))


def critical_inventory(inventory: DataFrame) -> DataFrame:
    """Stock at or below half the reorder point; ratio ascending, nulls last."""
    q, rp = F.col("qty_on_hand"), F.col("reorder_point")
    return (inventory
            .where(q <= times(rp, 0.5))
            .select("sku", "qty_on_hand", "reorder_point", "location",
                    ratio(q, rp).alias("stock_ratio"))
            .orderBy(F.col("stock_ratio").asc_nulls_last(), "sku"))
