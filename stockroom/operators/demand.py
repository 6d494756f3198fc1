"""Demand history, statistics, moving average and forecast (D1–D3), for every sku at once.

All of them start from a (sku, date) aggregate.  Its partial phase runs in
every task, so a sku holding a large share of the sales records is cut down
to one row per day before the shuffle; the windows then run on daily rows,
whose number per sku is bounded by the calendar, not by the sales volume.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stockroom.functions.exprs import exact_sum

EPOCH = "1970-01-01"


def _one(sales: DataFrame, sku: str | None) -> DataFrame:
    return sales.where(F.col("sku") == F.lit(sku)) if sku else sales


def demand_history(sales: DataFrame, sku: str | None = None) -> DataFrame:
    """Units and revenue per (sku, observed date); no gap filling."""
    return (_one(sales, sku).groupBy("sku", "date")
            .agg(F.sum("quantity").alias("daily_qty"),
                 exact_sum("revenue").alias("daily_revenue")))


def demand_stats(sales: DataFrame, sku: str | None = None) -> DataFrame:
    """Per sku — days with sales, mean/sd/min/max of *record* quantity, totals."""
    return (_one(sales, sku).groupBy("sku")
            .agg(F.countDistinct("date").alias("num_days"),
                 F.avg("quantity").alias("avg_daily_qty"),
                 F.round(F.stddev_samp("quantity"), 6).alias("stddev_qty"),
                 F.min("quantity").alias("min_qty"),
                 F.max("quantity").alias("max_qty"),
                 F.sum("quantity").alias("total_qty"),
                 exact_sum("revenue").alias("total_revenue")))


def demand_moving_average(sales: DataFrame, window: int = 7, sku: str | None = None) -> DataFrame:
    """Mean of the last ``window`` observed days, per sku and date."""
    w = Window.partitionBy("sku").orderBy("date").rowsBetween(-(window - 1), 0)
    return (demand_history(sales, sku)
            .select("sku", "date", "daily_qty",
                    F.avg("daily_qty").over(w).alias("moving_avg")))


def demand_forecast(sales: DataFrame, periods: int = 7, window: int = 7,
                    sku: str | None = None) -> DataFrame:
    """``periods`` future days per sku at the moving-average level.

    level = mean units of the last ``window`` observed days; the trend is the
    least-squares slope of daily units against the day number (units/day),
    reported alongside the flat forecast.
    """
    daily = demand_history(sales, sku)
    recent = Window.partitionBy("sku").orderBy(F.col("date").desc())
    day_no = F.datediff(F.col("date"), F.lit(EPOCH).cast("date"))
    fit = (daily.withColumn("rn", F.row_number().over(recent))
           .groupBy("sku")
           .agg(F.avg(F.when(F.col("rn") <= window, F.col("daily_qty"))).alias("level"),
                F.round(F.regr_slope("daily_qty", day_no), 6).alias("trend_per_day"),
                F.max("date").alias("last_date")))
    h = F.explode(F.sequence(F.lit(1), F.lit(int(periods)))).alias("period")
    return (fit.select("sku", "level", "trend_per_day", "last_date", h)
            .select("sku", "period",
                    F.date_add("last_date", F.col("period")).alias("forecast_date"),
                    F.col("level").alias("forecast_qty"), "trend_per_day"))
