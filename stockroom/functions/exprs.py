"""Column expressions shared by the operators.

Everything here is a built-in Spark expression, so it stays inside whole-stage
code generation.  Money is summed as wide decimals, which makes totals independent
of the order in which partial aggregates are merged (a sum of doubles is not);
only a finished total or mean is rounded, to ``DIGITS`` decimals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WIDE = T.DecimalType(38, 10)
WIDEST = 1e18       # from here on, and for NaN and infinities, values are added as doubles
DIGITS = 4


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def code(prefix: str, key: str | Column, width: int) -> Column:
    """``prefix || lpad(key, width, '0')`` — textual business keys."""
    return F.concat(F.lit(prefix), F.lpad(_c(key).cast("string"), width, "0"))


def times(col: str | Column, factor: float) -> Column:
    """``col * factor`` in double; exact for integer stock levels."""
    return _c(col).cast("double") * F.lit(float(factor))


def _total(c: Column) -> Column:
    """Sum of all values, unrounded: ordinary ones as decimals, the others as doubles."""
    v = c.cast("double")
    plain = F.abs(v) < F.lit(WIDEST)
    ordinary = F.sum(F.when(plain, v.cast(WIDE))).cast("double")
    others = F.sum(F.when(~plain, v))
    return F.coalesce(ordinary + others, ordinary, others)


def exact_sum(col: str | Column) -> Column:
    """Sum as DOUBLE, rounded at the end (null on no values; NaN if a value is NaN)."""
    return F.round(_total(_c(col)), DIGITS)


def exact_avg(col: str | Column) -> Column:
    """Mean as total / count of the same values, rounded at the end (null on no values)."""
    c = _c(col)
    return F.round(_total(c) / F.nullif(F.count(c), F.lit(0)).cast("double"), DIGITS)


def first(df: DataFrame, limit: int | None) -> DataFrame:
    """The first ``limit`` rows; None is no limit, 0 is none."""
    return df if limit is None else df.limit(limit)


def ratio(num: str | Column, den: str | Column) -> Column:
    """``num / NULLIF(den, 0)`` in double; null instead of an ANSI error."""
    n = _c(num).cast("double")
    d = _c(den).cast("double")
    return F.when(d != 0, n / d)


def stock_label(qty: str | Column, rp: str | Column, below: str, low: str,
                ok: str = "OK") -> Column:
    """At/below reorder point → ``below``; at/below 1.5× → ``low``; else ``ok``."""
    q, r = _c(qty), _c(rp)
    return (F.when(q <= r, F.lit(below))
            .when(q <= times(r, 1.5), F.lit(low))
            .otherwise(F.lit(ok)))


def list_text(col: str | Column) -> Column:
    """The values of a group, distinct already, sorted and joined by ',' (null when there are
    none).  The text is one row's; lists of any length come in pages (``ordering.pages``)."""
    return F.nullif(F.array_join(F.array_sort(F.collect_list(_c(col))), ","), F.lit(""))


def order_entries(orders: DataFrame, keys: list[str], *columns: str) -> DataFrame:
    """(keys, side, value, q): the distinct values of several columns of order lines, from
    one pass over them.  Entries are pre-aggregated in each task and spread by their
    value.  Those of the first column carry the units.
    """
    none = F.lit(None).cast(orders.schema["quantity"].dataType)
    sides = [F.struct(F.lit(c).alias("side"), F.col(c).cast("string").alias("value"),
                      (none if i else F.col("quantity")).alias("q")) for i, c in enumerate(columns)]
    return (orders.select(*keys, F.inline(F.array(*sides))).groupBy(*keys, "side", "value")
            .agg(F.sum("q").alias("q")))


def held(side: str) -> Column:
    """How many distinct values of a column there are, of its entries."""
    return F.count_if((F.col("side") == side) & F.col("value").isNotNull())


def order_sides(orders: DataFrame, *keys: str) -> DataFrame:
    """(keys, n_po, qty, n_sku): distinct orders, units and distinct skus of order lines."""
    return (order_entries(orders, list(keys), "po_number", "sku").groupBy(*keys)
            .agg(held("po_number").alias("n_po"), F.sum("q").alias("qty"), held("sku").alias("n_sku")))
