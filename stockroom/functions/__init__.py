"""Reusable Column expressions (all JVM-side built-ins, no UDFs)."""

from stockroom.functions.exprs import (  # noqa: F401
    code,
    exact_avg,
    exact_sum,
    ratio,
    stock_label,
    times,
)
