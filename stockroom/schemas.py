"""Table schemas and per-category upload rules.

The column lists, required/optional split and minimum constraints below are
fixed values of the business model: they must stay as stated for results to
agree with the documented behaviour.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Stored table layouts (column order = storage order).
# ---------------------------------------------------------------------------
SALES = T.StructType([
    T.StructField("date", T.DateType()),
    T.StructField("sku", T.StringType()),
    T.StructField("quantity", T.DoubleType()),
    T.StructField("revenue", T.DoubleType()),
    T.StructField("customer_name", T.StringType()),
    T.StructField("region", T.StringType()),
    T.StructField("category", T.StringType()),
])

INVENTORY = T.StructType([
    T.StructField("sku", T.StringType()),
    T.StructField("qty_on_hand", T.IntegerType()),
    T.StructField("reorder_point", T.IntegerType()),
    T.StructField("location", T.StringType()),
    T.StructField("unit_cost", T.DoubleType()),
    T.StructField("supplier_id", T.StringType()),
])

SUPPLIER = T.StructType([
    T.StructField("supplier_id", T.StringType()),
    T.StructField("supplier_name", T.StringType()),
    T.StructField("lead_time", T.IntegerType()),
    T.StructField("contact_email", T.StringType()),
    T.StructField("rating", T.DoubleType()),
    T.StructField("country", T.StringType()),
])

PURCHASE_ORDER = T.StructType([
    T.StructField("po_number", T.StringType()),
    T.StructField("sku", T.StringType()),
    T.StructField("quantity", T.DoubleType()),
    T.StructField("order_date", T.DateType()),
    T.StructField("delivery_date", T.DateType()),
    T.StructField("supplier_id", T.StringType()),
])

LEDGER = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("file_category", T.StringType()),
    T.StructField("filename", T.StringType()),
    T.StructField("upload_timestamp", T.TimestampNTZType()),
    T.StructField("upload_mode", T.StringType()),
    T.StructField("uploaded_by", T.StringType()),
    T.StructField("row_count", T.LongType()),
    T.StructField("file_size_bytes", T.LongType()),
    T.StructField("quality_score", T.DoubleType()),
    T.StructField("validation_errors", T.StringType()),
    T.StructField("storage_path", T.StringType()),
])


@dataclass(frozen=True)
class CategoryRules:
    """Upload rules of one file category."""

    name: str
    schema: T.StructType
    required: tuple[str, ...]
    optional: tuple[str, ...]
    minimums: tuple[tuple[str, float], ...] = field(default=())
    date_column: str | None = None   # coerced to DATE, future dates flagged

    @property
    def table(self) -> str:
        return f"{self.name}_data"

    @property
    def known(self) -> tuple[str, ...]:
        return self.required + self.optional


# ---------------------------------------------------------------------------
# Required columns, optional columns and minimum constraints per
# category, in rule order (the order in which rejected rows are attributed).
# ---------------------------------------------------------------------------
CATEGORIES: dict[str, CategoryRules] = {
    "sales": CategoryRules(
        "sales", SALES,
        required=("date", "sku", "quantity", "revenue"),
        optional=("customer_name", "region", "category"),
        minimums=(("quantity", 0), ("revenue", 0)),
        date_column="date",
    ),
    "inventory": CategoryRules(
        "inventory", INVENTORY,
        required=("sku", "qty_on_hand", "reorder_point"),
        optional=("location", "unit_cost", "supplier_id"),
        minimums=(("qty_on_hand", 0), ("reorder_point", 0)),
    ),
    "supplier": CategoryRules(
        "supplier", SUPPLIER,
        required=("supplier_id", "supplier_name", "lead_time"),
        optional=("contact_email", "rating", "country"),
        minimums=(("lead_time", 0),),
    ),
    "purchase_order": CategoryRules(
        "purchase_order", PURCHASE_ORDER,
        required=("po_number", "sku", "quantity"),
        optional=("order_date", "delivery_date", "supplier_id"),
        minimums=(("quantity", 0),),
    ),
}

# Fixed value: accepted upload extensions (Spark side also reads parquet).
ALLOWED_EXTENSIONS = (".csv", ".xlsx", ".parquet")


def unknown_category(category: str) -> str:
    return f"Unknown category {category!r}; the categories are {', '.join(CATEGORIES)}"


def rules_for(category: str) -> CategoryRules:
    if category not in CATEGORIES:
        raise ValueError(unknown_category(category))
    return CATEGORIES[category]
