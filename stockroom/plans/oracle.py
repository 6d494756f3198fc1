"""Independent SQL for every registered query, runnable by DuckDB on the raw tables.

The derived tables are written here a second time, as SQL CTEs, so that the
check does not share code with ``sources.derived``.  Each statement sorts or
breaks ties exactly as the DataFrame version does, so that results under LIMIT
are the same rows.
"""

from __future__ import annotations

_CTE = {
    "sales_data": """
sales_data AS (
  SELECT CAST(o_orderdate AS DATE) AS date,
         'SKU-' || lpad(CAST(l_partkey AS VARCHAR), 7, '0') AS sku,
         l_quantity AS quantity, l_extendedprice AS revenue,
         c_name AS customer_name, r_name AS region, p_type AS category
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey
  JOIN part ON l_partkey = p_partkey)""",
    "inventory_data": """
inventory_data AS (
  SELECT 'SKU-' || lpad(CAST(p_partkey AS VARCHAR), 7, '0') AS sku,
         CAST((p_partkey * 37 + p_size * 11) % (p_size * 12 + 1) AS INTEGER) AS qty_on_hand,
         CAST(p_size * 4 AS INTEGER) AS reorder_point,
         'WH-' || CAST(p_partkey % 5 AS VARCHAR) AS location,
         p_retailprice AS unit_cost,
         CASE WHEN p_partkey % 17 = 0 THEN NULL
              ELSE 'SUP-' || lpad(CAST(l_suppkey AS VARCHAR), 5, '0') END AS supplier_id
  FROM part LEFT JOIN (
    SELECT l_partkey, l_suppkey,
           row_number() OVER (PARTITION BY l_partkey ORDER BY SUM(l_quantity) DESC, l_suppkey) AS rn
    FROM lineitem GROUP BY l_partkey, l_suppkey) x
  ON l_partkey = p_partkey AND rn = 1)""",
    "supplier_data": """
supplier_data AS (
  SELECT 'SUP-' || lpad(CAST(s_suppkey AS VARCHAR), 5, '0') AS supplier_id,
         s_name AS supplier_name,
         CAST(3 + (s_suppkey * 13) % 43 AS INTEGER) AS lead_time,
         'contact@s' || CAST(s_suppkey AS VARCHAR) || '.com' AS contact_email,
         CASE WHEN s_suppkey % 11 = 0 THEN NULL
              ELSE CAST(20 + (s_suppkey * 7) % 31 AS DOUBLE) / CAST(10 AS DOUBLE) END AS rating,
         n_name AS country
  FROM supplier JOIN nation ON s_nationkey = n_nationkey)""",
    "purchase_order_data": """
purchase_order_data AS (
  SELECT 'PO-' || CAST(l_orderkey AS VARCHAR) AS po_number,
         'SKU-' || lpad(CAST(l_partkey AS VARCHAR), 7, '0') AS sku,
         l_quantity AS quantity, CAST(o_orderdate AS DATE) AS order_date,
         CASE WHEN l_shipdate >= o_orderdate THEN CAST(l_shipdate AS DATE) END AS delivery_date,
         'SUP-' || lpad(CAST(l_suppkey AS VARCHAR), 5, '0') AS supplier_id
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)""",
    "raw_sales": """
raw_base AS (
  SELECT l_orderkey AS k,
         CASE WHEN l_orderkey % 79 = 0 THEN 'not-a-date'
              WHEN l_orderkey % 73 = 0 THEN '2999-01-01'
              ELSE CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS date,
         CASE WHEN l_orderkey % 89 = 0 THEN NULL
              ELSE 'SKU-' || lpad(CAST(l_partkey AS VARCHAR), 7, '0') END AS sku,
         CASE WHEN l_orderkey % 83 = 0 THEN -l_quantity ELSE l_quantity END AS quantity,
         CASE WHEN l_orderkey % 71 = 0 THEN NULL ELSE l_extendedprice END AS revenue,
         c_name AS customer_name
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey),
raw_sales AS (
  SELECT date, sku, quantity, revenue, customer_name FROM raw_base
  UNION ALL
  SELECT date, sku, quantity, revenue, customer_name FROM raw_base WHERE k % 97 = 0)""",
    "file_uploads": """
file_uploads AS (
  SELECT event_id AS id, event_type AS file_category,
         CAST(event_id AS VARCHAR) || '.csv' AS filename,
         ts AS upload_timestamp,
         CASE WHEN event_id % 4 = 0 THEN 'append' ELSE 'replace' END AS upload_mode,
         'user' || CAST(user_id AS VARCHAR) AS uploaded_by,
         CAST(user_id * 10 AS BIGINT) AS row_count,
         CAST(50 + event_id % 51 AS DOUBLE) AS quality_score
  FROM events)""",
}


BUSINESS = ("sales_data", "inventory_data", "supplier_data", "purchase_order_data")
STORED = BUSINESS + ("raw_sales", "file_uploads")     # tables that exist once loaded


class OracleSQL(str):
    """SQL text; ``stored`` is the same query over stored business tables."""

    stored: str


def _assemble(parts: list[str], body: str) -> str:
    return f"WITH {','.join(parts)}\n{body.strip()}" if parts else body.strip()


def with_tables(body: str, *tables: str, ctes: dict[str, str] | None = None) -> OracleSQL:
    """Prefix ``body`` with the CTEs of the derived tables it reads (plus ``ctes``)."""
    extra = [f"\n{name} AS ({text.strip()})" for name, text in (ctes or {}).items()]
    out = OracleSQL(_assemble([_CTE[t] for t in tables] + extra, body))
    out.stored = _assemble([_CTE[t] for t in tables if t not in STORED] + extra, body)
    return out


def stored_table_sql(name: str) -> str:
    """A query that derives one stored table (for loading it once)."""
    return f"WITH {_CTE[name].strip()}\nSELECT * FROM {name}"
