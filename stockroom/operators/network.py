"""Supplier–product–order relations (J6, J8) and the graph as node/edge tables.

Graph traversals are equi-joins between edge and node DataFrames.  Nodes are
keyed by id: one supplier node per supplier row, one product node per sku
(the first inventory row in a fixed order), one order node per PO number.
"""

from __future__ import annotations

import datetime as _dt
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockroom.functions.exprs import held, list_text, order_entries
from stockroom.functions.ordering import pages
from stockroom.session import remove, scratch_path, small_tasks

# Node labels and relationship names.
SUPPLIER, PRODUCT, ORDER = "Supplier", "Product", "PurchaseOrder"
SUPPLIES, ORDERS, FROM_SUPPLIER = "SUPPLIES", "ORDERS", "FROM_SUPPLIER"


def network_overview(inventory: DataFrame, suppliers: DataFrame) -> DataFrame:
    """Distinct (supplier, name, sku, stock, lead time) of stocked items."""
    sup = suppliers.select("supplier_id", "supplier_name", "lead_time")
    return (inventory.where(F.col("supplier_id").isNotNull())
            .select("supplier_id", "sku", "qty_on_hand")
            .join(sup, "supplier_id", "left")
            .select("supplier_id", "supplier_name", "sku", "qty_on_hand", "lead_time")
            .distinct()
            .orderBy(F.col("supplier_name").asc_nulls_last(), "supplier_id", "sku"))


def product_orders(orders: DataFrame, inventory: DataFrame, with_list: bool = True) -> DataFrame:
    """Per ordered sku and its stock level: distinct POs, units, supplier list.

    Orders are aggregated to sku grain first and then joined to the distinct
    (sku, qty_on_hand) pairs of inventory.  A sku stocked at several
    locations with different levels gives one row per level; equal levels at
    two locations give one row whose units are *not* doubled (a join at line
    grain would double them).  The supplier list is one text; ``with_list=False``
    leaves it out (read ``product_supplier_pages``).
    """
    aggs = [held("po_number").alias("num_orders"), F.sum("q").alias("total_ordered")]
    if with_list:
        aggs.append(list_text(F.when(F.col("side") == "supplier_id", F.col("value"))).alias("suppliers"))
    per = (order_entries(orders, ["sku"], "po_number", *(["supplier_id"] if with_list else []))
           .groupBy("sku").agg(*aggs))
    stock = inventory.select("sku", "qty_on_hand").distinct()
    return (per.join(stock, "sku", "left")
            .select("sku", "num_orders", "total_ordered", *(["suppliers"] if with_list else []),
                    F.col("qty_on_hand").alias("current_stock"))
            .orderBy(F.col("total_ordered").desc_nulls_last(), "sku"))


def product_supplier_pages(orders: DataFrame, size: int = 1000) -> DataFrame:
    """J8 in pages: (sku, page, entries, n), at most ``size`` suppliers a row, sorted."""
    pairs = orders.select("sku", "supplier_id").distinct()
    return pages(pairs, "sku", "supplier_id", size, scratch_path(orders.sparkSession, "sku-pages"))


# ---------------------------------------------------------------------------
# Nodes
# ---------------------------------------------------------------------------
NODE_COLS = ("label", "node_id", "name", "country", "rating", "lead_time",
             "qty_on_hand", "reorder_point", "location", "order_date", "quantity")


def _node(df: DataFrame, label: str, **cols) -> DataFrame:
    types = {"name": "string", "country": "string", "rating": "double", "lead_time": "int",
             "qty_on_hand": "int", "reorder_point": "int", "location": "string",
             "order_date": "date", "quantity": "double"}
    sel = [F.lit(label).alias("label"), cols.pop("node_id").cast("string").alias("node_id")]
    for c in NODE_COLS[2:]:
        sel.append((cols[c] if c in cols else F.lit(None)).cast(types[c]).alias(c))
    return df.select(*sel)


def supplier_nodes(suppliers: DataFrame) -> DataFrame:
    """G1: one node per supplier row."""
    return _node(suppliers, SUPPLIER, node_id=F.col("supplier_id"), name=F.col("supplier_name"),
                 country=F.col("country"), rating=F.col("rating"), lead_time=F.col("lead_time"))


def first_inventory_row(inventory: DataFrame) -> DataFrame:
    """The inventory row that represents a sku: smallest (location, qty, rp, supplier).

    An aggregate of ``min(struct)`` with a partial phase per task (sort-based,
    since a struct buffer is not fixed-width) — no window.
    """
    best = F.min(F.struct("location", "qty_on_hand", "reorder_point", "supplier_id")).alias("r")
    return (inventory.where(F.col("sku").isNotNull()).groupBy("sku").agg(best)
            .select("sku", "r.location", "r.qty_on_hand", "r.reorder_point", "r.supplier_id"))


def product_nodes(inventory: DataFrame, first: DataFrame | None = None) -> DataFrame:
    """One node per sku, from its first inventory row (``first``, if these are known)."""
    first = first_inventory_row(inventory) if first is None else first
    return _node(first, PRODUCT, node_id=F.col("sku"), qty_on_hand=F.col("qty_on_hand"),
                 reorder_point=F.col("reorder_point"), location=F.col("location"))


def order_lines(orders: DataFrame) -> DataFrame:
    """Order lines at (po, sku, supplier) grain: Σ quantity, earliest order date.

    The single edge types roll up from this aggregate; order nodes and ``graph_edges``
    have passes of their own.
    """
    return (orders.where(F.col("po_number").isNotNull())
            .groupBy("po_number", "sku", "supplier_id")
            .agg(F.sum("quantity").alias("quantity"), F.min("order_date").alias("order_date")))


def staged_lines(orders: DataFrame) -> DataFrame:
    """The columns of the order lines that nodes and edges need, written once to the shared
    folder: derived from them, they need no other pass over the orders, and a filter of one
    consumer cannot keep the others from sharing it.  Each of them groups the lines by its
    own keys, so they are not shuffled to be grouped here as well, and an order of very many
    lines stays spread over tasks."""
    path = scratch_path(orders.sparkSession, "order-lines")
    (orders.where(F.col("po_number").isNotNull()).select("po_number", "sku", "supplier_id", "quantity", "order_date")
     .write.mode("overwrite").option("compression", "zstd").parquet(path))
    return orders.sparkSession.read.parquet(path)


def staged_firsts(inventory: DataFrame) -> DataFrame:
    """``first_inventory_row`` written once to the shared folder, one row per sku."""
    path = scratch_path(inventory.sparkSession, "first-inventory")
    first_inventory_row(inventory).write.mode("overwrite").option("compression", "zstd").parquet(path)
    return inventory.sparkSession.read.parquet(path)


def order_nodes(orders: DataFrame) -> DataFrame:
    """One node per PO number; quantity is the PO total, date the earliest.  Orders are
    cut down to one row per task before the shuffle, also those of very many lines."""
    per = (orders.where(F.col("po_number").isNotNull()).groupBy("po_number")
           .agg(F.sum("quantity").alias("quantity"), F.min("order_date").alias("order_date")))
    return _node(per, ORDER, node_id=F.col("po_number"), quantity=F.col("quantity"), order_date=F.col("order_date"))


def graph_nodes(suppliers: DataFrame, inventory: DataFrame, orders: DataFrame,
                first: DataFrame | None = None) -> DataFrame:
    """G1–G3 together; ``first``: the first inventory rows, if they are known."""
    return reduce(DataFrame.unionByName,
                  [supplier_nodes(suppliers), product_nodes(inventory, first), order_nodes(orders)])


# ---------------------------------------------------------------------------
# Edges (src, dst) — only where both ends exist
# ---------------------------------------------------------------------------
def supplies_edges(suppliers: DataFrame, inventory: DataFrame, first: DataFrame | None = None) -> DataFrame:
    """Supplier → product, from the product's representative inventory row."""
    sup_ids = suppliers.select(F.col("supplier_id").alias("src")).distinct()
    first = first_inventory_row(inventory) if first is None else first
    return (first.where(F.col("supplier_id").isNotNull()).select(F.col("supplier_id").alias("src"), F.col("sku").alias("dst"))
            .join(sup_ids, "src")
            .select(F.lit(SUPPLIES).alias("rel"), "src", "dst", F.lit(None).cast("double").alias("quantity")))


def orders_edges(orders: DataFrame, inventory: DataFrame) -> DataFrame:
    """PO → product, one edge per (po, sku) carrying the line quantity total."""
    skus = first_inventory_row(inventory).select(F.col("sku").alias("dst"))   # product nodes
    per = (order_lines(orders).where(F.col("sku").isNotNull())
           .groupBy(F.col("po_number").alias("src"), F.col("sku").alias("dst"))
           .agg(F.sum("quantity").alias("quantity")))
    return per.join(skus, "dst").select(F.lit(ORDERS).alias("rel"), "src", "dst", "quantity")


def from_supplier_edges(orders: DataFrame, suppliers: DataFrame) -> DataFrame:
    """PO → supplier, distinct."""
    sup_ids = suppliers.select(F.col("supplier_id").alias("dst")).distinct()
    pairs = (order_lines(orders).where(F.col("supplier_id").isNotNull())
             .select(F.col("po_number").alias("src"), F.col("supplier_id").alias("dst")).distinct())
    return (pairs.join(sup_ids, "dst")
            .select(F.lit(FROM_SUPPLIER).alias("rel"), "src", "dst",
                    F.lit(None).cast("double").alias("quantity")))


def graph_edges(suppliers: DataFrame, inventory: DataFrame, orders: DataFrame,
                first: DataFrame | None = None) -> DataFrame:
    """G4–G6 together.  Every order line becomes its two candidate edges, which are
    aggregated and matched with the existing nodes once: one pass over the orders.
    ``first``: the first inventory rows, if they are known."""
    first = first_inventory_row(inventory) if first is None else first
    none = F.lit(None).cast("double")
    ends = F.array(F.struct(F.lit(ORDERS).alias("rel"), F.col("sku").alias("dst"), F.col("quantity").alias("q")),
                   F.struct(F.lit(FROM_SUPPLIER).alias("rel"), F.col("supplier_id").alias("dst"), none.alias("q")))
    lines = (orders.where(F.col("po_number").isNotNull())
             .select(F.col("po_number").alias("src"), F.inline(ends)).where(F.col("dst").isNotNull())
             .groupBy("rel", "src", "dst").agg(F.sum("q").alias("quantity")))
    nodes = (first.select(F.lit(ORDERS).alias("rel"), F.col("sku").alias("dst"))
             .union(suppliers.select(F.lit(FROM_SUPPLIER).alias("rel"), F.col("supplier_id").alias("dst"))
                    .distinct()))
    return (supplies_edges(suppliers, inventory, first)
            .unionByName(lines.join(nodes, ["rel", "dst"]).select("rel", "src", "dst", "quantity")))


# ---------------------------------------------------------------------------
# Traversals
# ---------------------------------------------------------------------------
def network_links(suppliers: DataFrame, inventory: DataFrame) -> DataFrame:
    """Every supplier and every product, linked where a SUPPLIES edge exists.

    An unlinked supplier or product appears once with nulls on the other side.
    Built as linked rows (left joins from the edges, which AQE can split when a
    supplier holds many products) plus the unlinked suppliers and products
    (anti-joins against the *distinct* linked keys) — no full outer join, whose
    skewed partitions AQE cannot split.
    """
    sup = suppliers.select("supplier_id", "supplier_name", "country", "rating")
    prod = first_inventory_row(inventory).select("sku", "qty_on_hand", "location")
    links = supplies_edges(suppliers, inventory).select(
        F.col("src").alias("supplier_id"), F.col("dst").alias("sku"))
    cols = ["supplier_id", "supplier_name", "country", "rating", "sku", "qty_on_hand", "location"]
    linked = links.join(sup, "supplier_id", "left").join(prod, "sku", "left").select(*cols)
    lonely_sup = (sup.join(links.select("supplier_id").distinct(), "supplier_id", "left_anti")
                  .select("supplier_id", "supplier_name", "country", "rating",
                          F.lit(None).cast("string").alias("sku"),
                          F.lit(None).cast("int").alias("qty_on_hand"),
                          F.lit(None).cast("string").alias("location")))
    lonely_prod = (prod.join(links.select("sku"), "sku", "left_anti")
                   .select(F.lit(None).cast("string").alias("supplier_id"),
                           F.lit(None).cast("string").alias("supplier_name"),
                           F.lit(None).cast("string").alias("country"),
                           F.lit(None).cast("double").alias("rating"),
                           "sku", "qty_on_hand", "location"))
    return linked.unionByName(lonely_sup).unionByName(lonely_prod)


def supplier_dependencies(suppliers: DataFrame, inventory: DataFrame, orders: DataFrame,
                          supplier_id: str | None = None) -> DataFrame:
    """Per supplier, its products (SUPPLIES) and orders (FROM_SUPPLIER), long form.

    The orders are read once; edges and order totals come from their staged lines.
    """
    orders = staged_lines(orders)
    prods = (supplies_edges(suppliers, inventory).select("src", "dst")
             .join(product_nodes(inventory).select(F.col("node_id").alias("dst"), "qty_on_hand"), "dst")
             .select(F.col("src").alias("supplier_id"), F.lit("product").alias("kind"),
                     F.col("dst").alias("item_id"), "qty_on_hand",
                     F.lit(None).cast("double").alias("quantity"),
                     F.lit(None).cast("date").alias("order_date")))
    ords = (from_supplier_edges(orders, suppliers).select("src", "dst")
            .join(order_nodes(orders).select(F.col("node_id").alias("src"), "quantity", "order_date"), "src")
            .select(F.col("dst").alias("supplier_id"), F.lit("order").alias("kind"),
                    F.col("src").alias("item_id"), F.lit(None).cast("int").alias("qty_on_hand"),
                    "quantity", "order_date"))
    out = prods.unionByName(ords)
    return out.where(F.col("supplier_id") == F.lit(supplier_id)) if supplier_id else out


def product_trace(suppliers: DataFrame, inventory: DataFrame, orders: DataFrame,
                  sku: str | None = None) -> DataFrame:
    """Per product, its suppliers (SUPPLIES) and orders (ORDERS), long form.

    The orders are read once; edges and order dates come from their staged lines.
    """
    orders = staged_lines(orders)
    sup = suppliers.select(F.col("supplier_id").alias("src"), "supplier_name", "lead_time", "rating")
    sups = (supplies_edges(suppliers, inventory).select("src", "dst").join(sup, "src")
            .select(F.col("dst").alias("sku"), F.lit("supplier").alias("kind"),
                    F.col("src").alias("item_id"), F.col("supplier_name").alias("name"),
                    "lead_time", "rating",
                    F.lit(None).cast("double").alias("quantity"),
                    F.lit(None).cast("date").alias("order_date")))
    ords = (orders_edges(orders, inventory)
            .join(order_nodes(orders).select(F.col("node_id").alias("src"), "order_date"), "src")
            .select(F.col("dst").alias("sku"), F.lit("order").alias("kind"),
                    F.col("src").alias("item_id"), F.lit(None).cast("string").alias("name"),
                    F.lit(None).cast("int").alias("lead_time"),
                    F.lit(None).cast("double").alias("rating"), "quantity", "order_date"))
    out = sups.unionByName(ords)
    return out.where(F.col("sku") == F.lit(sku)) if sku else out


# ---------------------------------------------------------------------------
# G10 — the stored graph
# ---------------------------------------------------------------------------
def write_graph(suppliers: DataFrame, inventory: DataFrame, orders: DataFrame, path: str) -> None:
    """Write the node and edge tables, uncapped, into a folder.

    The order lines and the first inventory rows are derived once.  Tasks write what they
    hold, without another shuffle: nodes of a task are of one kind, and edges of two at
    most, so the files of a kind are as many as the tasks that AQE leaves of the last join.
    """
    lines, first, at = staged_lines(orders), staged_firsts(inventory), path.rstrip("/")
    nodes, edges = graph_nodes(suppliers, inventory, lines, first), graph_edges(suppliers, inventory, lines, first)
    for df, kind, to in ((nodes, "label", f"{at}/nodes"), (edges, "rel", f"{at}/edges")):
        df.write.mode("overwrite").partitionBy(kind).option("compression", "zstd").parquet(to)


def rebuild_graph(suppliers: DataFrame, inventory: DataFrame, orders: DataFrame, path: str, keep: int = 2) -> str:
    """Rebuild the stored graph as a new version; its name.

    Nodes and edges go to a folder of their own under ``versions/``; only when both are
    written does a pointer to it become readable (a file appended to ``pointers/``).  A
    rebuild that fails leaves the graph that readers see as it was.  Of older versions
    the newest ``keep - 1`` stay, for readers that have just resolved one.
    """
    spark, base = suppliers.sparkSession, path.rstrip("/")
    version = f"{_dt.datetime.now(_dt.timezone.utc):%Y%m%dT%H%M%S%f}-{uuid.uuid4().hex[:8]}"
    with small_tasks(spark):
        write_graph(suppliers, inventory, orders, f"{base}/versions/{version}")
    spark.range(1).select(F.lit(version).alias("version")).write.mode("append").parquet(f"{base}/pointers")
    known = spark.read.parquet(f"{base}/pointers").select("version").distinct().orderBy(F.desc("version"))
    for row in known.limit(keep + 20).collect()[keep:]:       # a few old versions per rebuild
        remove(spark, f"{base}/versions/{row['version']}")
    return version


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the newest complete version."""
    base = path.rstrip("/")
    version = spark.read.parquet(f"{base}/pointers").agg(F.max("version")).first()[0]
    nodes, edges = (spark.read.parquet(f"{base}/versions/{version}/{name}") for name in ("nodes", "edges"))
    return nodes.select(*NODE_COLS), edges.select("rel", "src", "dst", "quantity")
