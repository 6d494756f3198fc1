"""Stored graph versions, paged lists, the guard on analysed plans, capped statements."""

import datetime
import os

import pytest
from pyspark.sql import functions as F

from stockroom.functions.ordering import numbered, pages
from stockroom.operators import adhoc, ledger, lookups, network, suppliers
from stockroom.sources.derived import Tables
from stockroom.sources.files import allowed_file, has_allowed_name
from tests.conftest import SF_SMALL


def test_places_and_pages(spark, workdir):
    df = spark.range(1000).select((F.col("id") % 7).alias("k"), F.format_string("%04d", F.col("id")).alias("v")).repartition(9)
    got = numbered(df, ["k", "v"], os.path.join(workdir, "n")).orderBy("place").collect()
    assert [r.place for r in got] == list(range(1000)) and [(r.k, r.v) for r in got] == sorted((r.k, r.v) for r in got)
    paged = pages(df, "k", "v", 10, os.path.join(workdir, "p"))
    rows = paged.orderBy("k", "page").collect()
    assert max(r.n for r in rows) == 10 and sum(r.n for r in rows) == 1000
    for k in range(7):
        mine = [r for r in rows if r.k == k]
        assert [r.page for r in mine] == list(range(len(mine))) and all(r.n == 10 for r in mine[:-1])
        assert [x for r in mine for x in r.entries] == [f"{i:04}" for i in range(1000) if i % 7 == k]
    empty = pages(df.where("k > 9"), "k", "v", 10, os.path.join(workdir, "e"))
    assert empty.count() == 0


def test_lists_of_suppliers_and_products(spark):
    t = Tables(spark, SF_SMALL)
    skus = {}
    for r in t.inventory.collect():
        if r.supplier_id is not None:
            skus.setdefault(r.supplier_id, set()).add(r.sku)
    got = {r.supplier_id: r.sku_list for r in suppliers.supplier_products(t.supplier, t.inventory).collect()}
    assert {k: v for k, v in got.items() if v} == {k: ",".join(sorted(v)) for k, v in skus.items()}
    paged = sorted(suppliers.supplier_product_pages(t.inventory, 7).collect(), key=lambda r: r.page)
    assert {k: ",".join(",".join(r.entries) for r in paged if r.supplier_id == k) for k in skus} == {k: got[k] for k in skus}
    plan = suppliers.supplier_products(t.supplier, t.inventory)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_set" not in plan
    assert "suppliers" not in network.product_orders(t.purchase_orders, t.inventory, with_list=False).columns


def test_a_rebuild_derives_its_inputs_once_and_shuffles_little(spark, workdir):
    """Order nodes and product nodes follow from what is staged, without another aggregate by
    line or sku, and the tables are written by the tasks that hold them."""
    t = Tables(spark, SF_SMALL)
    lines, first = network.staged_lines(t.purchase_orders), network.staged_firsts(t.inventory)
    dealt = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    assert dealt(network.order_nodes(lines)) == 1 and dealt(network.product_nodes(t.inventory, first)) == 0
    network.write_graph(t.supplier, t.inventory, t.purchase_orders, workdir)
    for name, want in (("nodes", network.graph_nodes(t.supplier, t.inventory, t.purchase_orders)),
                       ("edges", network.graph_edges(t.supplier, t.inventory, t.purchase_orders))):
        got = spark.read.parquet(os.path.join(workdir, name)).select(*want.columns)
        assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
        kinds = os.listdir(os.path.join(workdir, name))
        assert all(len(os.listdir(os.path.join(workdir, name, k))) <= 2 * 8 for k in kinds if "=" in k)    # few files


def test_a_failed_rebuild_keeps_the_old_graph(spark, workdir):
    t, path = Tables(spark, SF_SMALL), os.path.join(workdir, "graph")
    first = network.rebuild_graph(t.supplier, t.inventory, t.purchase_orders, path)
    n = [df.count() for df in network.read_graph(spark, path)]
    broken = t.purchase_orders.withColumn("sku", F.when(F.col("sku").isNotNull(), F.raise_error(F.lit("lost"))))
    with pytest.raises(Exception, match="lost"):
        network.rebuild_graph(t.supplier, t.inventory, broken, path)
    assert [df.count() for df in network.read_graph(spark, path)] == n
    few = t.supplier.limit(3)
    second = network.rebuild_graph(few, t.inventory, t.purchase_orders, path)
    third = network.rebuild_graph(few, t.inventory, t.purchase_orders, path)
    assert network.read_graph(spark, path)[0].where("label = 'Supplier'").count() == 3
    kept = set(os.listdir(os.path.join(path, "versions")))
    assert {second, third} <= kept and first not in kept


@pytest.mark.parametrize("build", [network.supplier_dependencies, network.product_trace])
def test_traces_read_the_orders_once(spark, build):
    """The plan holds no scan of the order lines: they were staged in one pass."""
    t = Tables(spark, SF_SMALL)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        scans = build(t.supplier, t.inventory, t.purchase_orders)._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "l_orderkey" not in scans and "order-lines" in scans


TABLES = ["SELECT 1 AS a", "SELECT id FROM t ORDER BY id LIMIT 2", "WITH x AS (SELECT id FROM t) SELECT x.id FROM x JOIN t USING (id)",
          "SELECT id, rank() OVER (ORDER BY id) FROM t UNION ALL SELECT 1, 2", "SELECT explode(sequence(1, id)) FROM t",
          "SELECT * FROM (SELECT id AS a, 1 AS b FROM t) PIVOT (sum(b) FOR a IN (1, 2))", "SELECT * FROM range(3)",
          "SELECT * FROM VALUES (1), (2) AS v(a)", "SELECT id FROM t WHERE EXISTS (SELECT 1 FROM t u WHERE u.id = t.id)",
          "SELECT /*+ REPARTITION(2) */ id, 'hidden' FROM t", "SELECT id FROM t INTERSECT SELECT 1",
          "SELECT percentile(id, 0.5), collect_list(id) FROM t GROUP BY ROLLUP(id % 2) HAVING count(*) > 0"]


@pytest.mark.parametrize("text", TABLES)
def test_guard_lets_queries_through(spark, text):
    adhoc.run_sql(spark, {"t": spark.range(3)}, text).collect()


@pytest.mark.parametrize("text", [
    "SELECT * FROM IDENTIFIER('text.`/etc/hostname`')", "SELECT IDENTIFIER('java_method')('java.lang.System', 'getProperty', 'user.home')",
    "SELECT 'CTE [hidden]' a, h.* FROM hidden h", "SELECT * FROM t WHERE id IN (SELECT id FROM hidden)",
    "SELECT (SELECT max(id) FROM hidden) FROM t", "WITH x AS (SELECT * FROM hidden) SELECT * FROM x",
    "SELECT TRANSFORM(id) USING 'cat' AS (x) FROM t", "SELECT try_reflect('java.lang.System', 'getProperty', 'user.home')",
    "SELECT my_python(id) FROM t", "SELECT * FROM parquet.`/root/testdata/sf0.001/region.parquet`",
    "SELECT xpath_string('<a/>', 'a') FROM t", "SELECT * FROM t TABLESAMPLE (10 ROWS) JOIN hidden",
    "WITH x AS (SELECT reflect('no.such.Class', 'f') AS a) SELECT * FROM x", "SELECT id FROM t WHERE id IN (SELECT java_method('a', 'b'))",
    "SELECT id FROM t WHERE EXISTS (WITH y AS (SELECT IDENTIFIER('ref' || 'lect')('a', 'b') AS z) SELECT z FROM y)",
    "SELECT * FROM global_temp.shared", "SELECT * FROM nowhere"])
def test_guard_refuses_everything_else(spark, text):
    spark.range(1).createOrReplaceTempView("hidden")
    spark.range(1).createOrReplaceGlobalTempView("shared")
    spark.udf.register("my_python", lambda x: x, "long")
    with pytest.raises(adhoc.ReadOnlyViolation):
        adhoc.run_sql(spark, {"t": spark.range(3)}, text)


def test_capped_statement_runs_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(parts):
        for part in parts:
            seen.add(len(part))
            yield part
    df = spark.range(500).mapInPandas(count, "id long")
    head, n = adhoc.run_sql_capped(spark, {"t": df}, "SELECT id, id % 3 AS _place FROM t ORDER BY id DESC", 5)
    assert [r.id for r in head.collect()] == [499, 498, 497, 496, 495] and n == 500
    assert head.columns == ["id", "_place"]
    assert seen.value in (500, 1000)        # sorting samples its input once more
    assert adhoc.run_sql_capped(spark, {"t": df}, "SELECT id FROM t", 0)[0].count() == 0


def test_limit_of_nothing(spark):
    t = Tables(spark, SF_SMALL)
    for rows in (lookups.inventory_rows(t.inventory, limit=0), lookups.supplier_rows(t.supplier, limit=0),
                 lookups.po_rows(t.purchase_orders, limit=0)):
        assert rows.count() == 0
    assert lookups.supplier_rows(t.supplier, limit=None).count() == t.supplier.count()


def test_allowed_names(spark):
    names = ["a.csv", "B.CSV", "c.tar.csv", ".csv", "a..csv", "csv", "x.csv.gz", "dir.csv/y", "d/z.Parquet", "", "w.xlsx", "a.", None]
    got = spark.createDataFrame([(n,) for n in names], "n string").select("n", has_allowed_name(F.col("n")).alias("ok")).collect()
    assert {r.n: r.ok for r in got} == {n: bool(n) and allowed_file(n) for n in names}


def test_file_history_has_the_current_upload(spark):
    t = Tables(spark, SF_SMALL)
    got = ledger.ledger_file_history(t.ledger, 2).collect()
    for c in {r.file_category for r in got}:
        mine = [r for r in got if r.file_category == c]
        assert [r.part for r in mine] == ["current", "previous", "previous"]
        assert mine[0].upload_timestamp >= mine[1].upload_timestamp >= mine[2].upload_timestamp
    assert all(r.file_size_bytes is None for r in got)


def test_staged_lines_are_not_shuffled_to_be_grouped(spark, workdir):
    """Lines of an order, sku and supplier are staged as they come: nodes and edges group them."""
    row = "po_number string, sku string, supplier_id string, quantity double, order_date date, delivery_date date"
    day = datetime.date(2024, 1, 2)
    rows = [("PO-1", "A", "S1", 1.0, day, None), ("PO-1", "A", "S1", 2.0, None, day), ("PO-1", "A", "S2", 4.0, day, None),
            ("PO-1", "A", "S2", 4.0, day, None), (None, "A", "S1", 8.0, day, None), ("PO-2", None, "S9", None, None, None)]
    orders = spark.createDataFrame(rows, row)
    lines = network.staged_lines(orders)
    assert lines.count() == 5 and set(lines.columns) == {"po_number", "sku", "supplier_id", "quantity", "order_date"}
    suppliers_ = spark.createDataFrame([("S1", "s", "FR", 1.0, 3), ("S2", "t", "FR", None, 4)],
                                       "supplier_id string, supplier_name string, country string, rating double, lead_time int")
    stock = spark.createDataFrame([("A", "W", 1, 2, "S1")], "sku string, location string, qty_on_hand int, reorder_point int, supplier_id string")
    network.rebuild_graph(suppliers_, stock, orders, workdir)
    nodes, edges = network.read_graph(spark, workdir)
    assert {(r.node_id, r.quantity, r.order_date) for r in nodes.where("label = 'PurchaseOrder'").collect()} == {
        ("PO-1", 11.0, day), ("PO-2", None, None)}
    assert sorted((r.rel, r.src, r.dst, r.quantity) for r in edges.collect()) == [
        ("FROM_SUPPLIER", "PO-1", "S1", None), ("FROM_SUPPLIER", "PO-1", "S2", None), ("ORDERS", "PO-1", "A", 11.0),
        ("SUPPLIES", "S1", "A", None)]
