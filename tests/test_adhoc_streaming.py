"""Read-only guard, ad-hoc SQL with caps and parameters, and the streaming upload job."""

import os

import pytest

from stockroom.operators import adhoc
from stockroom.operators.adhoc import ReadOnlyViolation, check_read_only
from stockroom.sources.derived import Tables
from stockroom.streaming.uploads import start_upload_stream
from tests.conftest import SF_SMALL


@pytest.mark.parametrize("text", [
    "SELECT 1",
    "select * from sales_data -- DROP TABLE x",
    "SELECT 'DELETE me' AS note",
    "SELECT updated_at FROM t",
    "WITH x AS (SELECT 1 AS a) SELECT a FROM x",
    "SELECT 1;",
    "SELECT '--not a comment; DROP' AS x",
    "SELECT /* DROP */ 1 -- DELETE",
])
def test_guard_accepts(text):
    check_read_only(text)


@pytest.mark.parametrize("text", [
    "DROP TABLE sales_data",
    "SELECT 1; DROP; ",
    "SELECT * FROM t WHERE 1=1 DROP;",
    "INSERT INTO t SELECT 1",
    "WITH x AS (SELECT 1) INSERT INTO t SELECT * FROM x",
    "  update t set a = 1",
    "",
    "SELECT '--' AS x; DROP TABLE t",
    "SELECT 'it''s' AS x; DELETE FROM t",
])
def test_guard_refuses(text):
    with pytest.raises(ReadOnlyViolation):
        check_read_only(text)


def test_run_sql_with_args_and_cap(spark):
    t = Tables(spark, SF_SMALL)
    tables = {"sales_data": t.sales, "inventory_data": t.inventory}
    df = adhoc.run_sql(spark, tables, "SELECT sku, quantity FROM sales_data WHERE quantity > :q",
                       args={"q": 10}, limit=7)
    rows = df.collect()
    assert len(rows) == 7 and all(r["quantity"] > 10 for r in rows)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "GlobalLimit 7" in plan


def test_stream_upload_directory(spark, workdir):
    up = os.path.join(workdir, "incoming")
    os.makedirs(up)
    header = "date,sku,quantity,revenue,customer_name,region,category\n"
    with open(os.path.join(up, "a.csv"), "w") as f:
        f.write(header + "2024-01-01,A,1,10,x,EU,c\n2024-01-01,A,1,10,x,EU,c\n2024-01-02,,1,1,x,EU,c\n")
    with open(os.path.join(up, "b.csv"), "w") as f:
        f.write(header + "2024-01-03,B,2,20,y,US,c\n")
    store = os.path.join(workdir, "store")
    q = start_upload_stream(spark, up, "sales", store,
                            checkpoint=os.path.join(workdir, "ckpt"), as_of="2026-01-01",
                            available_now=True)
    q.awaitTermination(120)
    assert q.exception() is None
    data = spark.read.parquet(os.path.join(store, "stream", "sales_data"))
    assert sorted(r["sku"] for r in data.collect()) == ["A", "B"]
    led = spark.read.parquet(os.path.join(store, "stream", "file_uploads")).collect()
    assert sum(r["row_count"] for r in led) == 2
    assert sum(r["file_size_bytes"] for r in led) == sum(os.path.getsize(os.path.join(up, n)) for n in ("a.csv", "b.csv"))


def test_run_sql_capped_reports_full_count(spark):
    t = Tables(spark, SF_SMALL)
    head, total = adhoc.run_sql_capped(spark, {"sales_data": t.sales},
                                       "SELECT sku FROM sales_data", cap=5)
    assert head.count() == 5 and total == t.sales.count()


def test_stream_restart_processes_only_new_files(spark, workdir):
    up = os.path.join(workdir, "incoming2")
    os.makedirs(up)
    header = "date,sku,quantity,revenue,customer_name,region,category\n"
    with open(os.path.join(up, "a.csv"), "w") as f:
        f.write(header + "2024-01-01,A,1,10,x,EU,c\n")
    store, ckpt = os.path.join(workdir, "store2"), os.path.join(workdir, "ckpt2")
    for _ in range(2):     # the second run finds nothing new
        q = start_upload_stream(spark, up, "sales", store, checkpoint=ckpt, as_of="2026-01-01",
                                available_now=True)
        q.awaitTermination(120)
        assert q.exception() is None
    with open(os.path.join(up, "b.csv"), "w") as f:
        f.write(header + "2024-01-02,B,2,20,y,US,c\n")
    q = start_upload_stream(spark, up, "sales", store, checkpoint=ckpt, as_of="2026-01-01",
                            available_now=True)
    q.awaitTermination(120)
    data = spark.read.parquet(os.path.join(store, "stream", "sales_data")).collect()
    assert sorted(r["sku"] for r in data) == ["A", "B"]          # a.csv loaded exactly once
    assert spark.read.parquet(os.path.join(store, "stream", "file_uploads")).count() == 2


def test_replayed_micro_batch_does_not_duplicate(spark, workdir):
    from stockroom.streaming.uploads import _batch_writer
    store = os.path.join(workdir, "store3")
    batch = spark.createDataFrame([("2024-01-01", "A", "1", "10", "x", "EU", "c")],
                                  "date string, sku string, quantity string, revenue string, "
                                  "customer_name string, region string, category string")
    write = _batch_writer("sales", store, "2026-01-01", "t")
    write(batch, 7)
    write(batch, 7)                                   # the same epoch again, as after a failure
    assert spark.read.parquet(os.path.join(store, "stream", "sales_data")).count() == 1
    assert spark.read.parquet(os.path.join(store, "stream", "file_uploads")).count() == 1
