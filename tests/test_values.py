"""Uploads and totals keep the values they are given."""

import os

import pytest
from pyspark.sql import functions as F

from stockroom.functions.exprs import exact_avg, exact_sum
from stockroom.operators import adhoc, ingest, sales
from stockroom.sources.files import read_upload


def _totals(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values], "revenue double")
    return tuple(df.agg(exact_sum("revenue"), exact_avg("revenue")).first())


def test_sums_keep_decimals_and_odd_values(spark):
    assert _totals(spark, [0.004] * 1000) == (4.0, 0.004)
    assert _totals(spark, [0.1] * 10) == (1.0, 0.1)
    assert _totals(spark, [1e17, 1.0]) == (1e17 + 1, 5e16)
    assert _totals(spark, [1e30, 1.0]) == (1e30, 5e29)
    total, mean = _totals(spark, [float("nan"), 5.0])
    assert total != total and mean != mean
    empty = spark.createDataFrame([], "revenue double").agg(exact_sum("revenue"), exact_avg("revenue")).first()
    assert tuple(empty) == (None, None)


def test_caps_can_be_lifted(spark):
    df = spark.createDataFrame([(f"s{i}", float(i), 1.0) for i in range(70)], "sku string, revenue double, quantity double")
    assert sales.sales_by(df, "sku").count() == 50
    assert sales.sales_by(df, "sku", limit=None).count() == 70
    assert sales.sales_rows(df, None).count() == 70
    assert adhoc.run_sql(spark, {"t": df}, "SELECT * FROM t", limit=0).count() == 0


def _read(spark, folder, text, category):
    path = os.path.join(folder, "up.csv")
    with open(path, "w", newline="") as f:
        f.write(text)
    return ingest.tag_rows(read_upload(spark, path), category)


def test_quoted_fields(spark, workdir):
    tagged = _read(spark, workdir, 'supplier_id,supplier_name,lead_time,country\n'
                   'S1,"Acme ""X"", Inc",5,FR\nS2,"two\nlines",10.0,N/A\n', "supplier")
    rows = {r.supplier_id: r for r in ingest.clean_rows(tagged, "supplier").collect()}
    assert rows["S1"].supplier_name == 'Acme "X", Inc' and rows["S1"].lead_time == 5
    assert rows["S2"].supplier_name == "two\nlines" and rows["S2"].lead_time == 10 and rows["S2"].country is None


def test_missing_words_bad_numbers_and_dates(spark, workdir):
    tagged = _read(spark, workdir, "date,sku,quantity,revenue\n"
                   "01/15/2024,A,1,2.5\n2024-01-16,NA,1,1\n2024-01-17,B,NaN,1\n2024-01-18,C,abc,1\n"
                   "2024-01-18,C,xyz,1\n2024-01-19,D,2,3\n2024-01-19,D,2,3\nJan 5, 2024,E,1,1\n"
                   '"Jan 5, 2024",F,1,1\nnever,G,1,1\n', "sales")
    clean = {r.sku: str(r.date) for r in ingest.clean_rows(tagged, "sales").collect()}
    assert clean["A"] == "2024-01-15" and clean["D"] == "2024-01-19" and clean["F"] == "2024-01-05"
    assert clean["G"] == "None" and "B" not in clean and "C" not in clean
    rejects = sorted((r.sku or "-", r.quantity or "-", r.rule, r.rejected_count)
                     for r in ingest.rejected_rows(tagged).where("date like '2024%'").collect())
    assert rejects == [("-", "1", "null:sku", 1), ("B", "-", "null:quantity", 1), ("C", "abc", "null:quantity", 1),
                       ("C", "xyz", "null:quantity", 1), ("D", "2", "duplicate_rows", 1)]


def test_nan_in_a_typed_upload_is_missing(spark):
    df = spark.createDataFrame([("2024-01-01", "A", float("nan"), 1.0), ("2024-01-01", "B", 1.0, 1.0)],
                               "date string, sku string, quantity double, revenue double")
    assert {r._rule for r in ingest.tag_rows(df, "sales").collect()} == {"null:quantity", "valid"}


def test_folder_with_another_column_order_is_refused(spark, workdir):
    for name, text in (("a.csv", "sku,qty_on_hand,reorder_point\nA,1,2\n"), ("b.csv", "qty_on_hand,sku,reorder_point\n1,B,2\n")):
        with open(os.path.join(workdir, name), "w") as f:
            f.write(text)
    with pytest.raises(Exception, match="(?i)header"):
        read_upload(spark, workdir, "csv").agg(F.max("sku")).collect()


@pytest.mark.parametrize("text", [
    "SELECT java_method('java.lang.System', 'getProperty', 'user.home')", "SELECT reflect('a', 'b')",
    "SELECT * FROM text.`/etc/hostname`", "SELECT * FROM `csv`.`/etc/hostname`", "SELECT * FROM other_view"])
def test_guard_refuses_java_calls_and_files(spark, text):
    spark.range(1).createOrReplaceTempView("other_view")
    with pytest.raises(adhoc.ReadOnlyViolation):
        adhoc.run_sql(spark, {"t": spark.range(3)}, text)


def test_guard_keeps_the_callers_views(spark):
    spark.range(7).createOrReplaceTempView("t")
    out = adhoc.run_sql(spark, {"t": spark.range(3)}, "WITH x AS (SELECT id FROM t) SELECT count(*) AS n FROM x")
    assert out.first().n == 3 and spark.table("t").count() == 7


def test_two_streams_on_one_store(spark, workdir):
    from stockroom.streaming.uploads import start_upload_stream
    store = os.path.join(workdir, "store")
    for category, text in (("sales", "date,sku,quantity,revenue,customer_name,region,category\n2024-01-01,A,1,2,,,c\nx,,1,1,,,\n"),
                           ("inventory", "sku,qty_on_hand,reorder_point,location,unit_cost,supplier_id\nA,1,2,,,\nB,,2,,,\n")):
        up = os.path.join(workdir, category)
        os.makedirs(up)
        with open(os.path.join(up, "a.csv"), "w") as f:
            f.write(text)
        start_upload_stream(spark, up, category, store, os.path.join(workdir, f"ck-{category}"),
                            available_now=True).awaitTermination(120)
    led = spark.read.parquet(os.path.join(store, "stream", "file_uploads")).collect()
    assert sorted(r.file_category for r in led) == ["inventory", "sales"] and len({r.id for r in led}) == 2
    issues = spark.read.parquet(os.path.join(store, "stream", "data_quality_issues"))
    assert {r.upload_category for r in issues.collect()} == {"sales", "inventory"}
    assert spark.read.parquet(os.path.join(store, "stream", "sales_data")).first().category == "c"


def test_upload_ids_do_not_meet(spark, workdir):
    store, path = os.path.join(workdir, "s"), os.path.join(workdir, "a.csv")
    with open(path, "w") as f:
        f.write("sku,qty_on_hand,reorder_point\nA,1,2\n")
    done = ingest.process_upload(spark, path, "inventory", store, upload_id=7)
    assert done.status == "success"
    led = spark.read.parquet(os.path.join(store, "file_uploads")).first()
    assert led.file_size_bytes == os.path.getsize(path)
    assert "already" in ingest.process_upload(spark, path, "inventory", store, upload_id=7).message
    other = os.path.join(workdir, "b.csv")
    os.link(path, other)
    with pytest.raises(ValueError, match="belongs to"):
        ingest.process_upload(spark, other, "inventory", store, upload_id=7)
    assert 0 < ingest._new_id() < 1 << 63 and ingest._new_id() != ingest._new_id()


def test_ledger_archives_uploads_without_a_category(spark):
    from stockroom.operators import ledger
    rows = [(i, None, f"{i}.csv", "replace") for i in range(3)]
    df = spark.createDataFrame(rows, "id long, file_category string, filename string, upload_mode string").select(
        "*", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 90_000).alias("upload_timestamp"))
    got = {r.id: r.status for r in ledger.ledger_versions(df).collect()}
    assert got == {0: "archived", 1: "archived", 2: "active"}
