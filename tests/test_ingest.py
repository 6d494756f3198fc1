"""Upload cleaning, scoring, the batch job and the schema check."""

import os

import pytest

from stockroom.operators import ingest, ledger
from stockroom.sources.derived import Tables
from stockroom.sources.files import allowed_file, read_upload
from tests.conftest import SF_MID

AS_OF = "2026-01-01"


def _csv(path, text):
    with open(path, "w") as f:
        f.write(text)
    return path


def test_extension_filter():
    assert allowed_file("a.CSV") and allowed_file("b.xlsx") and allowed_file("c.parquet")
    assert not allowed_file("d.txt") and not allowed_file("noext")


def test_schema_check_names_order_and_extras(spark, workdir):
    p = _csv(os.path.join(workdir, "s.csv"),
             " Revenue ,SKU,Date,Quantity,Customer Name,Extra Col\n"
             "10.5,A,2024-01-01,2,Ann,z\n")
    df = read_upload(spark, p)
    check = ingest.validate_schema(df, "sales")
    assert check.valid and check.extra == ("extra_col",) and check.missing == ()
    clean = ingest.clean_rows(ingest.tag_rows(df, "sales"), "sales").collect()
    assert len(clean) == 1
    r = clean[0]
    assert (r["sku"], r["quantity"], r["revenue"], r["customer_name"]) == ("A", 2.0, 10.5, "Ann")
    assert r["region"] is None and str(r["date"]) == "2024-01-01"


def test_missing_required_and_unknown_category(spark, workdir):
    df = read_upload(spark, _csv(os.path.join(workdir, "m.csv"), "date,sku\n2024-01-01,A\n"))
    check = ingest.validate_schema(df, "sales")
    assert not check.valid and check.missing == ("quantity", "revenue")
    unknown = ingest.validate_schema(df, "returns")
    assert not unknown.valid and "Unknown category" in unknown.error
    rep = ingest.quality_report(df, "returns").first()
    assert rep["schema_valid"] is False and rep["total_rows"] is None


def test_sequential_attribution_and_score(spark, workdir):
    p = _csv(os.path.join(workdir, "d.csv"),
             "date,sku,quantity,revenue\n"
             "2024-01-01,A,1,10\n"
             "2024-01-01,A,1,10\n"          # duplicate
             "2024-01-02,,-1,\n"            # null sku first (also negative, null revenue)
             "2024-01-03,B,-1,\n"           # null revenue before minimum
             "2024-01-04,C,-2,5\n"          # minimum
             "not-a-date,D,1,1\n"           # bad date: kept, no issue
             "2999-01-01,E,1,1\n")          # future: kept, unresolved warning
    tagged = ingest.tag_rows(read_upload(spark, p), "sales")
    issues = {(r["issue_type"], r["column_name"]): r for r in
              ingest.quality_issues(tagged, "sales", AS_OF).collect()}
    assert issues[("duplicate_rows", None)]["issue_count"] == 1
    assert issues[("null_required_field", "sku")]["issue_count"] == 1
    assert issues[("null_required_field", "revenue")]["issue_count"] == 1
    assert issues[("constraint_violation", "quantity")]["issue_count"] == 1
    fut = issues[("future_dates", "date")]
    assert fut["issue_count"] == 1 and fut["auto_resolved"] is False
    score = ingest.quality_score(tagged, "sales", AS_OF).first()
    assert (score["total_rows"], score["valid_rows"], score["unresolved_issues"]) == (7, 3, 1)
    assert score["quality_score"] == round(3 / 7 * 100 - 2, 2)
    clean = {r["sku"]: r for r in ingest.clean_rows(tagged, "sales").collect()}
    assert clean["D"]["date"] is None and str(clean["E"]["date"]) == "2999-01-01"
    rej = {r["rule"]: r["rejected_count"] for r in ingest.rejected_rows(tagged).collect()}
    assert rej == {"duplicate_rows": 1, "null:sku": 1, "null:revenue": 1, "min:quantity": 1}


def test_empty_upload_scores_zero(spark, workdir):
    p = _csv(os.path.join(workdir, "e.csv"), "date,sku,quantity,revenue\n")
    score = ingest.quality_score(ingest.tag_rows(read_upload(spark, p), "sales"), "sales").first()
    assert score["total_rows"] == 0 and score["quality_score"] == 0.0


def test_dirty_fixture_counts(spark):
    """FIXTURES §3: 60,586 in; 586 duplicates; 633 / 862 / 677 rejected; 57,828 valid."""
    tagged = ingest.tag_rows(Tables(spark, SF_MID).raw_sales, "sales")
    issues = {(r["issue_type"], r["column_name"]): r["issue_count"] for r in
              ingest.quality_issues(tagged, "sales", AS_OF).collect()}
    assert issues[("duplicate_rows", None)] == 586
    assert issues[("null_required_field", "sku")] == 633
    assert issues[("null_required_field", "revenue")] == 862
    assert issues[("constraint_violation", "quantity")] == 677
    assert 0 < issues[("future_dates", "date")] < 807
    score = ingest.quality_score(tagged, "sales", AS_OF).first()
    assert score["total_rows"] == 60586 and score["valid_rows"] == 57828


def test_process_upload_replace_append_and_ledger(spark, workdir):
    store = os.path.join(workdir, "store")
    a = _csv(os.path.join(workdir, "a.csv"), "date,sku,quantity,revenue\n2024-01-01,A,1,10\n"
                                             "2024-01-02,B,2,20\n")
    b = _csv(os.path.join(workdir, "b.csv"), "sku,date,revenue,quantity\nC,2024-01-03,30,3\n")
    r1 = ingest.process_upload(spark, a, "sales", store, "replace", "ann", upload_id=1, as_of=AS_OF)
    assert r1.status == "success" and r1.valid_rows == 2 and r1.quality_score == 100.0
    r2 = ingest.process_upload(spark, b, "sales", store, "append", "bob", upload_id=2, as_of=AS_OF)
    assert r2.status == "success"
    assert spark.read.parquet(os.path.join(store, "sales_data")).count() == 3
    r3 = ingest.process_upload(spark, a, "sales", store, "replace", "cy", upload_id=3, as_of=AS_OF)
    assert r3.status == "success"
    assert spark.read.parquet(os.path.join(store, "sales_data")).count() == 2
    bad = _csv(os.path.join(workdir, "bad.csv"), "sku\nA\n")
    r4 = ingest.process_upload(spark, bad, "sales", store, "replace", "dan", upload_id=4)
    assert r4.status == "error" and os.path.exists(os.path.join(store, "rejected", "bad.csv"))

    again = ingest.process_upload(spark, b, "sales", store, "append", "bob", upload_id=2)
    assert "already recorded" in again.message                 # retried upload: no-op
    led = spark.read.parquet(os.path.join(store, "file_uploads"))
    assert led.count() == 3
    v = {r["id"]: r for r in ledger.ledger_versions(led).collect()}
    # upload 2 was an append (1 stays active); upload 3 replaced 2 → 2 archived as version 1
    assert v[1]["status"] == "active" and v[2]["status"] == "archived"
    assert v[2]["version_number"] == 1 and v[3]["status"] == "active"
    issues = ledger.stored_table(spark, os.path.join(store, "data_quality_issues"))
    assert issues is None or issues.count() == 0   # clean uploads raise no issues


@pytest.mark.parametrize("bucket", ["hour", "day", "month"])
def test_ledger_two_level_scan_equals_plain_window(spark, bucket):
    """The bucketed scan gives the same status/version as one window per category."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F
    led = Tables(spark, SF_MID).ledger
    w = Window.partitionBy("file_category").orderBy("upload_timestamp", "id")
    arch = F.coalesce(F.lead("upload_mode").over(w) == "replace", F.lit(False))
    plain = (led.withColumn("a", arch)
             .withColumn("v", F.when(F.col("a"), F.sum(F.col("a").cast("int")).over(
                 w.rowsBetween(Window.unboundedPreceding, 0))))
             .withColumn("r", F.when(F.col("a"), F.lead("upload_timestamp").over(w)))
             .select("id", "a", "v", "r"))
    got = (ledger.ledger_versions(led, bucket)
           .select("id", (F.col("status") == "archived").alias("a"), F.col("version_number").alias("v"),
                   F.col("replaced_at").alias("r")))
    assert got.exceptAll(plain).count() == 0 and plain.exceptAll(got).count() == 0


def test_ledger_fixture_counts(spark):
    """FIXTURES §4: archived / all per category."""
    from pyspark.sql import functions as F
    v = ledger.ledger_versions(Tables(spark, SF_MID).ledger)
    got = {r["file_category"]: (r["a"], r["n"]) for r in v.groupBy("file_category").agg(
        F.count_if(F.col("status") == "archived").alias("a"), F.count("*").alias("n")).collect()}
    assert got == {"click": (1480, 2006), "error": (1501, 2014), "purchase": (1501, 1981),
                   "signup": (1536, 2017), "view": (1478, 1982)}
    mx = {r["file_category"]: r["m"] for r in v.groupBy("file_category").agg(
        F.max("version_number").alias("m")).collect()}
    assert mx["click"] == 1480


def test_process_directory_one_job_per_batch(spark, workdir):
    up = os.path.join(workdir, "batch")
    os.makedirs(up)
    _csv(os.path.join(up, "a.csv"), "date,sku,quantity,revenue\n2024-01-01,A,1,10\n"
                                    "2024-01-01,A,1,10\n2999-01-01,B,1,5\n")
    _csv(os.path.join(up, "b.csv"), "date,sku,quantity,revenue\n2024-01-01,A,1,10\n,C,-1,3\n")
    _csv(os.path.join(up, "notes.txt"), "not an upload\n")
    store = os.path.join(workdir, "store")
    res = {r.filename: r for r in ingest.process_directory(spark, up, "sales", store,
                                                           as_of=AS_OF)}
    assert set(res) == {"a.csv", "b.csv"}
    assert (res["a.csv"].total_rows, res["a.csv"].valid_rows) == (3, 2)   # duplicate within a.csv
    assert res["a.csv"].quality_score == round(2 / 3 * 100 - 2, 2)        # future date unresolved
    assert (res["b.csv"].total_rows, res["b.csv"].valid_rows) == (2, 1)   # same row in b is kept
    assert spark.read.parquet(os.path.join(store, "sales_data")).count() == 3
    led = ledger.ledger_versions(spark.read.parquet(os.path.join(store, "file_uploads"))).collect()
    assert sorted(r["upload_mode"] for r in led) == ["append", "replace"]
    assert all(r["status"] == "active" for r in led)
    issues = spark.read.parquet(os.path.join(store, "data_quality_issues"))
    assert issues.where("issue_type = 'future_dates'").count() == 1


def test_validate_bundle(spark, workdir):
    p = _csv(os.path.join(workdir, "v.csv"), "Date,SKU,Quantity,Revenue\n2024-01-01,A,1,10\n"
                                             "2024-01-01,A,1,10\n2024-01-02,,1,1\n")
    v = ingest.validate(read_upload(spark, p), "sales", as_of=AS_OF)
    assert v.schema.valid
    rep = v.report.first()
    assert (rep["total_rows"], rep["valid_rows"], rep["rejected_rows"]) == (3, 1, 2)
    assert v.clean.count() == 1 and v.preview.count() == 3
    assert {r["rule"] for r in v.rejected.collect()} == {"duplicate_rows", "null:sku"}


def test_row_counts_absent_table_is_zero(spark, workdir):
    present = ledger.stored_table(spark, os.path.join(workdir, "nothing-here"))
    assert present is None
    got = {r["table_name"]: r["row_count"] for r in ledger.row_counts(
        {"sales_data": spark.range(3), "inventory_data": present}, spark).collect()}
    assert got == {"sales_data": 3, "inventory_data": 0}


def test_keyed_writes_are_idempotent(spark, workdir):
    from stockroom.sources.files import write_keyed
    path = os.path.join(workdir, "keyed")
    one = spark.createDataFrame([("a", "1"), ("b", "1")], "v string, upload_key string")
    two = spark.createDataFrame([("c", "2")], "v string, upload_key string")
    write_keyed(one, path, "upload_key", "append")
    write_keyed(two, path, "upload_key", "append")
    write_keyed(one, path, "upload_key", "append")            # a retried upload 1
    assert spark.read.parquet(path).count() == 3
    write_keyed(two, path, "upload_key", "replace")
    assert [r["v"] for r in spark.read.parquet(path).collect()] == ["c"]


def test_directory_batch_retry_is_a_no_op(spark, workdir):
    up = os.path.join(workdir, "batch2")
    os.makedirs(up)
    _csv(os.path.join(up, "a.csv"), "date,sku,quantity,revenue\n2024-01-01,A,1,10\n")
    _csv(os.path.join(up, "b.csv"), "date,sku,quantity,revenue\n2024-01-02,B,2,20\n")
    store = os.path.join(workdir, "store2")
    first = ingest.process_directory(spark, up, "sales", store, "append", batch_id=500)
    assert [r.filename for r in first] == ["a.csv", "b.csv"]
    again = ingest.process_directory(spark, up, "sales", store, "append", batch_id=500)
    assert "already recorded" in again[0].message
    data = spark.read.parquet(os.path.join(store, "sales_data"))
    assert data.count() == 2
    assert sorted(int(r["upload_key"]) for r in data.select("upload_key").collect()) == [500, 501]
    led = spark.read.parquet(os.path.join(store, "file_uploads"))
    assert sorted(r["id"] for r in led.collect()) == [500, 501]


def test_process_directory_parquet(spark, workdir):
    up = os.path.join(workdir, "pq")
    spark.createDataFrame([("2024-01-01", "A", 1.0, 10.0), ("2024-01-01", "A", 1.0, 10.0),
                           ("2024-01-02", None, 1.0, 1.0)],
                          "date string, sku string, quantity double, revenue double") \
        .coalesce(1).write.parquet(up)
    res = ingest.process_directory(spark, up, "sales", os.path.join(workdir, "s"),
                                   pattern="*.parquet", batch_id=1)
    assert len(res) == 1 and (res[0].total_rows, res[0].valid_rows) == (3, 1)


def test_describe_schema_frame_and_sinks(spark, workdir):
    from stockroom.sources.files import write_table
    t = Tables(spark, "/root/testdata/sf0.001")
    cols = dict(ledger.describe(t.inventory))
    assert cols == {"sku": "string", "qty_on_hand": "int", "reorder_point": "int",
                    "location": "string", "unit_cost": "double", "supplier_id": "string"}
    df = spark.createDataFrame([("2024-01-01", "A")], "date string, sku string")
    frame = ingest.validate_schema(df, "sales").as_frame(spark).first()
    assert frame["schema_valid"] is False and frame["missing_columns"] == "quantity,revenue"
    path = os.path.join(workdir, "sink")
    write_table(df, path, "replace")
    write_table(df, path, "append")
    assert spark.read.parquet(path).count() == 2
    write_table(df, path, "replace")
    assert spark.read.parquet(path).count() == 1
    with pytest.raises(ValueError):
        write_table(df, path, "upsert")
