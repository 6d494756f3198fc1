"""Uploads of any header: the batch job, refused files, date layouts, retries."""

import datetime
import os

import pytest
from pyspark.sql import functions as F

from stockroom import session
from stockroom.operators import batch, ingest, ledger

AS_OF = "2026-01-01"


def _files(folder, **texts):
    os.makedirs(folder, exist_ok=True)
    for name, text in texts.items():
        with open(os.path.join(folder, name.replace("_csv", ".csv").replace("_CSV", ".CSV")), "w", newline="") as f:
            f.write(text)
    return folder


MIXED = {
    "a_csv": "date,sku,quantity,revenue\n2024-01-01,A,1,10\n2024-01-01,A,1,10\n",
    "b_csv": "revenue, SKU ,Date,Quantity,Note,note 2\n5,B,2024-01-02,2,x,y\n,B2,2024-01-02,2,x,\n",
    "c_CSV": "﻿sku,date,revenue,quantity,region\n\"C,\"\"1\"\"\",2024-01-03,7,3,EU\n\"two\nlines\",2024-01-03,7,3,EU\n",
    "d_csv": "sku,quantity\nD,1\n",                                   # lacks required columns
    "e_csv": "",                                                      # no bytes
    "f_csv": "date,sku,quantity,revenue\n",                           # no rows
    "g_csv": "Date,date,sku,quantity,revenue\n1,2,3,4,5\n",           # a name twice
    "h_csv": "date,sku,quantity,revenue,_n,_rule,upload_key\n2024-01-04,H,1,1,9,9,9\n2024-01-04,H,1,1,8,9,9\n",
    "i_csv": "date,sku,quantity,revenue\n2024-01-05,I\n2024-01-05,I2,1,1,surplus\n",
    "notes.txt": "not an upload\n",
}


def test_mixed_files_in_one_batch(spark, workdir):
    up, store = _files(os.path.join(workdir, "in"), **MIXED), os.path.join(workdir, "store")
    res = list(batch.process_batch(spark, up, "sales", store, "replace", "ann", AS_OF, batch_id=1000))
    assert [r.filename for r in res] == ["a.csv", "b.csv", "c.CSV", "d.csv", "e.csv", "f.csv", "g.csv", "h.csv", "i.csv"]
    got = {r.filename: (r.status, r.total_rows, r.valid_rows, r.quality_score) for r in res}
    assert got == {
        "a.csv": ("success", 2, 1, 50.0), "b.csv": ("success", 2, 1, 50.0), "c.CSV": ("success", 2, 2, 100.0),
        "d.csv": ("error", 0, 0, 0.0), "e.csv": ("error", 0, 0, 0.0), "f.csv": ("success", 0, 0, 0.0),
        "g.csv": ("error", 0, 0, 0.0), "h.csv": ("success", 2, 2, 100.0), "i.csv": ("success", 2, 1, 50.0)}
    data = {r.sku: r for r in spark.read.parquet(f"{store}/sales_data").collect()}
    assert set(data) == {"A", "B", 'C,"1"', "two\nlines", "H", "I2"}
    assert (data["B"].revenue, data["B"].quantity, str(data["B"].date)) == (5.0, 2.0, "2024-01-02")
    assert data['C,"1"'].region == "EU" and data["A"].region is None and str(data["H"].upload_key) == "1007"

    led = {r.filename: r for r in spark.read.parquet(f"{store}/file_uploads").collect()}
    assert {n: r.file_size_bytes for n, r in led.items()} == {
        n: os.path.getsize(os.path.join(up, n)) for n in ("a.csv", "b.csv", "c.CSV", "f.csv", "h.csv", "i.csv")}
    assert [r.upload_mode for r in sorted(led.values(), key=lambda r: r.upload_timestamp)] == ["replace"] + ["append"] * 5
    assert sorted(r.id for r in led.values()) == [1000, 1001, 1002, 1005, 1007, 1008] and led["f.csv"].row_count == 0

    why = {r.filename: r.message for r in spark.read.parquet(f"{store}/rejected_uploads").collect()}
    assert why == {"d.csv": "required columns not found: date, revenue", "e.csv": "the file has no header line",
                   "g.csv": "columns named twice: date"}
    kept = spark.read.parquet(f"{store}/rejected_files").where("name = 'd.csv'").orderBy("pos").collect()
    assert [[x for x in r.fields if x is not None] for r in kept] == [["sku", "quantity"], ["D", "1"]]
    extra = spark.read.parquet(f"{store}/rejected_rows/sales").where("upload_key = 1001").first()
    assert [(e.name, e.value) for e in extra.extra_columns] == [("note", "x"), ("note_2", None)]
    assert extra.rule == "null:revenue" and extra.rejected_count == 1


def test_retries_of_a_batch(spark, workdir, monkeypatch):
    """A batch that stops before its last steps is completed by the next attempt, never doubled."""
    up, store = _files(os.path.join(workdir, "in"), **MIXED), os.path.join(workdir, "store")
    run = lambda category="sales": batch.process_batch(spark, up, category, store, "append", batch_id=4000, as_of=AS_OF)
    rows = lambda name: spark.read.parquet(f"{store}/{name}").count()
    names = ("sales_data", "file_uploads", "data_quality_issues", "rejected_files", "rejected_uploads")

    def lost(*_):
        raise OSError("lost")
    with monkeypatch.context() as m:
        m.setattr(batch, "_results", lost)
        with pytest.raises(OSError, match="lost"):
            run()
    counts = {n: rows(n) for n in names}
    _files(up, z_csv="date,sku,quantity,revenue\n2024-01-01,Z,1,1\n")               # comes too late for this batch
    assert len(run()) == 9 and {n: rows(n) for n in names} == counts
    done = run()
    assert "already recorded" in done[0].message
    with pytest.raises(IndexError):
        done[9]
    with pytest.raises(ValueError, match="another category"):
        run("supplier")


def test_batch_of_refused_files_replaces_nothing(spark, workdir):
    store = os.path.join(workdir, "store")
    batch.process_batch(spark, _files(os.path.join(workdir, "x"), a_csv=MIXED["a_csv"]), "sales", store, as_of=AS_OF)
    res = batch.process_batch(spark, _files(os.path.join(workdir, "y"), d_csv=MIXED["d_csv"], e_csv=""), "sales", store)
    assert [r.status for r in res] == ["error", "error"]
    assert spark.read.parquet(f"{store}/sales_data").count() == 1
    assert spark.read.parquet(f"{store}/file_uploads").count() == 1


def test_a_thousand_files(spark, workdir):
    up, store = os.path.join(workdir, "in"), os.path.join(workdir, "store")
    texts = {f"f{i:04}_csv": "sku,date,quantity,revenue\n" + (f"S{i},2024-01-01,1,{i}\n" if i % 3 else "")
             for i in range(1000)}
    res = batch.process_batch(spark, _files(up, **texts), "sales", store, as_of=AS_OF, multi_line=False)
    assert res.frame.where("status = 'success'").count() == 1000
    led = spark.read.parquet(f"{store}/file_uploads").agg(
        F.count("*").alias("n"), F.count_distinct("id").alias("ids"), F.sum("row_count").alias("rows"),
        F.count_if(F.col("file_size_bytes").isNull()).alias("unsized"), F.count_distinct("upload_timestamp").alias("times")).first()
    assert led.asDict() == {"n": 1000, "ids": 1000, "rows": 666, "unsized": 0, "times": 1000}
    assert spark.read.parquet(f"{store}/sales_data").count() == 666


def test_odd_file_names(spark, workdir):
    up = os.path.join(workdir, "in dir")
    os.makedirs(up)
    names = ["a b.csv", "c+d.csv", "e%20f.csv", "é.csv", "g#h.csv", "zero +%.csv"]
    for i, n in enumerate(names):
        with open(os.path.join(up, n), "w") as f:
            f.write(f"date,sku,quantity,revenue\n2024-01-01,S{i},1,1\n" if i < 5 else "")
    res = {r.filename: (r.status, r.valid_rows) for r in batch.process_batch(spark, up, "sales", os.path.join(workdir, "s"))}
    assert res == {n: ("success", 1) for n in names[:5]} | {names[5]: ("error", 0)}


LAYOUTS = [
    (["03/04/2024", "15/01/2024", "not a date"], ["2024-04-03", "2024-01-15", None]),
    (["03/04/2024", "01/15/2024"], ["2024-03-04", "2024-01-15"]),
    (["03-04-2024", "15-1-2024"], ["2024-04-03", "2024-01-15"]),
    (["03.04.2024", "05.06.2024"], ["2024-03-04", "2024-05-06"]),         # both readings fit: month first
    (["15/01/2024", "01/16/2024", "02/03/2024"], ["2024-01-15", "2024-01-16", "2024-02-03"]),   # no one layout
    (["2024-02-03", "20240204", "5-Feb-2024", "31/12/2023"], ["2024-02-03", "2024-02-04", "2024-02-05", "2023-12-31"]),
]


def test_date_layout_of_a_column(spark, workdir):
    """Every file of a batch has a layout of its own."""
    texts = {f"f{n}_csv": "date,sku,quantity,revenue\n" + "".join(f"{d},F{n}S{i},1,1\n" for i, d in enumerate(dates))
             for n, (dates, _) in enumerate(LAYOUTS)}
    store = os.path.join(workdir, "store")
    batch.process_batch(spark, _files(os.path.join(workdir, "in"), **texts), "sales", store, as_of=AS_OF)
    got = {r.sku: r.date and str(r.date) for r in spark.read.parquet(f"{store}/sales_data").collect()}
    assert got == {f"F{n}S{i}": w for n, (_, want) in enumerate(LAYOUTS) for i, w in enumerate(want)}
    bad = spark.read.parquet(f"{store}/data_quality_issues").where("issue_type = 'unparsed_dates'").collect()
    assert [(r.upload_file, r.column_name, r.issue_count, r.auto_resolved) for r in bad] == [("f0.csv", "date", 1, True)]


def test_dates_of_orders(spark, workdir):
    text = "po_number,sku,quantity,order_date,delivery_date\nP1,A,1,13/02/2024,02/13/2024\nP2,A,1,01/02/2024,01/02/2024\n"
    store = os.path.join(workdir, "store")
    batch.process_batch(spark, _files(os.path.join(workdir, "in"), a_csv=text), "purchase_order", store)
    got = {r.po_number: (r.order_date, r.delivery_date) for r in spark.read.parquet(f"{store}/purchase_order_data").collect()}
    day = datetime.date
    assert got == {"P1": (day(2024, 2, 13), day(2024, 2, 13)), "P2": (day(2024, 2, 1), day(2024, 1, 2))}


@pytest.mark.parametrize("name", ["e_csv", "g_csv", "d_csv"])
def test_single_uploads_are_refused_not_crashed(spark, workdir, name):
    folder, store = _files(workdir, **{name: MIXED[name]}), os.path.join(workdir, "store")
    path = os.path.join(folder, name.replace("_csv", ".csv"))
    for category in ("sales", "inventory"):
        res = ingest.process_upload(spark, path, category, store, upload_id=7)
        assert res.status == "error" and res.message
    sink = os.path.join(store, "rejected", os.path.basename(path))
    assert sorted(os.listdir(sink)) == ["file_category=inventory", "file_category=sales"]     # none overwrites another
    assert ledger.stored_table(spark, f"{store}/file_uploads") is None


def test_single_upload_of_parts_in_different_orders(spark, workdir):
    up = _files(os.path.join(workdir, "sales.csv"), a_csv="sku,date,quantity,revenue,x\nA,15/01/2024,1,2,p\n",
                b_csv="revenue,x,quantity,sku,date\n2,p,1,A,15/01/2024\n2,q,1,A,15/01/2024\n")
    store = os.path.join(workdir, "store")
    res = ingest.process_upload(spark, up, "sales", store, as_of=AS_OF)
    assert (res.total_rows, res.valid_rows) == (3, 2)           # equal by name, though ordered otherwise
    assert {str(r.date) for r in spark.read.parquet(f"{store}/sales_data").collect()} == {"2024-01-15"}
    unknown = ingest.process_upload(spark, up, "returns", store)
    assert unknown.status == "error" and "returns" in unknown.message


def test_reserved_and_doubled_names_of_a_frame(spark):
    df = spark.createDataFrame([("2024-01-01", "A", 1.0, 1.0, 1)], "date string, sku string, quantity double, revenue double, _n int")
    check = ingest.validate_schema(df, "sales")
    assert not check.valid and "_n" in check.error
    assert ingest.quality_report(df, "sales").first()["total_rows"] is None
    assert "twice" in ingest.validate_schema(df.select("date", F.lit(1).alias("Date"), "sku", "quantity", "revenue"), "sales").error


def test_records_of_split_files(spark, workdir):
    """Quoted line breaks, also long ones over several blocks: the same records as from one task."""
    up = os.path.join(workdir, "in")
    long = "\n".join(f"line {i} with \"\"quotes\"\", commas" for i in range(60))
    body = "".join([f'S{i},2024-01-0{i % 9 + 1},{i},"{"a" * (i % 40)}"\n' if i % 7 else f'"S{i}\nsecond, part",2024-01-01,{i},\n\n'
                    for i in range(200)])
    _files(up, a_csv=f'sku,date,quantity,"rev\nenue"\n{body}"{long}",x,1,2\nlast,"",3,4', b_csv='sku,date\r\n"p\r\nq",1\r\n', c_csv="",
           d_csv="sku\n" + "\n".join(f"only{i}" for i in range(300)) + "\n")
    conf = {"spark.sql.files.maxPartitionBytes": "300", "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        assert spark.read.text(up).rdd.getNumPartitions() > 20
        got = batch.split_csv_fields(spark, up, os.path.join(workdir, "lines")).collect()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    want = batch.csv_fields(spark, up).collect()
    assert sorted((r.file, tuple(map(str, r.fields))) for r in got) == sorted((r.file, tuple(map(str, r.fields))) for r in want)
    firsts = {r.file: min((x for x in got if x.file == r.file), key=lambda x: (x.block, x.pos)).fields for r in got}
    assert {f.rsplit("/", 1)[1]: v for f, v in firsts.items()}["a.csv"][:4] == ["sku", "date", "quantity", "rev\nenue"]
    assert len({r.block for r in got}) > 20


@pytest.mark.parametrize("multi_line", [False, "split"])
def test_uploads_read_by_many_tasks(spark, workdir, multi_line):
    up = _files(os.path.join(workdir, "in"), a_csv=MIXED["a_csv"], f_csv=MIXED["f_csv"], c_csv=MIXED["c_CSV"])
    store = os.path.join(workdir, "s")
    res = {r.filename: r.total_rows for r in batch.process_batch(spark, up, "sales", store, multi_line=multi_line)}
    assert res["a.csv"] == 2 and res["f.csv"] == 0 and (multi_line != "split" or res["c.csv"] == 2)


_LINES = {
    "plain": ("date,sku,quantity,revenue\n2024-01-02,A,1,2\n\n2024-01-03,,,\n2024-01-04,B,1,2,3", True),
    "quoted": ('"date",sku\n"a,""b""",""\n"","x\ty"\n', True),
    "returns": ("date,sku\r\na,b\r\n\r\nc,\"d\"\r\n", True),
    "break": ('date,sku\na,"b\nc"\nd,e\n', False),
    "inside": ('date,sku\n5" x,"b\nc"\nd,e\n', False),        # quotes even in number, but a field goes on
    "literal": ('date,sku\n5" x,b\n"a"b,c\n', False),
    "blank": ("date,sku\n   \na,b\n", False),
    "mixed": ("date,sku\r\na,b\nc,d\r\n", False),
    "return": ("date,sku\na\rb,c\n", False),
}


@pytest.mark.parametrize("name", _LINES)
def test_lines_that_are_records_are_found(spark, workdir, name):
    text, whole = _LINES[name]
    up = _files(os.path.join(workdir, "in"), a_csv=text)
    assert batch.csv_lines(spark, up, None, False)[1] is whole
    want = [r.fields for r in batch.csv_fields(spark, up).orderBy("pos").collect()]
    got = batch.stage_records(spark, up, "a.csv", os.path.join(workdir, "records"))
    assert [r.fields for r in got.orderBy("pos").collect()] == want


def test_one_file_with_a_line_break_keeps_all_files_whole(spark, workdir):
    up = _files(os.path.join(workdir, "in"), a_csv=_LINES["plain"][0], b_csv=_LINES["break"][0])
    assert batch.csv_lines(spark, up, "*.csv", False) == (4, False)
    long = _files(os.path.join(workdir, "long"), a_csv="d" + ",x" * 400 + "\n")
    assert batch.csv_lines(spark, long, None, False) == (batch.MAX_COLUMNS + 1, True)


def test_a_large_file_is_read_by_many_tasks(spark, workdir):
    rows = "".join(f"2024-01-{i % 28 + 1:02},S{i},{i},1\n" for i in range(3000))
    up, store = _files(os.path.join(workdir, "in"), a_csv="date,sku,quantity,revenue\n" + rows), os.path.join(workdir, "store")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        res = list(batch.process_batch(spark, up, "sales", store, as_of=AS_OF, batch_id=64))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [(r.status, r.total_rows, r.valid_rows) for r in res] == [("success", 3000, 3000)]
    assert spark.read.parquet(f"{store}/batches/64/records").select("block").distinct().count() > 3


def test_dates_are_read_once(spark, workdir):
    up = _files(os.path.join(workdir, "in"), a_csv="date,sku,quantity,revenue\n13/01/2024,A,1,1\n02/01/2024,B,1,1\nnever,C,1,1\n5,D,1,1\n")
    store = os.path.join(workdir, "store")
    batch.process_batch(spark, up, "sales", store, as_of=AS_OF, batch_id=64)
    tagged = spark.read.parquet(f"{store}/batches/64/tagged")
    assert dict(tagged.dtypes)["date"] == "date"                     # no later pass parses them
    assert {r.sku: (str(r.date), r["_unparsed_date"], r["_raw"].date) for r in tagged.collect()} == {
        "A": ("2024-01-13", False, "13/01/2024"), "B": ("2024-01-02", False, "02/01/2024"),
        "C": ("None", True, "never"), "D": ("None", True, "5")}


def test_jobs_read_large_files_in_small_tasks(spark, workdir, monkeypatch):
    """The jobs set the size of their tasks, and leave the session's as it was."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes")
    before = [spark.conf.get(n) for n in names]
    with session.small_tasks(spark):
        assert [spark.conf.get(n) for n in names] == [str(16 << 20)] * 2
    assert [spark.conf.get(n) for n in names] == before
    monkeypatch.setattr(session, "TASK_BYTES", 16 << 10)
    rows = "".join(f"2024-01-{i % 28 + 1:02},S{i},{i},1\n" for i in range(3000))
    up, store = _files(os.path.join(workdir, "in"), a_csv="date,sku,quantity,revenue\n" + rows), os.path.join(workdir, "store")
    res = list(batch.process_batch(spark, up, "sales", store, as_of=AS_OF, batch_id=64))
    assert [(r.status, r.total_rows, r.valid_rows) for r in res] == [("success", 3000, 3000)]
    assert spark.read.parquet(f"{store}/batches/64/records").select("block").distinct().count() > 3
    one = os.path.join(workdir, "one")
    assert ingest.process_upload(spark, f"{up}/a.csv", "sales", one, as_of=AS_OF).valid_rows == 3000
    assert spark.read.parquet(f"{one}/staging/*/records").select("block").distinct().count() > 3
    with pytest.raises(ValueError):
        batch.process_batch(spark, up, "sales", store, as_of=AS_OF, batch_id=65, pattern="*.txt")
    assert [spark.conf.get(n) for n in names] == before


def test_counters_come_from_one_count_per_rule(spark):
    rows = [("2024-01-01", "A", "1", "1")] * 3 + [("2999-01-01", "B", "1", "1"), ("never", "C", "1", "1"), (None, "D", "1", "1"),
            ("2024-01-01", "E", "-1", "1"), ("2024-01-01", "E", "-1", "1"), ("2024-01-01", None, "1", "1")]
    tagged = ingest.tag_rows(spark.createDataFrame(rows, "date string, sku string, quantity string, revenue string"), "sales")
    counts = ingest.quality_counts(tagged, "sales", AS_OF)
    assert "keys=[_rule" in counts._jdf.queryExecution().executedPlan().toString()
    assert {(r.issue_type, r.column_name, r.issue_count) for r in ingest.quality_issues(tagged, "sales", AS_OF).collect()} == {
        ("duplicate_rows", None, 3), ("null_required_field", "date", 1), ("null_required_field", "sku", 1),
        ("constraint_violation", "quantity", 1), ("future_dates", "date", 1)}
    assert counts.select("total_rows", "valid_rows").first()[:] == (9, 3)
    assert ingest.quality_counts(tagged.limit(0), "sales", AS_OF).select("total_rows", "valid_rows", "k0").first()[:] == (0, 0, 0)
    assert {(r.sku, r.rule, r.rejected_count) for r in ingest.rejected_rows(tagged).collect()} == {
        ("A", "duplicate_rows", 2), ("D", "null:date", 1), ("E", "duplicate_rows", 1), ("E", "min:quantity", 1), (None, "null:sku", 1)}
