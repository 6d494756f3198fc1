import __spark_entry__ as se


def test_entry_runs(spark):
    df = se.entry(spark)
    rows = df.collect()
    assert df.columns[:3] == ["sku", "qty_on_hand", "reorder_point"]
    assert len(rows) > 0
    ranks = {"URGENT - OUT OF STOCK": 0, "URGENT - CRITICAL LOW": 1, "ORDER NOW": 2, "ORDER SOON": 3}
    keys = [(ranks[r["priority"]], r["qty_on_hand"], r["sku"]) for r in rows]
    assert keys == sorted(keys)


def test_every_query_has_sql_and_unique_keys():
    from stockroom.plans import catalog
    qs, sql = catalog.queries(), catalog.oracle_sql()
    assert len(qs) >= 50
    assert set(qs) == set(sql), "every registered query of the reports carries an SQL check"
    assert set(qs) <= set(se.queries()) and set(se.oracle_sql()) <= set(se.queries())


def test_scale_settings():
    from stockroom.session import bucket_count, scale_settings
    s = scale_settings(100 * 10**12)                      # 100 TB
    assert int(s["spark.sql.shuffle.partitions"]) == 186_265   # 512 MB each
    assert int(scale_settings(10**9)["spark.sql.shuffle.partitions"]) == 2
    assert bucket_count(100 * 10**12) > 90_000 and bucket_count(1) == 1


def test_command_line_runs_a_query(spark, workdir):
    import os

    from stockroom.__main__ import main
    out = os.path.join(workdir, "reorder")
    assert main(["run", "reorder_recommendations", "--raw", "/root/testdata/sf0.001",
                 "--out", out]) == 0
    assert spark.read.parquet(out).count() == se.entry(spark).count()
    assert main(["list"]) == 0
