"""Property test: the two-level ledger scan equals one plain window per category.

Random ledgers with tied timestamps (broken by id), two categories, append and
replace modes, spread over several hour buckets.
"""

import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from stockroom.operators import ledger

T0 = dt.datetime(2024, 1, 1)
upload = st.tuples(st.sampled_from(["a", "b"]), st.integers(0, 300), st.sampled_from(["append", "replace"]))


@settings(max_examples=10, deadline=None, derandomize=True,
          suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(upload, min_size=1, max_size=40))
def test_two_level_scan_equals_plain_window(spark, rows):
    data = [(i, cat, T0 + dt.timedelta(minutes=m), mode) for i, (cat, m, mode) in enumerate(rows)]
    led = spark.createDataFrame(data, "id long, file_category string, upload_timestamp timestamp_ntz, "
                                      "upload_mode string")
    w = Window.partitionBy("file_category").orderBy("upload_timestamp", "id")
    arch = F.coalesce(F.lead("upload_mode").over(w) == "replace", F.lit(False))
    want = (led.withColumn("a", arch)
            .withColumn("v", F.when(F.col("a"), F.sum(F.col("a").cast("int")).over(
                w.rowsBetween(Window.unboundedPreceding, 0))))
            .withColumn("r", F.when(F.col("a"), F.lead("upload_timestamp").over(w)))
            .select("id", "a", "v", "r").collect())
    got = (ledger.ledger_versions(led, "hour")
           .select("id", (F.col("status") == "archived").alias("a"),
                   F.col("version_number").alias("v"), F.col("replaced_at").alias("r")).collect())
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
