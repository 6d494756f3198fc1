"""The upload ledger as table work.

The ledger is append-only; status and version are *derived*:

* an upload is archived iff the next upload of its category (by time, id) was
  a replace — a replace always archives the newest active upload, which is
  its immediate predecessor, and an append archives nothing;
* the version of an archived upload is the running count of archived uploads
  of its category, in time order.

Both are ordered scans over a category.  A category may hold a large share of
all uploads, so the scan is done in two levels instead of one window over the
category: rows are windowed within (category, time bucket); a per-bucket
summary — one row per bucket, so bounded by the time span, not the volume —
supplies the first mode of the next bucket and the count of archived uploads
in earlier buckets.  Latest-per-category is a ``max(struct)`` aggregate with a
partial phase (no window), and the newest-N history is a two-stage top-N.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stockroom.schemas import LEDGER

TS, CAT, ID, MODE = "upload_timestamp", "file_category", "id", "upload_mode"
REPORT_COLS = ("file_category", "filename", "upload_timestamp", "row_count",
               "quality_score", "status", "uploaded_by")
DETAIL_COLS = ("id", "filename", "upload_timestamp", "uploaded_by", "row_count", "quality_score")


def record_upload(spark: SparkSession, ledger_path: str, *, category: str, filename: str,
                  row_count: int, quality_score: float, upload_mode: str = "replace",
                  uploaded_by: str = "system", storage_path: str | None = None,
                  validation_errors: str = "[]", file_size_bytes: int | None = None,
                  upload_id: int | None = None, when: _dt.datetime | None = None) -> int:
    """Append one ledger row (status is derived, never stored).

    The id is supplied by the job (default: microseconds since the epoch of
    the upload time), so no driver-side counter or read-modify-write is needed.
    """
    when = when or _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None)
    uid = upload_id if upload_id is not None else int(
        (when - _dt.datetime(1970, 1, 1)).total_seconds() * 1_000_000)
    row = (uid, category, filename, when, upload_mode, uploaded_by, int(row_count),
           file_size_bytes, float(quality_score), validation_errors, storage_path)
    spark.createDataFrame([row], LEDGER).write.mode("append").parquet(ledger_path)
    return uid


def ledger_versions(ledger: DataFrame, bucket: str = "day") -> DataFrame:
    """U4: every upload with ``status``, ``version_number`` and ``replaced_at``.

    ``replaced_at`` of an archived upload is the time of the upload that
    replaced it (its successor in the category).

    ``bucket`` is the time unit of the first scan level (``date_trunc`` unit).
    One window pass per (category, bucket) gives the next mode, the running
    count of replaces and whether the bucket starts with a replace; the number
    of archived uploads up to row k of a bucket is then
    ``replaces(1..k) − first_is_replace + [next mode is replace]``.  The
    per-bucket summary (one row per bucket) carries whether the next bucket
    starts with a replace and the archived count of all earlier buckets.
    """
    order = [F.col(TS), F.col(ID)]
    is_rep = (F.col(MODE) == F.lit("replace")).cast("long")
    rows = ledger.withColumn("_b", F.date_trunc(bucket, F.col(TS)))
    in_bucket = Window.partitionBy(CAT, "_b").orderBy(*order)
    rows = rows.select(
        "*",
        F.lead(MODE).over(in_bucket).alias("_next_local"),
        F.lead(TS).over(in_bucket).alias("_next_local_ts"),
        F.sum(is_rep).over(in_bucket.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        .alias("_cum_rep"),
        F.first(is_rep).over(in_bucket.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        .alias("_first_rep"))

    # per-bucket summary straight from the ledger: partial aggregates, one small row
    # per bucket into the shuffle, no second sort of the uploads
    by_bucket = Window.partitionBy(CAT).orderBy("_b")
    summary = (ledger.withColumn("_b", F.date_trunc(bucket, F.col(TS))).groupBy(CAT, "_b")
               .agg(F.min_by(is_rep, F.struct(*order)).alias("_bucket_first_rep"),
                    F.sum(is_rep).alias("_n_rep"),
                    F.min(TS).alias("_bucket_first_ts"))
               .withColumn("_next_first_rep", F.lead("_bucket_first_rep").over(by_bucket))
               .withColumn("_next_first_ts", F.lead("_bucket_first_ts").over(by_bucket)))
    summary = (summary
               .withColumn("_arch", F.col("_n_rep") - F.col("_bucket_first_rep")
                           + F.coalesce(F.col("_next_first_rep"), F.lit(0)))
               .select(CAT, "_b", "_next_first_rep", "_next_first_ts",
                       F.coalesce(F.sum("_arch").over(
                           by_bucket.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
                       .alias("_offset")))

    archived = F.coalesce(F.col("_next_local") == F.lit("replace"),
                          F.col("_next_first_rep") == F.lit(1), F.lit(False))
    rank = (F.col("_offset") + F.col("_cum_rep") - F.col("_first_rep")
            + F.when(archived, 1).otherwise(0))
    summary = summary.withColumnsRenamed({CAT: "_cat", "_b": "_bucket"})
    same = F.col(CAT).eqNullSafe(F.col("_cat")) & F.col("_b").eqNullSafe(F.col("_bucket"))
    return (rows.join(summary, same, "left")
            .withColumn("status", F.when(archived, F.lit("archived")).otherwise(F.lit("active")))
            .withColumn("version_number", F.when(archived, rank.cast("int")))
            .withColumn("replaced_at", F.when(archived, F.coalesce(F.col("_next_local_ts"),
                                                                   F.col("_next_first_ts"))))
            .drop("_b", "_cat", "_bucket", "_next_local", "_next_local_ts", "_cum_rep", "_first_rep",
                  "_next_first_rep", "_next_first_ts", "_offset"))


def ledger_active(ledger: DataFrame) -> DataFrame:
    """The active upload of each category (the newest by time, then id)."""
    fields = [TS, ID, "filename", "uploaded_by", "row_count", "quality_score"]
    latest = ledger.groupBy(CAT).agg(F.max(F.struct(*fields)).alias("r"))
    return latest.select(CAT, *[F.col(f"r.{f}").alias(f) for f in DETAIL_COLS],
                         F.lit("active").alias("status"))


def ledger_status(ledger: DataFrame, categories: DataFrame) -> DataFrame:
    """One row per category in ``categories`` (column ``file_category``).

    Categories without uploads are ``missing`` with zero rows and score.
    """
    active = ledger_active(ledger)
    return (categories.select(CAT).distinct().join(active, CAT, "left")
            .select(CAT,
                    F.coalesce(F.col("status"), F.lit("missing")).alias("status"),
                    "filename", TS, "uploaded_by",
                    F.coalesce(F.col("row_count"), F.lit(0)).alias("row_count"),
                    F.coalesce(F.col("quality_score"), F.lit(0.0)).alias("quality_score"),
                    F.lit(False).alias("needs_refresh")))


def ledger_history(ledger: DataFrame, n: int = 10, bucket: str = "day",
                   salt_buckets: int = 64) -> DataFrame:
    """The newest ``n`` archived uploads per category, with version numbers.

    Two-stage top-n: first within (category, hash-salt) groups, then over the
    at most ``n × salt_buckets`` survivors of each category.
    """
    arch = ledger_versions(ledger, bucket).where(F.col("status") == "archived")
    newest = [F.col(TS).desc(), F.col(ID).desc()]
    salted = arch.withColumn("_s", F.pmod(F.xxhash64(ID), F.lit(salt_buckets)))
    stage1 = (salted.withColumn("_r", F.row_number().over(
        Window.partitionBy(CAT, "_s").orderBy(*newest))).where(F.col("_r") <= n))
    stage2 = (stage1.withColumn("_r", F.row_number().over(Window.partitionBy(CAT).orderBy(*newest)))
              .where(F.col("_r") <= n))
    return (stage2.select(CAT, *DETAIL_COLS, "status", "version_number", "replaced_at")
            .orderBy(CAT, *newest))


def ledger_file_history(ledger: DataFrame, n: int = 10, bucket: str = "day") -> DataFrame:
    """U5 whole: per category its current upload (``part`` current) and the newest ``n``
    archived ones (``part`` previous), with file sizes where the ledger has them."""
    size = F.col("file_size_bytes") if "file_size_bytes" in ledger.columns else F.lit(None).cast("long")
    sizes = ledger.select(F.col(ID).alias("_id"), size.alias("file_size_bytes"))
    cols = [CAT, *DETAIL_COLS, "status", "version_number", "replaced_at"]
    current = (ledger_active(ledger).withColumn("version_number", F.lit(None).cast("int"))
               .withColumn("replaced_at", F.lit(None).cast(ledger.schema[TS].dataType)).select(F.lit("current").alias("part"), *cols))
    previous = ledger_history(ledger, n, bucket).select(F.lit("previous").alias("part"), *cols)
    return (current.unionByName(previous).join(sizes, F.col(ID) == F.col("_id"), "left").drop("_id")
            .orderBy(CAT, "part", F.col(TS).desc(), F.col(ID).desc()))


def ledger_quality_report(ledger: DataFrame, bucket: str = "day") -> DataFrame:
    """Every upload, newest first, with derived status."""
    return (ledger_versions(ledger, bucket).select(*REPORT_COLS, ID)
            .orderBy(F.col(TS).desc(), F.col(ID).desc()).drop(ID))


def preview(df: DataFrame, n: int = 100, ordered: bool = False) -> DataFrame:
    """``n`` rows of a stored table; the read stops early.

    ``ordered`` gives the first ``n`` in a total order of all columns instead, which
    reads the whole table.
    """
    return (df.orderBy(*[F.col(c).asc_nulls_last() for c in df.columns]) if ordered else df).limit(n)



def row_counts(tables: dict[str, DataFrame | None], spark: SparkSession | None = None) -> DataFrame:
    """U8: ``(table_name, row_count)`` for each stored table; an absent table (None) counts 0."""
    from functools import reduce
    present = [df for df in tables.values() if df is not None]
    spark = spark or (present[0].sparkSession if present else SparkSession.getActiveSession())
    parts = []
    for name, df in tables.items():
        if df is None:
            parts.append(spark.range(1).select(F.lit(name).alias("table_name"),
                                               F.lit(0).cast("long").alias("row_count")))
        else:
            parts.append(df.agg(F.count(F.lit(1)).alias("row_count"))
                         .select(F.lit(name).alias("table_name"), "row_count"))
    return reduce(DataFrame.unionByName, parts)


def stored_table(spark: SparkSession, path: str) -> DataFrame | None:
    """A stored parquet table, or None when it has no files yet (or no folder)."""
    try:
        return spark.read.parquet(path)
    except Exception as e:  # noqa: BLE001 - Spark raises AnalysisException for these
        if any(m in str(e) for m in ("PATH_NOT_FOUND", "does not exist", "UNABLE_TO_INFER_SCHEMA")):
            return None
        raise


def describe(df: DataFrame) -> list[tuple[str, str]]:
    """Column names and types (schema metadata only)."""
    return [(f.name, f.dataType.simpleString()) for f in df.schema.fields]


def describe_tables(tables: dict[str, DataFrame]) -> DataFrame:
    """U9 as a table: table_name, position, column_name, data_type, and how many rows have
    no value in the column, counted in one pass per table."""
    from functools import reduce

    def one(name: str, df: DataFrame) -> DataFrame:
        nulls = df.agg(*[F.count_if(F.col(c).isNull()).alias(f"c{i}") for i, c in enumerate(df.columns)])
        rows = ", ".join(f"'{name}', {i}, '{c}', '{t}', c{i}" for i, (c, t) in enumerate(describe(df)))
        return nulls.selectExpr(f"stack({len(df.columns)}, {rows}) AS (table_name, position, column_name, data_type, null_rows)")
    return reduce(DataFrame.unionByName, [one(n, df) for n, df in tables.items()])
