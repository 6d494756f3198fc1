"""Helpers shared by the training-data operators.

Word rule used throughout: a word is a maximal run of characters that are
neither a space nor one of the five control spaces U+0009..U+000D.
"""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stockroom.session import scratch_path

SPACES = "[\\x20\\x09-\\x0D]+"

# One Arrow batch holds at most this many rows and about this many bytes, so a
# Python worker's memory depends on the longest text, not on the table.
BATCH_ROWS = 1000
BATCH_BYTES = 16 << 20


def words(text: Column) -> Column:
    """Array of the words of a text; null and empty texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def doc_hash(doc_id: Column) -> Column:
    """crc32 of the id written as text (null for a null id)."""
    return F.crc32(doc_id.cast("string").cast("binary"))


def put(df: DataFrame, **cols: Column) -> DataFrame:
    """Add columns; an input column of the same name (in any case) is replaced."""
    names = {c.lower() for c in cols}
    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() not in names]
    return df.select(*kept, *[v.alias(k) for k, v in cols.items()])


def put_struct(df: DataFrame, value: Column, fields: list[str]) -> DataFrame:
    """Like ``put`` for a struct-valued expression, evaluated once per row."""
    names = {c.lower() for c in fields}
    kept = [c for c in df.columns if c.lower() not in names]
    held = free_name(df, "value_of_row")
    return (df.select(*[F.col(f"`{c}`") for c in kept], value.alias(held))
            .select(*[F.col(f"`{c}`") for c in kept],
                    *[F.col(f"{held}.{f}").alias(f) for f in fields]))


def low_bound(have: int, want: int) -> int:
    """A 64-bit hash below which, of ``have`` distinct ones, surely ``want`` lie (or all,
    if there are fewer) and not many more."""
    rate = (1.5 * want + 100) / max(1, have)
    return (1 << 63) - 1 if rate >= 1 else int(rate * (1 << 64)) - (1 << 63)


def python_ready(spark: SparkSession) -> None:
    """Bound the Arrow batches and make this package importable on executors.

    The package is sent as a zip through Spark's own file server (``addPyFile``),
    once per application, so workers need no copy of the repository.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    sc = spark.sparkContext
    if _SENT.get("app") == sc.applicationId:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    fd, path = tempfile.mkstemp(prefix="stockroom-", suffix=".zip")
    with os.fdopen(fd, "wb") as out, zipfile.ZipFile(out, "w") as z:
        for folder, _, files in os.walk(package):
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(package)))
    sc.addPyFile(path)
    _SENT["app"] = sc.applicationId


_SENT: dict[str, str] = {}


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` bears it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


# Logical nodes through which a row of a file stays one row.
_ROW_WISE = {"LogicalRelation", "Project", "Filter", "SubqueryAlias"}


def is_scan(df: DataFrame) -> bool:
    """Whether every row of ``df`` is one stored row of a file: its plan only reads,
    filters and projects.  After an explode, union or join a place names several rows."""
    node = df._jdf.queryExecution().analyzed()
    while node.nodeName() in _ROW_WISE:
        if node.children().size() == 0:
            return True
        node = node.children().head()
    return False


def settled(df: DataFrame, name: str) -> DataFrame:
    """``df`` itself if it is a scan whose rows have a place, else written and read back."""
    if is_scan(df):
        try:
            df.select("_metadata.row_index")
            return df
        except AnalysisException:
            pass
    return cut(df, name)


def placed(stored: DataFrame, name: str) -> DataFrame:
    """A settled table with column ``name``: the file and place each row is stored at."""
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("place"))
    return stored.withColumn(name, place)


def stored_rows(df: DataFrame, name: str, column: str = "_row") -> DataFrame:
    """``df`` with the file and place a row is stored at.

    Unlike a running id it does not depend on how a scan is split, so two reads of the
    table agree even if executors come or go between them.  Rows that are not read
    one by one from files are written first.
    """
    return placed(settled(df, name), column)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write to the cluster's shared folder and read back: later steps read the
    table, so neither recomputation nor a lost executor repeats the work above."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
