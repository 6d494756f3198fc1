"""Upload files in, stored tables out.

Uploads are read with an all-string schema (never ``inferSchema`` on the hot
path) and typed afterwards by name; see ``operators.ingest.conform``.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stockroom.schemas import ALLOWED_EXTENSIONS

# Words that stand for a missing value in CSV uploads.
MISSING = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
           "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def allowed_file(filename: str) -> bool:
    """Extension check, case-insensitive (``.csv``, ``.xlsx``, ``.parquet``)."""
    return os.path.splitext(filename)[1].lower() in ALLOWED_EXTENSIONS


def has_allowed_name(name: Column) -> Column:
    """I2 as an expression, for tables of file names."""
    extension = F.lower(F.regexp_extract(name, r"[^./\\][^/\\]*([.][^./\\]*)$", 1))
    return F.coalesce(extension.isin(*ALLOWED_EXTENSIONS), F.lit(False))


def csv_header(spark: SparkSession, path: str) -> list[str]:
    """Column names of a CSV upload, read from its header line only."""
    return csv_reader(spark).csv(path).columns


def text_schema(names: list[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def csv_reader(spark: SparkSession, multi_line: bool = True):
    """Reader of CSV uploads: a header row, and quotes doubled inside quoted fields.

    ``multi_line`` lets quoted fields hold line breaks; a file is then read by one
    task.  Uploads are small files; turn it off for huge ones without such breaks.
    """
    return (spark.read.option("header", True).option("quote", '"').option("escape", '"')
            .option("multiLine", multi_line).option("mode", "PERMISSIVE"))


def missing_as_null(df: DataFrame) -> DataFrame:
    """Text columns with the words for a missing value as null."""
    return df.select(*[F.when(~F.trim(F.col(f"`{n}`")).isin(*MISSING), F.col(f"`{n}`")).alias(n)
                       if t == "string" else F.col(f"`{n}`") for n, t in df.dtypes])


def read_upload(spark: SparkSession, path: str, fmt: str | None = None,
                multi_line: bool = True) -> DataFrame:
    """Read one upload (file or directory of files of one format).

    CSV: header row, comma separated, every column as text, words for a missing
    value as null.  Files of a directory must share one header: another one ends
    the read with an error instead of shifting columns.  Parquet keeps its
    own types.  ``.xlsx`` is not read on Spark (single-file, single-machine
    format); convert it to CSV first.
    """
    fmt = fmt or os.path.splitext(path.rstrip("/"))[1].lstrip(".").lower() or "csv"
    if fmt == "csv":
        schema = text_schema(csv_header(spark, path))
        return missing_as_null(csv_reader(spark, multi_line).option("enforceSchema", False)
                               .schema(schema).csv(path))
    if fmt == "parquet":
        return spark.read.parquet(path)
    raise ValueError(f"Unsupported file format: .{fmt}")


def write_table(df: DataFrame, path: str, mode: str = "replace",
                partition_by: list[str] | None = None) -> None:
    """Replace (overwrite) or append a stored table as parquet."""
    if mode not in ("replace", "append"):
        raise ValueError(f"mode must be replace or append, not {mode!r}")
    writer = df.write.mode("overwrite" if mode == "replace" else "append")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)



def write_keyed(df: DataFrame, path: str, key: str, mode: str = "append") -> None:
    """Write rows partitioned by their upload key, so that a retry cannot duplicate.

    ``replace``: static overwrite — afterwards the table holds only these
    uploads.  ``append``: dynamic partition overwrite — only the partitions of
    these uploads are (re)written; a re-run of the same upload replaces its own
    rows instead of adding them again.
    """
    if mode not in ("replace", "append"):
        raise ValueError(f"mode must be replace or append, not {mode!r}")
    (df.write.mode("overwrite").partitionBy(key)
     .option("partitionOverwriteMode", "static" if mode == "replace" else "dynamic")
     .parquet(path))
