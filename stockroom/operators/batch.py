"""Uploads of any header, many at once.

Files are read once, without a header, as rows of text fields; what each field means
is looked up in the file's own header.  So files with other column orders, missing or
extra columns are cleaned together in one job, and nothing about them passes through
the driver:

* the *manifest* has one row per file (from file metadata): its name, size, place in
  name order, header, and where each known column stands in it, or why it is refused;
* the *rows* are grouped as uploaded, per upload; known columns are picked by name,
  all others are kept under their names in ``extra_columns``;
* the layout of a file's date column is found from its values: of the readings day
  first and month first, the one that fits them all.

Uploads that are refused (no header line, a column named twice, missing required
columns, more than MAX_COLUMNS columns) keep their rows in the rejected sink.
"""

from __future__ import annotations

import datetime as _dt
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import Row

from stockroom.functions.ordering import numbered
from stockroom.operators import ingest
from stockroom.operators.ledger import stored_table
from stockroom.schemas import CategoryRules, rules_for
from stockroom.session import in_small_tasks
from stockroom.sources import xlsx
from stockroom.sources.files import MISSING, csv_reader, text_schema, write_keyed

MAX_COLUMNS = 256       # columns of one file; a wider one is refused
KEY, EXTRA = ingest.UPLOAD_KEY, "extra_columns"
BOM = "﻿"


# ---------------------------------------------------------------------------
# Files as rows of fields
# ---------------------------------------------------------------------------
def listed(spark: SparkSession, path: str, pattern: str | None, recursive: bool) -> DataFrame:
    """file (as rows name it), name, bytes of every matching file; contents are not read.

    A scan leaves out files of no bytes, so those come from its file index: it lies in
    the session's JVM anyway and becomes a table there.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", recursive)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    scan = reader.load(path)
    some = scan.select(F.col("_metadata.file_path").alias("file"), "path", F.col("length").alias("bytes"))
    jvm = spark._jvm
    index = DataFrame(spark._jsparkSession.createDataset(
        jvm.scala.collection.immutable.ArraySeq.unsafeWrapArray(scan._jdf.inputFiles()),
        jvm.org.apache.spark.sql.Encoders.STRING()).toDF(), spark)
    local = lambda c: F.regexp_replace(c, "^file:/+", "file:/")  # noqa: E731 - one file, two spellings
    plain = local(F.url_decode(F.replace("value", F.lit("+"), F.lit("%2B"))))
    none = (index.select(F.col("value").alias("file"), plain.alias("path"))
            .join(some.select(local("path").alias("path")), "path", "left_anti")
            .select("file", "path", F.lit(0).cast("long").alias("bytes")))
    return some.unionByName(none).select("file", F.regexp_extract("path", "([^/]*)$", 1).alias("name"), "bytes")


# A line whose quotes all belong to quoted fields that end on it; possessive, so without recursion.
WHOLE_LINE = r'^(?:"(?:[^"]++|"")*+"|[^",]*+)(?:,(?:"(?:[^"]++|"")*+"|[^",]*+))*+\z'


def csv_lines(spark: SparkSession, path: str, pattern: str | None, recursive: bool) -> tuple[int, bool]:
    """From one pass over the lines of all files: an upper bound of the columns of any file,
    and whether in all of them every line is a record of its own, however it is read.

    The bound is the commas in a file's first line, plus one.  A first line that ends inside
    quotes says nothing, so the bound is MAX_COLUMNS + 1 then.  Lines are records if none
    leaves a quote open, has quotes inside an unquoted field or is blank but not empty, and
    if all lines of a file end alike, without other carriage returns.
    """
    reader = spark.read.option("recursiveFileLookup", recursive).option("lineSep", "\n")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    text, returned = F.col("text"), F.col("value").endswith("\r")
    count = lambda sign: F.octet_length(text) - F.octet_length(F.replace(text, F.lit(sign)))
    lines = reader.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("pos"), returned.alias("returned"),
        F.when(returned, F.regexp_replace("value", "\r\\z", "")).otherwise(F.col("value")).alias("text"))
    # only a line that sorts before "!" begins with a blank
    blank = (text < F.lit("!")) & text.rlike(r"^[\x00-\x20]++\z")
    whole = ~text.contains("\r") & ~blank & (~text.contains('"') | text.rlike(WHOLE_LINE))
    width = F.when(~text.contains('"') | (count('"') % 2 == 0), count(",") + 1).otherwise(MAX_COLUMNS + 1)
    top = (F.col("block") == 0) & (F.trim(text) != "")
    each = lines.groupBy("file").agg(
        F.min_by(F.when(top, width), F.when(top, F.col("pos"))).alias("n"),
        (F.bool_and(whole) & (F.bool_and("returned") == F.bool_or("returned"))).alias("whole"))
    found = each.agg(F.max("n").alias("n"), F.bool_and("whole").alias("whole")).first()
    return min(found["n"] or 1, MAX_COLUMNS + 1), found["whole"] is not False


def csv_fields(spark: SparkSession, path: str, pattern: str | None = None, recursive: bool = False,
               multi_line: bool = True, width: int | None = None) -> DataFrame:
    """Every record of every CSV file, headers included: file, block, pos (ascending
    within a block of a file) and its fields as text, at least ``width`` if that is known."""
    names = [f"c{i}" for i in range(width or csv_lines(spark, path, pattern, recursive)[0])]
    reader = (csv_reader(spark, multi_line).option("header", False).schema(text_schema(names))
              .option("recursiveFileLookup", recursive))
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.csv(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("pos"), F.array(*names).alias("fields"))


def split_csv_fields(spark: SparkSession, path: str, at: str, pattern: str | None = None,
                     recursive: bool = False, width: int | None = None) -> DataFrame:
    """``csv_fields`` of files whose quoted fields hold line breaks, each read by many tasks.

    A line begins inside a quoted field if the quotes before it in the file are odd in
    number.  Quotes are counted per block of a file, the blocks' parities summed in order
    (one row per block), and every block then follows its own lines.  A line that begins
    outside opens a record; the lines up to the next such line belong to it, also those of
    later blocks.  The lines with their records are written to ``at``.
    """
    names = [f"c{i}" for i in range(width or csv_lines(spark, path, pattern, recursive)[0])]
    reader = spark.read.option("recursiveFileLookup", recursive)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    odd = (F.length("value") - F.length(F.replace("value", F.lit('"')))) % 2
    lines = reader.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("pos"), "value", odd.alias("odd"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    inside = lines.groupBy("file", "block").agg((F.sum("odd") % 2).alias("odd")).select(
        "file", "block", (F.coalesce(F.sum("odd").over(earlier), F.lit(0)) % 2).alias("inside"))
    in_block = Window.partitionBy("file", "block").orderBy("pos")
    so_far = F.sum("odd").over(in_block.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("odd")
    followed = (lines.join(inside, ["file", "block"]).withColumn("within", (F.col("inside") + so_far) % 2)
                .withColumn("opened", F.last(F.when(F.col("within") == 0, F.col("pos")), True).over(
                    in_block.rowsBetween(Window.unboundedPreceding, Window.currentRow))))
    followed.select("file", "block", "pos", "value", "odd", "within", "opened").write.mode("overwrite").parquet(at)
    held = spark.read.parquet(at)
    carried = held.groupBy("file", "block").agg(F.max_by("opened", "pos").alias("opened")).select(
        F.col("file").alias("_file"), F.col("block").alias("_block"), F.last("opened", True).over(earlier).alias("before"))
    known = held.join(carried, (F.col("file") == F.col("_file")) & (F.col("block") == F.col("_block")))
    known = known.withColumn("record", F.coalesce("opened", "before"))
    alone = (F.col("within") == 0) & (F.col("odd") == 0)
    single = known.where(alone).select("file", "block", "pos", "value")
    line = F.array_sort(F.collect_list(F.struct("block", "pos", "value")))
    joined = (known.where(~alone).groupBy("file", "record").agg(line.alias("ls"))
              .select("file", F.col("ls")[0]["block"].alias("block"), F.col("record").alias("pos"),
                      F.array_join(F.transform("ls", lambda x: x["value"]), "\n").alias("value")))
    parsed = F.from_csv("value", ", ".join(f"{n} string" for n in names), {"quote": '"', "escape": '"'})
    return single.unionByName(joined).where(F.trim("value") != "").select(
        "file", "block", "pos", parsed.alias("r")).select("file", "block", "pos", F.array(*[f"r.{n}" for n in names]).alias("fields"))


def parquet_fields(spark: SparkSession, path: str, pattern: str | None = None, recursive: bool = False) -> DataFrame:
    """The records of typed files in the shape of ``csv_fields``: values as text, behind a
    header record per file.  Columns that some files lack are null in these."""
    reader = spark.read.option("recursiveFileLookup", recursive).option("mergeSchema", True)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    rows = reader.parquet(path)
    names = rows.columns
    values = rows.select(F.col("_metadata.file_path").alias("file"), F.lit(0).cast("long").alias("block"),
                         F.monotonically_increasing_id().alias("pos"),
                         F.array(*[F.col(f"`{c}`").cast("string") for c in names]).alias("fields"))
    heads = listed(spark, path, pattern, recursive).select(
        "file", F.lit(0).cast("long").alias("block"), F.lit(-1).cast("long").alias("pos"),
        F.array(*[F.lit(c) for c in names]).alias("fields"))
    return values.unionByName(heads)


def xlsx_fields(spark: SparkSession, path: str, pattern: str | None = None, recursive: bool = False) -> DataFrame:
    """The rows of every workbook's first sheet in the shape of ``csv_fields``; one task
    reads one file (``sources.xlsx``)."""
    cloudpickle.register_pickle_by_value(xlsx)          # executors need no copy of this package
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", recursive)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    books = reader.load(path).select(F.col("_metadata.file_path").alias("file"), "content")
    rows = books.mapInPandas(xlsx.records, "file string, pos long, fields array<string>")
    return rows.select("file", F.lit(0).cast("long").alias("block"), "pos", "fields")


def ending_of(name: str) -> str:
    """The format that a file name or a pattern of names ends in; none means CSV."""
    return re.sub(r"\[(.)[^\]]*\]", r"\1", os.path.splitext(name)[1]).lower().lstrip(".") or "csv"


def stage_records(spark: SparkSession, path: str, name: str, at: str, pattern: str | None = None,
                  recursive: bool = False, multi_line: bool | str = True) -> DataFrame:
    """The records of the files under ``path``, read as the ending of ``name`` says, written to ``at``.

    ``multi_line`` of CSV files: False, fields hold no line breaks; True, they may, and a file
    is read by one task; "split", large files are read by many (``split_csv_fields``).  If no
    field of any file holds one (``csv_lines``), files are split by their lines in any case.
    """
    ending = ending_of(name)
    if ending == "csv":
        width, whole = csv_lines(spark, path, pattern, recursive)
        if multi_line == "split" and not whole:
            records = split_csv_fields(spark, path, f"{at}-lines", pattern, recursive, width)
        else:
            records = csv_fields(spark, path, pattern, recursive, bool(multi_line) and not whole, width)
        records.write.mode("overwrite").parquet(at)
    elif ending == "parquet":
        parquet_fields(spark, path, pattern, recursive).write.mode("overwrite").parquet(at)
    elif ending == "xlsx":
        size, before = "spark.sql.execution.arrow.maxRecordsPerBatch", None
        before = spark.conf.get(size)
        spark.conf.set(size, "1")           # workbooks pass to a task one by one
        try:
            xlsx_fields(spark, path, pattern, recursive).write.mode("overwrite").parquet(at)
        finally:
            spark.conf.set(size, before)
    else:
        raise ValueError(f"Unsupported file format: .{ending}")
    return spark.read.parquet(at)


def headers(records: DataFrame, at: str) -> DataFrame:
    """file, first (the place of its header record), names (normalised).

    The places are found on numbers alone, without a sort, and written to ``at``, one row per
    file, so that the records need not be shuffled to pick them."""
    top = records.where(F.col("block") == 0)
    top.groupBy(F.col("file").alias("of")).agg(F.min("pos").alias("first")).write.mode("overwrite").parquet(at)
    found = top.join(records.sparkSession.read.parquet(at), (F.col("file") == F.col("of")) & (F.col("pos") == F.col("first")))
    plain = F.transform("fields", lambda x: F.regexp_replace(
        F.lower(F.trim(F.replace(x, F.lit(BOM), F.lit("")))), " ", "_"))
    last = F.array_max(F.transform(plain, lambda x, i: F.when(F.coalesce(x, F.lit("")) != "", i + 1)))
    width = F.coalesce(last, F.lit(0))
    # a column without a name gets one from its place
    names = F.transform(F.slice(plain, 1, width), lambda x, i: F.when(
        F.coalesce(x, F.lit("")) == "", F.concat(F.lit("_c"), i.cast("string"))).otherwise(x))
    return found.select("file", "first", names.alias("names"))


def checked(files: DataFrame, rules: CategoryRules) -> DataFrame:
    """Adds ``missing``, ``extra`` and ``error`` (why a file is refused, else null)."""
    fixed = lambda xs: F.array(*[F.lit(x) for x in xs]).cast("array<string>")
    names = F.coalesce("names", F.array().cast("array<string>"))
    missing, extra = F.array_except(fixed(rules.required), names), F.array_except(names, fixed(rules.known))
    twice = F.filter(F.array_distinct(names), lambda x: F.size(F.filter(names, lambda y: y == x)) > 1)
    return (files.withColumn("missing", missing).withColumn("extra", extra).withColumn("error", F.when(
        F.size(names) == 0, F.lit("the file has no header line"))
        .when(F.size(names) > MAX_COLUMNS, F.lit(f"the file has more than {MAX_COLUMNS} columns"))
        .when(F.size(twice) > 0, F.concat(F.lit("columns named twice: "), F.array_join(twice, ", ")))
        .when(F.size(missing) > 0, F.concat(F.lit("required columns not found: "), F.array_join(missing, ", ")))))


def manifest(spark: SparkSession, path: str, records: DataFrame, rules: CategoryRules, folder: str,
             pattern: str | None = None, recursive: bool = False, ordered: bool = True) -> DataFrame:
    """One row per file, files without rows included, with its ``place`` in name order if
    ``ordered``; written under ``folder``."""
    files = checked(listed(spark, path, pattern, recursive).join(
        headers(records, os.path.join(folder, "first")), "file", "left"), rules)
    if ordered:
        files = numbered(files, ["name", "file"], os.path.join(folder, "listed"))
    out = os.path.join(folder, "manifest")
    files.write.mode("overwrite").parquet(out)
    return spark.read.parquet(out)


def accepted_rows(records: DataFrame, files: DataFrame, rules: CategoryRules) -> DataFrame:
    """The rows of accepted files, whose rows in ``files`` carry their upload's key: known
    columns by name, the others in EXTRA."""
    at = {c: F.array_position("names", c) - 1 for c in rules.known}
    extras = F.array_sort(F.transform(F.filter(F.transform("names", lambda x, i: F.struct(
        x.alias("name"), i.alias("at"))), lambda s: F.array_contains("extra", s["name"])), lambda s: s))
    accepted = files.where(F.col("error").isNull()).select(
        F.col("file").alias("of"), "first", KEY, *[v.alias(f"at_{c}") for c, v in at.items()], extras.alias("at_extra"))
    rows = records.join(accepted, (F.col("file") == F.col("of")) & (F.col("pos") != F.col("first")))
    def value(at: Column) -> Column:
        x = F.get("fields", at)
        return F.when(~F.trim(x).isin(*MISSING), x)
    beside = F.transform("at_extra", lambda s: F.struct(s["name"].alias("name"), value(s["at"]).alias("value")))
    none = F.array().cast("array<struct<name:string,value:string>>")     # nothing to look up in most files
    return rows.select(
        *[value(F.col(f"at_{c}").cast("int")).alias(c) for c in rules.known],
        F.when(F.size("at_extra") > 0, beside).otherwise(none).alias(EXTRA), KEY)


def tag_records(rows: DataFrame, category: str) -> DataFrame:
    """The tagged table (``ingest.tag_rows``) of ``accepted_rows``.  Equal rows of one upload
    are one row with a multiplicity; columns are compared by name."""
    grouped = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("_n"))
    return ingest.tag_grouped(grouped, category, [*rules_for(category).known, EXTRA])


# ---------------------------------------------------------------------------
# I9 — the layout of a date column
# ---------------------------------------------------------------------------
def day_first(tagged: DataFrame, columns: list[str], by: str = KEY) -> DataFrame:
    """``by`` and, per date column, ``_day_<column>``: whether an upload's dates of the kind
    03/04/2024 or 3-4-2024 name the day first: all of them can be read so, and not all with
    the month first.  Both readings are AND-ed over the values by partial aggregates; an
    upload without such dates has no row."""
    def fits(c: str) -> Column:
        text = F.trim(F.col(f"_raw.{c}").cast("string"))
        x, y = (F.regexp_extract(text, ingest.TWO_WAY, i).try_cast("int") for i in (1, 2))
        day = F.bool_and(x.between(1, 31) & y.between(1, 12))       # null, so left out, where not of the kind
        month = F.bool_and(x.between(1, 12) & y.between(1, 31))
        return F.coalesce(day & ~month, F.lit(False)).alias(f"_day_{c}")
    some = reduce(or_, [F.trim(F.col(f"_raw.{c}").cast("string")).rlike(ingest.TWO_WAY) for c in columns])
    return tagged.where(some).groupBy(F.col(by).alias("_of")).agg(*[fits(c) for c in columns])


def with_dates(tagged: DataFrame, category: str, rows: DataFrame, path: str) -> DataFrame:
    """The tagged table with its date columns as dates in the layouts of their upload, and
    ``_unparsed_<column>``: whether a value was there but is no date in any layout.  The
    layouts, one row per upload, follow from the ``rows`` tagged and are written to ``path``."""
    columns = ingest._date_columns(rules_for(category))
    if not columns:
        return tagged
    day_first(rows.select(KEY, F.struct(*columns).alias("_raw")), columns).write.mode("overwrite").parquet(path)
    read = tagged.join(tagged.sparkSession.read.parquet(path), F.col(KEY) == F.col("_of"), "left")
    dates = {c: F.when(F.col(f"_day_{c}"), ingest.as_date(F.col(f"_raw.{c}"), day_first=True))
             .otherwise(ingest.as_date(F.col(f"_raw.{c}"))) for c in columns}
    # a required date column counts as present by its text; only its value becomes a date
    return (read.withColumns(dates).withColumns(
        {f"_unparsed_{c}": F.col(f"_raw.{c}").isNotNull() & F.col(c).isNull() for c in columns})
        .drop("_of", *[f"_day_{c}" for c in columns]))


def tag_upload(records: DataFrame, files: DataFrame, category: str, folder: str) -> DataFrame:
    """``tag_records`` with its dates read, written once under ``folder``: every output is
    derived from dates, none parses them again."""
    at, rows = os.path.join(folder, "tagged"), accepted_rows(records, files, rules_for(category))
    dated = with_dates(tag_records(rows, category), category, rows, os.path.join(folder, "layouts"))
    dated.write.mode("overwrite").parquet(at)
    return records.sparkSession.read.parquet(at)


# ---------------------------------------------------------------------------
# I14 — a batch of files
# ---------------------------------------------------------------------------
@dataclass(frozen=True)
class BatchResult:
    """Outcome of a batch: ``frame`` has one row per file, in name order.

    Iterating streams the rows partition by partition; nothing is collected before.
    """

    frame: DataFrame

    @staticmethod
    def _result(r: Row) -> ingest.UploadResult:
        return ingest.UploadResult(r["status"], r["category"], r["filename"], int(r["total_rows"]), int(r["valid_rows"]),
                                   float(r["quality_score"]), None, r["message"])

    def __iter__(self) -> Iterator[ingest.UploadResult]:
        return map(self._result, self.frame.orderBy("place").toLocalIterator())

    def __getitem__(self, i: int) -> ingest.UploadResult:
        row = self.frame.where(F.col("place") == i).first() if i >= 0 else None
        if row is None:
            raise IndexError(i)
        return self._result(row)

    def __len__(self) -> int:
        return self.frame.count()


@in_small_tasks
def process_batch(spark: SparkSession, path: str, category: str, store: str, mode: str = "replace",
                  uploaded_by: str = "system", as_of=None, pattern: str = "*.[cC][sS][vV]",
                  batch_id: int | None = None, multi_line: bool | str = True, recursive: bool = False) -> BatchResult:
    """Every matching file under ``path`` (CSV; by the pattern's ending also parquet or xlsx)
    is one upload; all are cleaned in one job.

    File number *i* in name order has upload id ``batch_id + i``, which keys its rows in
    every output.  The first accepted file carries the batch's mode, the others are
    appends, so the derived archive status matches what the table holds.  Files without
    data rows are uploads of no rows.  Written in this order: clean rows, rejected rows,
    issues, rejected files, ledger rows (those not there yet), results, and last the
    batch's commit marker; a batch with a marker is not run again, and one without it
    rewrites its own partitions from the manifest of its first attempt on.
    """
    base = batch_id if batch_id is not None else ingest._new_id()
    folder = os.path.join(store, "batches", str(base))
    results = os.path.join(folder, "results")
    if stored_table(spark, os.path.join(folder, "committed")) is not None:
        said = F.lit(f"batch {base} is already recorded")
        done = spark.read.parquet(results)
        if done.where(F.col("category") != category).limit(1).count():
            raise ValueError(f"batch {base} belongs to another category")
        return BatchResult(done.withColumn("message", said))
    ingest._recorded(spark, store, base, category)      # an id of another category's upload is an error
    rules = rules_for(category)
    staged = os.path.join(folder, "records")
    files = stored_table(spark, os.path.join(folder, "manifest"))
    if files is None:           # a retry goes on from the records and files of the first attempt
        found = stage_records(spark, path, pattern, staged, pattern, recursive, multi_line)
        files = manifest(spark, path, found, rules, folder, pattern, recursive)
    records = spark.read.parquet(staged)
    files = files.withColumn(KEY, (F.lit(base) + F.col("place")).cast("string"))
    tagged = tag_upload(records, files, category, folder)

    counts_at = os.path.join(folder, "counts")
    counted = ingest.quality_counts(tagged, category, as_of, by=[KEY], unparsed=True)
    counted.write.mode("overwrite").parquet(counts_at)
    counts = spark.read.parquet(counts_at)              # one row per file with rows
    accepted = files.where(F.col("error").isNull())
    if not accepted.isEmpty():
        outcome = (("issues", ingest.issues_of(counts, category, [KEY], unparsed=True)),
                   ("score", ingest.score_of(counts, category, [KEY])))
        _write_outputs(spark, tagged, files, records, category, store, base, mode, dict(outcome), uploaded_by)
    else:
        _write_rejected(records, files, category, store)
    _results(files, counts, category).write.mode("overwrite").parquet(results)
    (spark.range(1).select(F.lit(base).cast("long").alias("batch_id"), F.lit(category).alias("category"),
                           F.current_timestamp().alias("at"))
     .write.mode("overwrite").parquet(os.path.join(folder, "committed")))
    return BatchResult(spark.read.parquet(results))


def _write_outputs(spark, tagged, files, records, category, store, base, mode, outcome, uploaded_by) -> None:
    rules = rules_for(category)
    spread = lambda df: df.hint("rebalance", KEY)  # noqa: E731 - small files together, a hot one apart
    write_keyed(spread(ingest.clean_rows(tagged, category, keep=(KEY,))), os.path.join(store, rules.table), KEY, mode)
    write_keyed(spread(ingest.rejected_rows(tagged)), os.path.join(store, "rejected_rows", category), KEY)
    names = files.select(F.col(KEY).alias("_k"), F.col("name").alias("upload_file"))
    issues = outcome["issues"].join(names, F.col(KEY) == F.col("_k")).drop("_k")
    write_keyed(spread(issues.select("issue_type", "severity", "column_name", "issue_count", "auto_resolved",
                                     "upload_file", KEY)), os.path.join(store, "data_quality_issues"), KEY)
    _write_rejected(records, files, category, store)
    at = os.path.join(store, "file_uploads")
    rows = ledger_rows(files, outcome, category, os.path.join(store, rules.table), mode, uploaded_by)
    known = stored_table(spark, at)
    if known is not None:       # rows that an earlier attempt has written
        rows = rows.join(known.select(F.col("id").alias("_id")), F.col("id") == F.col("_id"), "left_anti")
    rows.write.mode("append").parquet(at)


def ledger_rows(files: DataFrame, outcome: dict[str, DataFrame], category: str, table: str, mode: str,
                uploaded_by: str) -> DataFrame:
    """U1 for a batch: one ledger row per accepted file, a microsecond apart in name order."""
    accepted = files.where(F.col("error").isNull())
    first = accepted.agg(F.min("place")).first()[0]
    when = F.lit(_dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None)).cast("timestamp_ntz")
    errors = (outcome["issues"].where(~F.col("auto_resolved")).groupBy(F.col(KEY).alias("_e"))
              .agg(F.to_json(F.sort_array(F.collect_list(F.struct("issue_type", "severity", "column_name", "issue_count"))))
                   .alias("validation_errors")))         # a dozen kinds at most
    score = outcome["score"].select(F.col(KEY).alias("_s"), "valid_rows", "quality_score")
    joined = (accepted.join(score, F.col(KEY) == F.col("_s"), "left")
              .join(errors, F.col(KEY) == F.col("_e"), "left"))
    return joined.select(
        F.col(KEY).cast("long").alias("id"), F.lit(category).alias("file_category"), F.col("name").alias("filename"),
        (when + F.make_dt_interval(secs=F.col("place").cast("decimal(18,6)") / F.lit(1_000_000))).alias("upload_timestamp"),
        F.when(F.col("place") == first, F.lit(mode)).otherwise(F.lit("append")).alias("upload_mode"),
        F.lit(uploaded_by).alias("uploaded_by"), F.coalesce("valid_rows", F.lit(0)).cast("long").alias("row_count"),
        F.col("bytes").alias("file_size_bytes"), F.coalesce("quality_score", F.lit(0.0)).alias("quality_score"),
        F.coalesce("validation_errors", F.lit("[]")).alias("validation_errors"),
        F.concat(F.lit(f"{table}/{KEY}="), F.col(KEY)).alias("storage_path"))


def _write_rejected(records: DataFrame, files: DataFrame, category: str, store: str) -> None:
    """Refused files and why, and their records as they stand, per upload."""
    refused = files.where(F.col("error").isNotNull()).select("file", "name", "bytes", "names", "error", KEY)
    if refused.isEmpty():
        return
    kept = records.withColumnRenamed("file", "of").join(refused, F.col("of") == F.col("file"))
    write_keyed(kept.select("name", "pos", "fields", F.lit(category).alias("file_category"), KEY).hint("rebalance", KEY),
                os.path.join(store, "rejected_files"), KEY)
    write_keyed(refused.select(F.lit(category).alias("file_category"), F.col("name").alias("filename"),
                               F.col("bytes").alias("file_size_bytes"), F.col("error").alias("message"), KEY),
                os.path.join(store, "rejected_uploads"), KEY)


def _results(files: DataFrame, counts: DataFrame, category: str) -> DataFrame:
    score = ingest.score_of(counts, category, [KEY]).select(F.col(KEY).alias("_s"), "total_rows", "valid_rows", "quality_score")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return files.join(score, F.col(KEY) == F.col("_s"), "left").select(
        "place", F.col(KEY).cast("long").alias("upload_id"),
        F.when(F.col("error").isNull(), "success").otherwise("error").alias("status"),
        F.lit(category).alias("category"), F.col("name").alias("filename"), F.col("bytes").alias("file_size_bytes"),
        zero("total_rows"), zero("valid_rows"), F.coalesce("quality_score", F.lit(0.0)).alias("quality_score"),
        F.coalesce("error", F.concat(F.lit("Uploaded "), F.coalesce("valid_rows", F.lit(0)).cast("string"),
                                     F.lit(f" rows to {category}"))).alias("message"))
