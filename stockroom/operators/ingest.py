"""Upload cleaning and scoring (I3–I11, I13–I15) and the upload job.

One plan does all checks: the upload is grouped by *all* of its columns
(whole-row duplicates collapse into one row with a multiplicity ``_n``, after
a map-side partial aggregate, so even a row repeated a billion times costs one
entry per task), and each distinct row is tagged with the first rule it
fails.  Attributing a row to its *first* failed rule reproduces the sequential
counts of "drop nulls of column 1, then of column 2, …, then the minimums".
Issues, score, clean rows and rejected rows are all small aggregates or
filters of that tagged table.
"""

from __future__ import annotations

import datetime as _dt
import json
import os
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stockroom.schemas import CATEGORIES, CategoryRules, rules_for, unknown_category
from stockroom.session import in_small_tasks
from stockroom.sources.files import write_keyed

VALID = "valid"
DUPLICATE = "duplicate_rows"
UPLOAD_KEY = "upload_key"      # partition column of stored upload outputs (= ledger id)


def _new_id() -> int:
    """A random upload id; the last bits stay free for the files of a batch."""
    return uuid.uuid4().int >> 85 << 20


def _recorded(spark: SparkSession, store: str, upload_id: int, category: str,
              filename: str | None = None) -> bool:
    """Whether this very upload is in the ledger; an id of another upload is an error."""
    from stockroom.operators.ledger import stored_table  # local: avoids a cycle
    led = stored_table(spark, os.path.join(store, "file_uploads"))
    row = None if led is None else led.where(F.col("id") == F.lit(upload_id)).first()
    if row is None:
        return False
    if row["file_category"] != category or (filename is not None and row["filename"] != filename):
        raise ValueError(f"upload id {upload_id} belongs to {row['file_category']}/{row['filename']}")
    return True


def _file_bytes(spark: SparkSession, path: str) -> int:
    """Size of an upload from file metadata; the content column is not read."""
    return spark.read.format("binaryFile").load(path).agg(F.sum("length")).first()[0] or 0


# ---------------------------------------------------------------------------
# I3 / I4 / I5 — names, schema check, types
# ---------------------------------------------------------------------------
def normalise_name(name: str) -> str:
    return name.strip().lower().replace(" ", "_")


def normalise_columns(df: DataFrame) -> DataFrame:
    """Trim, lower-case, blanks → ``_`` (driver-side metadata only)."""
    return df.toDF(*[normalise_name(c) for c in df.columns])


@dataclass(frozen=True)
class SchemaCheck:
    category: str
    valid: bool
    present: tuple[str, ...]
    missing: tuple[str, ...]
    extra: tuple[str, ...]
    error: str | None = None

    def as_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(
            [(self.category, self.valid, ",".join(self.present), ",".join(self.missing),
              ",".join(self.extra), self.error)],
            "category string, schema_valid boolean, required_present string, "
            "missing_columns string, extra_columns string, error string")


def validate_schema(df: DataFrame, category: str) -> SchemaCheck:
    """I4: required columns present?  Which are missing, which unknown.

    An unknown category is reported (not raised) as an invalid schema.
    """
    cols = [normalise_name(c) for c in df.columns]
    try:
        rules = rules_for(category)
    except ValueError as e:
        return SchemaCheck(category, False, (), (), tuple(cols), str(e))
    missing = tuple(c for c in rules.required if c not in cols)
    present = tuple(c for c in rules.required if c in cols)
    extra = tuple(c for c in cols if c not in rules.known)
    twice = sorted({c for c in cols if cols.count(c) > 1})
    hidden = [c for c in cols if c.startswith("_")]
    error = (f"columns named twice: {', '.join(twice)}" if twice else
             f"column names starting with an underscore: {', '.join(hidden)}" if hidden else
             f"required columns not found: {', '.join(missing)}" if missing else None)
    return SchemaCheck(category, error is None, present, missing, extra, error)


def _typed(df: DataFrame, rules: CategoryRules) -> DataFrame:
    """Cast the category's columns *by name* (bad values and NaN → null).

    The date column stays text until the date step; unknown columns are kept
    (they take part in whole-row duplicate detection) and dropped on load.
    """
    types = {f.name: f.dataType for f in rules.schema.fields}
    out = []
    for c in df.columns:
        if c in types and c != rules.date_column:
            out.append(as_type(F.col(c), types[c]).alias(c))
        elif c == rules.date_column:
            out.append(F.col(c).cast("string").alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


# Date layouts tried after ISO dates, in this order.
DATE_LAYOUTS = ("yyyy/MM/dd", "yyyyMMdd", "d-MMM-yyyy", "MMM d, yyyy", "MMMM d, yyyy")
# Dates that may name the month or the day first: 03/04/2024, 3-4-2024, 03.04.2024.
TWO_WAY = r"^([0-9]{1,2})[-/.]([0-9]{1,2})[-/.]([0-9]{4})$"


def as_date(c: Column, day_first: bool = False) -> Column:
    """A date from a date, a timestamp or text in one of several layouts; else null.

    A date that can be read both ways has its month first, or its day if ``day_first``;
    one that can be read in one way only is read so.
    """
    text = F.trim(c.cast("string"))
    slashed = F.translate(text, "-.", "//")
    month, day = (F.try_to_timestamp(slashed, F.lit(p)).cast("date") for p in ("M/d/yyyy", "d/M/yyyy"))
    two_way = F.coalesce(day, month) if day_first else F.coalesce(month, day)
    tries = [F.try_to_timestamp(text, F.lit(p)).cast("date") for p in DATE_LAYOUTS]
    # ISO first, which is none of the others; a failed try is costly and no layout lacks digits
    return F.coalesce(text.try_cast("date"), F.when(text.rlike(TWO_WAY), two_way)
                      .when(text.rlike("[0-9]"), F.coalesce(*tries)))


def as_type(c: Column, to: T.DataType) -> Column:
    """A value of the stored type, or null.  Whole numbers may be written as 10.0."""
    if isinstance(to, T.DateType):
        return as_date(c)
    if isinstance(to, (T.IntegerType, T.LongType)):
        number = c.try_cast("double")
        return F.coalesce(c.cast("string").try_cast(to), F.when(number == F.floor(number), number.try_cast(to)))
    if isinstance(to, T.DoubleType):
        number = c.try_cast("double")
        return F.when(~F.isnan(number), number)
    return c.try_cast(to)


def conform(df: DataFrame, category: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """The stored layout, selected by name; missing optional columns → null.

    ``keep`` names extra columns passed through unchanged after the layout.
    """
    rules = rules_for(category)
    present = dict(df.dtypes)
    cols = []
    for f in rules.schema.fields:
        if present.get(f.name) == "date" and isinstance(f.dataType, T.DateType):
            cols.append(F.col(f.name))          # read already
        elif f.name in present:
            cols.append(as_type(F.col(f.name), f.dataType).alias(f.name))
        else:
            cols.append(F.lit(None).cast(f.dataType).alias(f.name))
    return df.select(*cols, *[F.col(c) for c in keep])


# ---------------------------------------------------------------------------
# I6–I9 — one tagged table
# ---------------------------------------------------------------------------
def _rule_ladder(rules: CategoryRules, columns: list[str]) -> Column:
    expr = None
    steps = [(F.col(c).isNull(), f"null:{c}") for c in rules.required if c in columns]
    steps += [(F.col(c) < F.lit(m), f"min:{c}") for c, m in rules.minimums if c in columns]
    for cond, name in steps:
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    return expr.otherwise(F.lit(VALID)) if expr is not None else F.lit(VALID)


def tag_rows(upload: DataFrame, category: str) -> DataFrame:
    """Distinct rows of the upload with multiplicity ``_n`` and first failed ``_rule``.

    Rows are compared as they were uploaded; the typed values stand beside them, and
    ``_raw`` keeps the uploaded ones that a type may change for the rejects.
    """
    df = normalise_columns(upload)
    cols = [c for c in df.columns if not c.startswith("_")]
    return tag_grouped(df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n")), category, cols)


def tag_grouped(grouped: DataFrame, category: str, cols: list[str]) -> DataFrame:
    """``tag_rows`` of rows that are distinct already and have their multiplicity ``_n``;
    ``cols`` are the uploaded columns, any others are passed through."""
    rules = rules_for(category)
    types, given = {f.name: f.dataType for f in rules.schema.fields}, dict(grouped.dtypes)
    changed = [c for c in cols if c in types and not (given[c] == "string" and isinstance(types[c], T.StringType))]
    raw = F.struct(*[F.col(c) for c in changed or cols]).alias("_raw")      # the others stay as they are
    beside = [c for c in grouped.columns if c not in cols]
    typed = _typed(grouped.select(*cols, *beside, raw), rules)
    return typed.withColumn("_rule", _rule_ladder(rules, cols))


def _as_of(as_of) -> Column:
    if as_of is None:
        return F.current_date()
    return F.lit(str(as_of)).cast("date")


def _future(rules: CategoryRules, as_of, dated: bool = False) -> Column:
    d = F.col(rules.date_column)
    return (d if dated else as_date(d)) > _as_of(as_of)


# The kinds of issue and their severities.
DUPLICATE_ROWS, NULL_FIELD, BELOW_MINIMUM, FUTURE, UNPARSED = (
    ("duplicate_rows", "warning"), ("null_required_field", "error"), ("constraint_violation", "warning"),
    ("future_dates", "warning"), ("unparsed_dates", "warning"))


def _date_columns(rules: CategoryRules) -> list[str]:
    return [f.name for f in rules.schema.fields if isinstance(f.dataType, T.DateType)]


def _kinds(cols: list[str], rules: CategoryRules, unparsed: bool = False):
    """((issue_type, severity), column, auto_resolved, counter) in report order.  Counters
    are expressions over one row per rule (``quality_counts``)."""
    of_rule = lambda rule: F.sum(F.when(F.col("_rule") == rule, F.col("_rows")))
    kinds = [(DUPLICATE_ROWS, None, True, F.sum(F.col("_all") - F.col("_rows")))]
    kinds += [(NULL_FIELD, c, True, of_rule(f"null:{c}")) for c in rules.required if c in cols]
    kinds += [(BELOW_MINIMUM, c, True, of_rule(f"min:{c}")) for c, _ in rules.minimums if c in cols]
    if rules.date_column and rules.date_column in cols:
        kinds.append((FUTURE, rules.date_column, False, F.sum("_late")))
    if unparsed:
        kinds += [(UNPARSED, c, True, F.sum(f"_none_{c}")) for c in _date_columns(rules)]
    return kinds


def _uploaded(tagged: DataFrame) -> list[str]:
    return [c for c in tagged.columns if not c.startswith("_")]


def quality_counts(tagged: DataFrame, category: str, as_of=None,
                   by: list[str] | None = None, unparsed: bool = False) -> DataFrame:
    """One aggregate pass: every issue counter plus total and valid row counts.  Rows are
    counted per rule, and the few counts added up, so that no row is held against each rule.

    ``by`` groups the counters (e.g. per source file of a directory upload); ``unparsed``
    also counts dates that could not be read (a tagged table of ``batch.with_dates``).
    """
    rules = rules_for(category)
    cols, valid = _uploaded(tagged), F.col("_rule") == VALID
    counts = [F.count(F.lit(1)).alias("_rows"), F.sum("_n").alias("_all")]
    if rules.date_column and rules.date_column in cols:
        dated = dict(tagged.dtypes)[rules.date_column] == "date"
        counts.append(F.count_if(valid & _future(rules, as_of, dated)).alias("_late"))
    if unparsed:
        counts += [F.count_if(valid & F.col(f"_unparsed_{c}")).alias(f"_none_{c}") for c in _date_columns(rules)]
    per_rule = tagged.groupBy(*(by or []), "_rule").agg(*counts)
    return (per_rule.groupBy(*by) if by else per_rule).agg(
        *[F.coalesce(k[3], F.lit(0)).cast("long").alias(f"k{i}") for i, k in enumerate(_kinds(cols, rules, unparsed))],
        F.coalesce(F.sum("_all"), F.lit(0)).cast("long").alias("total_rows"),
        F.coalesce(F.sum(F.when(valid, F.col("_rows"))), F.lit(0)).cast("long").alias("valid_rows"))


def issues_of(counts: DataFrame, category: str, by: list[str] | None = None, cols: list[str] | None = None,
              unparsed: bool = False) -> DataFrame:
    """The counters of ``quality_counts``, unpivoted; kinds with a zero count are left out."""
    rules = rules_for(category)
    kinds = _kinds(list(rules.known) if cols is None else cols, rules, unparsed)
    rows = ", ".join(f"'{t}', '{s}', {('NULL' if c is None else repr(c))}, k{i}, {str(a).lower()}"
                     for i, ((t, s), c, a, _) in enumerate(kinds))
    keys = [f"`{k}`" for k in (by or [])]
    return (counts.selectExpr(
        *keys,
        f"stack({len(kinds)}, {rows}) AS (issue_type, severity, column_name, issue_count, auto_resolved)")
        .where(F.col("issue_count") > 0))


def score_of(counts: DataFrame, category: str, by: list[str] | None = None,
             cols: list[str] | None = None) -> DataFrame:
    """I10 from the counters: ``valid/total·100 − 2·(unresolved kinds)``, rounded to 2, clamped 0..100."""
    rules = rules_for(category)
    unresolved = F.lit(0)
    for i, k in enumerate(_kinds(list(rules.known) if cols is None else cols, rules)):
        if not k[2]:
            unresolved = unresolved + F.when(F.col(f"k{i}") > 0, 1).otherwise(0)
    t, v, u = F.col("total_rows"), F.col("valid_rows"), F.col("unresolved_issues")
    raw = F.round(v.cast("double") / t.cast("double") * F.lit(100.0) - u * F.lit(2.0), 2)
    score = F.when(t == 0, F.lit(0.0)).otherwise(F.least(F.lit(100.0), F.greatest(F.lit(0.0), raw)))
    keys = list(by or [])
    return (counts.select(*keys, "total_rows", "valid_rows", unresolved.cast("int").alias("unresolved_issues"))
            .select(*keys, "total_rows", "valid_rows", (t - v).alias("rejected_rows"),
                    "unresolved_issues", score.alias("quality_score")))


def quality_issues(tagged: DataFrame, category: str, as_of=None,
                   by: list[str] | None = None) -> DataFrame:
    """``(issue_type, severity, column_name, issue_count, auto_resolved)``.

    Future dates are counted among the rows that survive cleaning and are the only
    unresolved kind.
    """
    return issues_of(quality_counts(tagged, category, as_of, by), category, by, _uploaded(tagged))


def quality_score(tagged: DataFrame, category: str, as_of=None,
                  by: list[str] | None = None) -> DataFrame:
    """I10 of a tagged table."""
    return score_of(quality_counts(tagged, category, as_of, by), category, by, _uploaded(tagged))


def clean_rows(tagged: DataFrame, category: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows that pass every rule, in the stored layout (bad dates → null, kept).

    ``keep`` carries extra columns along (e.g. the upload key of a batch).
    """
    return conform(tagged.where(F.col("_rule") == VALID), category, keep)


def rejected_rows(tagged: DataFrame) -> DataFrame:
    """I13 (row level): each distinct rejected row as uploaded, the rule, and how many copies.

    Extra copies of a duplicated row are rejected as ``duplicate_rows``; the
    first copy is rejected by its failed rule, if any.
    """
    cols = [c for c in tagged.columns if not c.startswith("_")]
    entry = lambda rule, n: F.struct(rule.alias("rule"), n.cast("long").alias("rejected_count"))
    entries = F.array(
        F.when(F.col("_n") > 1, entry(F.lit(DUPLICATE), F.col("_n") - 1)),
        F.when(F.col("_rule") != VALID, entry(F.col("_rule"), F.lit(1))))
    # a column added after tagging (the upload's key) has no uploaded value
    raw = tagged.schema["_raw"].dataType.names
    shown = [F.col(f"_raw.{c}").alias(c) if c in raw else F.col(c) for c in cols]
    rejected = tagged.where((F.col("_n") > 1) | (F.col("_rule") != VALID))      # most rows have no entry
    return (rejected.select(*shown, F.inline(F.filter(entries, lambda e: e.isNotNull())))
            .select(*cols, "rule", "rejected_count"))


def quality_report(upload: DataFrame, category: str, as_of=None) -> DataFrame:
    """Validate-only report — schema check, counts and score, one row."""
    check = validate_schema(upload, category)
    head = [F.lit(category).alias("category"), F.lit(check.valid).alias("schema_valid"),
            F.lit(",".join(check.missing)).alias("missing_columns"),
            F.lit(",".join(check.extra)).alias("extra_columns")]
    if check.error and not check.missing:          # unknown category or unusable names: nothing to score
        return upload.sparkSession.range(1).select(
            *head, *[F.lit(None).cast(t).alias(n) for n, t in
                     (("total_rows", "long"), ("valid_rows", "long"),
                      ("rejected_rows", "long"), ("quality_score", "double"))])
    score = quality_score(tag_rows(upload, category), category, as_of)
    return score.select(*head, "total_rows", "valid_rows", "rejected_rows", "quality_score")


@dataclass(frozen=True)
class Validation:
    """I11 as DataFrames: the report row, issues, clean rows, rejected rows, a preview."""

    schema: SchemaCheck
    report: DataFrame
    issues: DataFrame
    clean: DataFrame
    rejected: DataFrame
    preview: DataFrame


def validate(upload: DataFrame, category: str, as_of=None, preview_rows: int = 10) -> Validation:
    """Validate without loading: every output is a lazy DataFrame over one tagged plan.

    The preview is the first ``preview_rows`` rows of the upload in a total
    order of its columns (deterministic, unlike "first rows read").
    """
    df = normalise_columns(upload)
    tagged = tag_rows(df, category)
    ordered = df.orderBy(*[F.col(c).asc_nulls_last() for c in df.columns])
    return Validation(validate_schema(df, category), quality_report(df, category, as_of),
                      quality_issues(tagged, category, as_of), clean_rows(tagged, category),
                      rejected_rows(tagged), ordered.limit(preview_rows))


# ---------------------------------------------------------------------------
# I14 — the upload job
# ---------------------------------------------------------------------------
@dataclass
class UploadResult:
    status: str
    category: str
    filename: str
    total_rows: int = 0
    valid_rows: int = 0
    quality_score: float = 0.0
    issues: list | None = None
    message: str = ""


def _reject(records: DataFrame, store: str, category: str, filename: str, uid: int,
            message: str, size: int | None) -> UploadResult:
    """Keep a refused upload as it is, under its name, category and id, and note why."""
    sink = os.path.join(store, "rejected", filename, f"file_category={category}", f"{UPLOAD_KEY}={uid}")
    records.write.mode("overwrite").parquet(sink)
    note = records.sparkSession.createDataFrame([(category, filename, size, message, str(uid))],
                                 f"file_category string, filename string, file_size_bytes long, message string, {UPLOAD_KEY} string")
    write_keyed(note, os.path.join(store, "rejected_uploads"), UPLOAD_KEY)
    return UploadResult("error", category, filename, message=message)


@in_small_tasks
def process_upload(spark: SparkSession, path: str, category: str, store: str,
                   mode: str = "replace", uploaded_by: str = "system", upload_id: int | None = None,
                   as_of=None, multi_line: bool | str = True) -> UploadResult:
    """Read → check schema → tag → write clean data → write issues → ledger row last.

    ``path`` is a file, or a folder whose files are one upload; CSV files may order their
    columns differently.  ``store`` is a shared folder.  The records and the tagged table
    are written once under the store (cutting lineage, and the point from which a lost
    executor's work is recomputed), and every output is derived from the tagged table;
    the counters of issues and score are computed once.  Clean rows, rejected rows and
    issues carry the upload id as the partition column ``upload_key`` (replace: static
    overwrite; append: dynamic partition overwrite), so re-running an upload rewrites its
    own partitions.  The data is written before the ledger row, so a failed load never
    leaves a ledger row pointing at missing data, and a retry with the same ``upload_id``
    after a completed run is a no-op.  Only one row of counters reaches the driver.

    ``multi_line``: quoted fields may hold line breaks; a file is then read by one task, or
    by many if "split".
    """
    from stockroom.operators import batch  # local: avoids a cycle
    from stockroom.operators.ledger import record_upload

    filename = os.path.basename(path.rstrip("/"))
    if upload_id is not None and _recorded(spark, store, upload_id, category, filename):   # a finished retry
        return UploadResult("success", category, filename,
                            message=f"upload {upload_id} is already recorded")
    uid = upload_id if upload_id is not None else _new_id()
    stamp = _dt.datetime.now(_dt.timezone.utc).strftime("%Y%m%dT%H%M%S%f")
    folder = os.path.join(store, "staging", f"{category}-{stamp}")
    records = batch.stage_records(spark, path, filename, f"{folder}/records", multi_line=multi_line)
    if category not in CATEGORIES:
        return _reject(records, store, category, filename, uid, unknown_category(category), _file_bytes(spark, path))
    rules = rules_for(category)
    files = batch.manifest(spark, path, records, rules, folder, ordered=False).withColumn(UPLOAD_KEY, F.lit(str(uid)))
    refused, size = files.agg(F.min_by("error", F.when(F.col("error").isNotNull(), F.col("name"))),
                              F.coalesce(F.sum("bytes"), F.lit(0))).first()
    if refused:
        return _reject(records, store, category, filename, uid, refused, size)
    tagged = batch.tag_upload(records, files, category, folder)

    cols = _uploaded(tagged)
    counted = quality_counts(tagged, category, as_of)
    counts = spark.createDataFrame([counted.first()], counted.schema)         # one row
    table_path = os.path.join(store, rules.table)
    key = F.lit(str(uid)).alias(UPLOAD_KEY)
    write_keyed(clean_rows(tagged, category, keep=(UPLOAD_KEY,)), table_path, UPLOAD_KEY, mode)
    write_keyed(rejected_rows(tagged), os.path.join(store, "rejected_rows", category), UPLOAD_KEY)
    issues_df = issues_of(counts, category, cols=cols)
    issues = [r.asDict() for r in issues_df.collect()]            # at most a dozen rows
    if issues:
        write_keyed(issues_df.select("*", F.lit(filename).alias("upload_file"), key),
                    os.path.join(store, "data_quality_issues"), UPLOAD_KEY)
    score = score_of(counts, category, cols=cols).first()         # one row
    unresolved = [i for i in issues if not i["auto_resolved"]]
    record_upload(spark, os.path.join(store, "file_uploads"), category=category, filename=filename,
                  row_count=int(score["valid_rows"]), quality_score=float(score["quality_score"]),
                  upload_mode=mode, uploaded_by=uploaded_by,
                  storage_path=f"{table_path}/{UPLOAD_KEY}={uid}",
                  validation_errors=json.dumps(unresolved, default=str), upload_id=uid, file_size_bytes=size)
    return UploadResult("success", category, filename, int(score["total_rows"]),
                        int(score["valid_rows"]), float(score["quality_score"]), issues,
                        f"Uploaded {int(score['valid_rows'])} rows to {category}")


def process_directory(spark: SparkSession, directory: str, category: str, store: str,
                      mode: str = "replace", uploaded_by: str = "system", as_of=None,
                      pattern: str = "*.csv", batch_id: int | None = None, **options):
    """I14 over a directory: every matching file is one upload (``batch.process_batch``)."""
    from stockroom.operators import batch  # local: avoids a cycle
    return batch.process_batch(spark, directory, category, store, mode, uploaded_by, as_of, pattern,
                               batch_id, **options)
