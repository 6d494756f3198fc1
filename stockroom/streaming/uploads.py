"""The upload job as a Structured Streaming query over an upload directory.

New CSV files of one category arriving in ``upload_dir`` are read with the
category's all-text schema (no inference), and each micro-batch goes through
the same cleaning plan as a batch upload (``operators.ingest``).  Outputs go
under ``<store>/stream/``, each table partitioned by micro-batch
(``epoch=<id>``): clean rows, rejected rows, issue counts, and one ledger row
per micro-batch written last.  Each epoch overwrites only its own partition,
so a micro-batch replayed after a failure cannot duplicate rows.  Progress and
file tracking live in the checkpoint folder, which must be on shared storage;
by default it is placed under ``spark.checkpoint.dir``.

Files must carry the category's full column layout: the header is validated
against it (``enforceSchema=false``), so a file with other columns fails the
batch instead of loading values into the wrong columns.  Uploads with other
layouts go through the batch job, which maps columns by name.
"""

from __future__ import annotations

import datetime as _dt
import json
import os
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from stockroom.operators import ingest
from stockroom.schemas import LEDGER, rules_for
from stockroom.session import shared_dir
from stockroom.sources.files import missing_as_null


FILE, SIZE = "_file", "_file_bytes"      # where a row comes from, beside its columns


def upload_schema(category: str) -> T.StructType:
    """All known columns of the category, as text, in rule order."""
    rules = rules_for(category)
    return T.StructType([T.StructField(c, T.StringType()) for c in rules.known])


def _batch_writer(category: str, store: str, as_of, uploaded_by: str):
    rules = rules_for(category)
    out = os.path.join(store, "stream")

    def part(name: str, epoch: int) -> str:
        return os.path.join(out, name, f"upload_category={category}", f"epoch={epoch}")

    def write(batch: DataFrame, epoch: int) -> None:
        # Every output of an epoch overwrites its own epoch=<id> folder, so a
        # micro-batch replayed after a failure replaces what it wrote before
        # instead of appending it twice (foreachBatch is at-least-once).
        staged = os.path.join(store, "staging", f"{category}-stream-{epoch}")
        size = None
        if FILE in batch.columns:      # the files of the micro-batch, at most the trigger's number
            size = batch.groupBy(FILE).agg(F.max(SIZE).alias("n")).agg(F.sum("n")).first()[0]
            batch = batch.drop(FILE, SIZE)
        ingest.tag_rows(missing_as_null(batch), category).write.mode("overwrite").parquet(staged)
        tagged = batch.sparkSession.read.parquet(staged)
        ingest.clean_rows(tagged, category).write.mode("overwrite").parquet(
            part(rules.table, epoch))
        ingest.rejected_rows(tagged).write.mode("overwrite").parquet(
            part("rejected_rows", epoch))
        cols = ingest._uploaded(tagged)
        counted = ingest.quality_counts(tagged, category, as_of)
        counts = batch.sparkSession.createDataFrame([counted.first()], counted.schema)      # one row
        issues = ingest.issues_of(counts, category, cols=cols)
        issues.write.mode("overwrite").parquet(part("data_quality_issues", epoch))
        score = ingest.score_of(counts, category, cols=cols).first()
        if score["total_rows"] == 0:
            return
        unresolved = [r.asDict() for r in issues.where(~F.col("auto_resolved")).collect()]
        when = _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None)
        # ids of different categories' epochs do not meet
        row = ((zlib.crc32(category.encode()) << 30) + int(epoch), category, f"{category}-epoch-{epoch}", when, "append", uploaded_by,
               int(score["valid_rows"]), size, float(score["quality_score"]),
               json.dumps(unresolved, default=str), part(rules.table, epoch))
        (batch.sparkSession.createDataFrame([row], LEDGER).write.mode("overwrite")
         .parquet(part("file_uploads", epoch)))

    return write


def start_upload_stream(spark: SparkSession, upload_dir: str, category: str, store: str,
                        checkpoint: str | None = None, as_of=None, uploaded_by: str = "stream",
                        available_now: bool = False, max_files_per_trigger: int = 100
                        ) -> StreamingQuery:
    """Start the stream; ``available_now`` processes what is there and stops."""
    checkpoint = checkpoint or os.path.join(shared_dir(spark), f"uploads-{category}")
    stream = (spark.readStream.schema(upload_schema(category))
              .option("header", True).option("enforceSchema", False).option("quote", '"').option("escape", '"')
              .option("maxFilesPerTrigger", max_files_per_trigger)
              .csv(upload_dir)
              .select("*", F.col("_metadata.file_path").alias(FILE), F.col("_metadata.file_size").alias(SIZE)))
    writer = (stream.writeStream.foreachBatch(_batch_writer(category, store, as_of, uploaded_by))
              .option("checkpointLocation", checkpoint))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(
        processingTime="30 seconds")
    return writer.start()
