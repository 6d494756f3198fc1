"""WARC archives and their globally ordered capture index.

Writing: one record per page.  Payloads that are equal and at least ``least``
bytes long are stored once, with the record of the largest page id; the others
are revisit records that name it.  Records are written by Spark's text writer as
gzipped archive files of bounded size in the cluster's shared folder: header and
payload are the value, the record's closing blank lines are the line separator.

Reading: archives come back through Spark's binary file source and are parsed by
Content-Length, never by searching for separators.  Each archive yields a
locally sorted capture run; runs are range partitioned by (URL key, timestamp,
page) and every partition merges its k runs with a loser tree, so that the
partitions in order hold all capture histories in order.

Defined cases: a null html is an empty payload; a null url has the empty URL
key; pages that share an id are separate records (a revisit names the id); ties
of URL key and timestamp are ordered by page id, then record type; pages with a
null id are archived and read back with a null id; an empty table gives no
archive and no rows; other columns are not read.
"""

from __future__ import annotations

import gzip
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stockroom.llm import common
from stockroom.session import scratch_path

LEAST = 1000
FILE_BYTES = 24 << 20       # payload bytes in one archive, about
FILE_RECORDS = 100_000      # records after which an archive is closed
END = "\r\n\r\n"
MERGED_ROWS = 200_000    # captures merged in one partition
FIRST_DAY = "2024-01-01"
CAPTURE = ("url_key string, ts string, page_id long, record_type string, refers_to long, "
           "payload_bytes long, payload_digest string, archive string, offset long, length long")
FIELDS = [c.split()[0] for c in CAPTURE.split(", ")]


def payload(html: Column) -> Column:
    return F.coalesce(html, F.lit("")).cast("binary")


def url_key(url: Column) -> Column:
    """Host with its labels reversed, then path and query in lower case, without
    scheme, port and fragment: neighbours in this order are neighbours on a site."""
    plain = F.lower(F.regexp_replace(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://|#[^#]*$", ""))
    host = F.regexp_replace(F.regexp_extract(plain, r"^([^/?]*)", 1), r":[0-9]*$", "")
    rest = F.regexp_replace(plain, r"^[^/?]*", "")
    turned = F.array_join(F.reverse(F.split(host, r"\.")), ",")
    return F.when(plain == "", F.lit("")).otherwise(F.concat(turned, F.lit(")"), rest))


def capture_time(page_id: Column) -> Column:
    """The pages carry no time: seconds after a first day, from the page id, in UTC
    whatever the session's zone."""
    at = F.pmod(F.coalesce(page_id, F.lit(0)), F.lit(10 ** 9))
    day = F.date_add(F.lit(FIRST_DAY).cast("date"), F.floor(at / 86400).cast("int")).cast("string")
    clock = [F.lpad(F.pmod(F.floor(at / unit), F.lit(top)).cast("string"), 2, "0")
             for unit, top in ((3600, 24), (60, 60), (1, 60))]
    return F.concat(day, F.lit("T"), F.concat_ws(":", *clock), F.lit("Z"))


def assign(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Pages with digest, bytes, record_type and refers_to.

    The keeper of a payload is a pre-aggregated maximum per digest; only digests
    held more than once are joined back, and that join can split a hot digest's
    pages."""
    d = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    d = (d.withColumn("payload_digest", F.sha1(F.col("html").cast("binary")))
         .withColumn("payload_bytes", F.octet_length("html").cast("long")))
    large = d.where(F.col("payload_bytes") >= least)
    keeper = (large.groupBy(F.col("payload_digest").alias("_d"), F.col("payload_bytes").alias("_b"))
              .agg(F.max("page_id").alias("_keep"), F.count(F.lit(1)).alias("_n"))
              .where((F.col("_n") > 1) & F.col("_keep").isNotNull()).drop("_n"))
    d = d.join(keeper, (F.col("payload_digest") == F.col("_d")) & (F.col("payload_bytes") == F.col("_b")), "left")
    again = F.col("_keep").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_keep"))
    return d.select("page_id", "url", "html", "payload_digest", "payload_bytes",
                    F.when(again, "revisit").otherwise("response").alias("record_type"),
                    F.when(again, F.col("_keep")).alias("refers_to"))


def record(page_id: str = "page_id") -> Column:
    """Header and block of one record; the writer adds the closing blank lines."""
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("-")), F.lit(">"))
    revisit = F.col("record_type") == "revisit"
    block = F.when(revisit, F.lit("")).otherwise(F.col("html"))
    uri = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", " ")
    line = lambda key, v: F.concat(F.lit(key + ": "), v, F.lit("\r\n"))
    return F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", name(F.col(page_id))), line("WARC-Date", capture_time(F.col(page_id))),
        line("WARC-Target-URI", uri), line("X-URL-Key", F.regexp_replace(url_key(F.col("url")), r"[\r\n]", " ")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        line("X-Payload-Length", F.col("payload_bytes").cast("string")),
        F.when(revisit, F.concat(
            line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
            line("WARC-Refers-To", name(F.col("refers_to"))))).otherwise(F.lit("")),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.octet_length(block).cast("string")), F.lit("\r\n"), block)


def write(pages: DataFrame, path: str, least: int = LEAST, file_bytes: int = FILE_BYTES) -> int:
    """Write the archives; returns how many records there are.

    Records are dealt evenly by a hash of their id and of the place they are stored at, so
    that equal pages spread too; the number of files follows the payload bytes, and a file
    is closed early after a bounded number of records."""
    kept = common.stored_rows(common.cut(assign(pages, least), "warc-records"), "warc-rows")
    kept = kept.withColumn("_salt", F.xxhash64("_row.file", "_row.place")).drop("_row")
    n, size = kept.agg(F.count(F.lit(1)), F.sum(F.when(F.col("record_type") == "response", F.col("payload_bytes"))
                                                .otherwise(0) + 600)).first()
    files = max(1, -(-int(size or 0) // file_bytes))
    (kept.repartition(files, F.xxhash64("page_id", "url", "_salt")).select(record().alias("value"))
     .write.mode("overwrite").option("maxRecordsPerFile", FILE_RECORDS).option("lineSep", END).option("compression", "gzip").text(path))
    return n


def parse(data: bytes, archive: str) -> Iterator[tuple]:
    """Index rows of one unpacked archive, with the real digest of every stored payload."""
    import hashlib
    at = 0
    while at < len(data):
        stop = data.index(b"\r\n\r\n", at)
        head = data[at:stop].decode("utf-8").split("\r\n")
        if not head[0].startswith("WARC/"):
            raise ValueError(f"no record at {at} of {archive}")
        h = dict(x.split(": ", 1) for x in head[1:])
        length = int(h["Content-Length"])
        block = data[stop + 4:stop + 4 + length]
        number = lambda v: None if v is None or v[10:-1] == "-" else int(v[10:-1])
        digest, size = h["WARC-Payload-Digest"][5:], int(h["X-Payload-Length"])
        if h["WARC-Type"] == "response":
            digest, size = hashlib.sha1(block).hexdigest(), len(block)
        yield (h["X-URL-Key"], h["WARC-Date"], number(h["WARC-Record-ID"]), h["WARC-Type"],
               number(h.get("WARC-Refers-To")), size, digest, archive, at, stop + 4 + length - at)
        at = stop + 4 + length + len(END)


def order_of(row: tuple) -> tuple:
    return (row[0].encode(), row[1], row[2] is not None, row[2] or 0, row[3])


class LoserTree:
    """k-way merge of sorted runs: inner nodes hold the loser of their match, so the
    next row costs one path of comparisons from its run's leaf to the root."""

    def __init__(self, runs: list[Iterator[tuple]]):
        self.runs = runs
        self.k = max(1, len(runs))
        self.head = [self._next(i) for i in range(len(runs))] or [None]
        self.loser = [-1] * self.k
        for leaf in range(self.k):
            self._play(leaf)

    def _next(self, i: int):
        row = next(self.runs[i], None)
        return None if row is None else (order_of(row), i, row)

    def _before(self, a: int, b: int) -> bool:
        x, y = self.head[a], self.head[b]
        return x is not None and (y is None or x[:2] < y[:2])

    def _play(self, leaf: int) -> None:
        winner, node = leaf, (leaf + self.k) // 2
        while node > 0:
            if self.loser[node] < 0:
                self.loser[node] = winner
                return                      # the other side has not played yet
            if self._before(self.loser[node], winner):
                winner, self.loser[node] = self.loser[node], winner
            node //= 2
        self.loser[0] = winner

    def __iter__(self) -> Iterator[tuple]:
        while self.head[top := self.loser[0]] is not None:
            row = self.head[top][2]
            self.head[top] = self._next(top)
            self._play(top)
            yield row


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """All captures of the archives under ``path``, a locally sorted run per archive."""
    common.python_ready(spark)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for name, content in zip(part["path"], part["content"]):
                short = name.rsplit("/", 1)[-1]
                rows = sorted(parse(gzip.decompress(content), short), key=order_of)
                for i in range(0, len(rows), 10_000):
                    out = pd.DataFrame(rows[i:i + 10_000], columns=FIELDS)
                    yield out.assign(refers_to=out["refers_to"].astype("Int64"),
                                     page_id=out["page_id"].astype("Int64"))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return files.select("path", "content").mapInPandas(run, CAPTURE)


def merged(runs: DataFrame) -> DataFrame:
    """Captures in global order over the partitions, with ``place`` in the partition.

    Captures equal in that order may be split between partitions: where they are archived
    is the last part of the key."""
    # a partition's slices are held while they are merged: their number follows from the rows
    n = max(int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-runs.count() // MERGED_ROWS))
    key = [F.col("url_key").cast("binary"), F.col("ts"), F.col("page_id"), F.col("record_type"),
           F.col("archive"), F.col("offset")]

    def merge(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, list[tuple]] = {}
        for part in parts:
            part = part.astype(object).where(part.notna(), None)
            for row in part.itertuples(index=False, name=None):
                held.setdefault(row[7], []).append(row)
        runs = []
        for rows in held.values():       # a run's slice keeps its order unless blocks arrived anew
            keys = list(map(order_of, rows))
            runs.append(iter(rows if all(a <= b for a, b in zip(keys, keys[1:])) else sorted(rows, key=order_of)))
        out: list[tuple] = []
        place = 0
        for row in LoserTree(runs) if runs else ():
            out.append((*row, place))
            place += 1
            if len(out) == 10_000:
                yield frame(out)
                out = []
        if out:
            yield frame(out)

    def frame(rows: list[tuple]) -> pd.DataFrame:
        f = pd.DataFrame(rows, columns=[*FIELDS, "place"])
        return f.assign(**{c: f[c].astype("Int64") for c in
                           ("page_id", "refers_to", "payload_bytes", "offset", "length")})
    return runs.repartitionByRange(n, *key).mapInPandas(merge, CAPTURE + ", place long")


def archive(pages: DataFrame, path: str | None = None, least: int = LEAST,
            file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write the archives of ``pages``, read them back, return the ordered index."""
    spark = pages.sparkSession
    path = path or scratch_path(spark, "warc")
    if not write(pages, path, least, file_bytes):
        return spark.createDataFrame([], CAPTURE + ", place long")
    return merged(common.cut(read_runs(spark, path), "warc-runs"))
