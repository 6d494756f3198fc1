"""Quality rules with the frequency of lines across a host's documents.

Every line is normalised (lower case, digits as 0, runs of spaces as one,
trimmed) and hashed; per host the documents holding it are counted.  A line is
boilerplate when that count is above ``least`` and above ``share`` of the host's
documents; its words no longer count.  A document left with less than
``remain`` of its words is depleted and rejected, as is one that fails the base
rules.

A document's repeated lines are made one before lines are counted, so the count
of documents is a plain count: it is pre-aggregated before the shuffle, and a
line that stands in a third of all documents arrives as one row per task.  The
texts are read once; what is kept of them is a table of (row, host, counts,
lines as hash and words).  Only lines above the limit are joined back, and that
join has rows of one key that can be split on its large side.  ``clean`` returns
the documents themselves without those lines; ``score`` only the counts.

Defined cases: a null or empty text has no words, fails the base rules and is
rejected; a null host is a host of its own; every row is a document, also where
ids are null or repeat; lines without a word count nowhere and stay in the text;
a null text stays null; ``clean`` keeps the other columns (result columns replace
equal names), ``score`` does not read them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockroom.llm import common

SYMBOLS = "#*$%&|<>"
SPACE_CHARS = " \t\n\x0b\x0c\r"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "removed_words",
          "base_failed", "kept")


def window_hashes(ws: Column, span: int = 8) -> Column:
    """Hashes of all ``span``-word windows, ``span`` a power of two, by doubling:
    neighbours at distance 1, 2, 4 are hashed together."""
    h, width = F.transform(ws, lambda w: F.xxhash64(w)), 1
    while width < span:
        left = F.greatest(F.size(ws) - 2 * width + 1, F.lit(0))
        h = F.zip_with(F.slice(h, 1, left), F.slice(h, width + 1, left),
                       lambda a, b: F.xxhash64(a, b))
        width *= 2
    return h


def repeat_words(hashes: str, ranked: str, span: int = 8) -> Column:
    """Words in windows found twice or more: the union of the windows at places whose
    hash has an equal neighbour in sorted order."""
    s = F.col(ranked)
    at = F.filter(s, lambda x, i: F.coalesce(x["h"] == F.get(s, i - 1)["h"], F.lit(False))
                  | F.coalesce(x["h"] == F.get(s, i + 1)["h"], F.lit(False)))
    places = F.array_sort(F.transform(at, lambda x: x["i"]))
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    return F.when(s.isNull(), 0).otherwise(F.aggregate(places, start, lambda a, p: F.struct(
        (p + span).alias("end"),
        (a["n"] + span - F.greatest(a["end"] - p, F.lit(0))).alias("n")))["n"]).cast("long")


def line_words(lines: Column) -> Column:
    """The words of every line as compared: lower case, digits as 0."""
    flat = F.translate(F.lower(F.array_join(lines, "\n")), "0123456789\t\x0b\x0c\r",
                       "0000000000    ")
    return F.transform(F.split(flat, "\n"), lambda x: F.array_remove(F.split(x, " +"), ""))


def line_hash(ws: Column) -> Column:
    return F.xxhash64(F.array_join(ws, " "))


def measure(docs: DataFrame, text: str, host: str, key: str, place: Column) -> DataFrame:
    """One row per document: a row number, its place, the base counts and the distinct lines."""
    t = F.coalesce(F.col(text), F.lit(""))
    d = docs.select(F.col(key).alias("doc_id"), F.col(host).alias("host"), t.alias("t"), place.alias("place"))
    d = d.withColumn("w", common.words(F.col("t")))
    d = d.withColumn("h", window_hashes(F.col("w")))
    ranked = F.array_sort(F.transform(F.col("h"), lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    d = d.withColumn("s", F.when(F.size(F.array_distinct("h")) < F.size("h"), ranked))
    raw = F.filter(F.split("t", "\n"), lambda x: F.translate(x, SPACE_CHARS, "") != "")
    d = d.withColumn("raw", raw)
    d = d.withColumn("lines", F.when(F.size("raw") > 0, F.transform(
        line_words(F.col("raw")), lambda ws: F.struct(line_hash(ws).alias("h"), F.size(ws).alias("n")))))
    plain = F.length(F.translate(F.col("t"), SPACE_CHARS, ""))
    return d.select(
        F.monotonically_increasing_id().alias("row"), "place", "doc_id", "host",
        F.size("w").cast("long").alias("n_words"), plain.cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate(F.col("t"), SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("raw") - F.size(F.array_distinct("raw"))).cast("long").alias("n_dup_lines"),
        repeat_words("h", "s").alias("n_repeat_words"), "lines")


def judge(docs: DataFrame, least: int, share: float, remain: float, text: str, host: str, key: str,
          place: Column) -> DataFrame:
    """Per row of ``docs``: ``place``, ``doc_id``, ``COUNTS`` and ``gone``, the hashes of its boilerplate lines."""
    rows = common.cut(measure(docs, text, host, key, place), "line-quality")
    seen = rows.select("host", F.explode(F.array_distinct(F.transform("lines", lambda x: x["h"])))
                       .alias("h"))
    sizes = rows.groupBy("host").agg(F.count(F.lit(1)).alias("docs")).withColumnRenamed("host", "_host")
    often = seen.groupBy("host", "h").agg(F.count(F.lit(1)).alias("held")).where(F.col("held") > least)
    often = (often.join(sizes, F.col("host").eqNullSafe(F.col("_host")))
             .where(F.col("held") > F.lit(share) * F.col("docs"))
             .select(F.col("host").alias("_host"), F.col("h").alias("_h")))
    each = rows.select("row", "host", F.explode("lines").alias("x")).select(
        "row", "host", F.col("x.h").alias("h"), F.col("x.n").alias("n"))
    gone = (each.join(often, F.col("host").eqNullSafe(F.col("_host")) & (F.col("h") == F.col("_h")))
            .groupBy(F.col("row").alias("_row")).agg(F.sum("n").alias("removed_words"),
                                                     F.collect_set("h").alias("gone")))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    out = rows.join(gone, F.col("row") == F.col("_row"), "left").withColumn(
        "removed_words", F.coalesce("removed_words", F.lit(0).cast("long")))
    left = F.col("n_words") - F.col("removed_words")
    return (out.withColumn("base_failed", failed)
            .withColumn("kept", ~F.col("base_failed") & (left >= F.lit(remain) * F.col("n_words")))
            .select("place", "doc_id", *COUNTS, "gone"))


def score(docs: DataFrame, least: int = 10, share: float = 0.01, remain: float = 0.3,
          text: str = "text", host: str = "source", key: str = "doc_id") -> DataFrame:
    """Per row of ``docs``: the base counts, ``removed_words``, ``base_failed``, ``kept``."""
    return judge(docs, least, share, remain, text, host, key, F.lit(None).cast("string")).select("doc_id", *COUNTS)


def clean(docs: DataFrame, least: int = 10, share: float = 0.01, remain: float = 0.3,
          text: str = "text", host: str = "source", key: str = "doc_id") -> DataFrame:
    """Every row of ``docs`` with its boilerplate lines taken out of its text, and with
    ``COUNTS`` of the text as it was; rows to reject are those not ``kept``.

    Rows meet their verdict on the place they are stored at, as in ``mixture.emit``.
    """
    stored = common.settled(docs, "line-rows")
    row, found = common.free_name(docs, "row"), common.free_name(docs, "found")
    placed = common.placed(stored, row)
    verdict = judge(placed, least, share, remain, text, host, key, F.col(row)).select(
        F.col("place").alias("of"), F.struct(*COUNTS, "gone").alias("v"))
    met = placed.alias("d").join(verdict.alias("o"), F.col(f"d.{row}") == F.col("o.of")).select(
        *[F.col(f"d.`{c}`") for c in docs.columns], F.col("o.v").alias(found))
    gone, lines = F.col(f"{found}.gone"), F.split(F.col(f"`{text}`"), "\n")
    whole = F.zip_with(lines, line_words(lines), lambda x, ws: F.struct(x.alias("x"), line_hash(ws).alias("h")))
    left = F.transform(F.filter(whole, lambda x: ~F.array_contains(gone, x["h"])), lambda x: x["x"])
    out = common.put(met, **{text: F.when(F.size(gone) > 0, F.array_join(left, "\n")).otherwise(F.col(f"`{text}`"))})
    return common.put(out, **{c: F.col(f"{found}.{c}") for c in COUNTS}).drop(found)
