"""Exact top-k search over binary codes by incremental multi-index hashing.

Vectors become 64-bit codes (one sign bit per projected direction).  A code is
cut into m segments, as many as the measured number of codes n calls for: segments of
about log2(n) - 2 bits, so that a value of a segment is held by a few codes.  If
a code has been probed in every segment within radius r, all codes at Hamming distance
up to m * (r + 1) - 1 have been seen: a code further than r in every segment differs in
at least m * (r + 1) bits.  Radii grow until a query's kth verified distance is
covered by that bound, so the result is exact; every query is answered by the index.

The probes of radius r + 1 are made from those of radius r, each by flipping one more
bit behind its last one, on the executors and for the queries still open only.  A
segment has no more than about n values, which bounds the probes of a query.

Equal codes are one entry with its k smallest ids (all that ties by id can
use), so a group of copies costs one probe.

Defined cases: a vector that is null, empty or holds a null or NaN has no code
and neither asks nor is found; ties in distance go to the smaller id; a query
finds itself like any other; fewer than k codes give fewer rows; repeated rows
with one id count as separate entries with that id; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stockroom.llm import common

BITS = 64


def directions(dim: int, seed: int = 5) -> np.ndarray:
    """dim x 64: the axes themselves for 64 dimensions, else random directions."""
    if dim == BITS:
        return np.eye(BITS, dtype=np.float32)
    return np.random.default_rng([seed, dim]).normal(size=(dim, BITS)).astype(np.float32)


def codes(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", seed: int = 5) -> DataFrame:
    """(id, code): bit b is set where the vector's product with direction b is positive."""
    common.python_ready(vectors.sparkSession)

    @F.pandas_udf("long")
    def signs(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        kept: dict[int, np.ndarray] = {}
        for part in parts:
            out: list[int | None] = []
            for v in part:
                x = None if v is None else np.asarray(v, np.float64)
                if x is None or not len(x) or not np.isfinite(x).all():
                    out.append(None)
                    continue
                if len(x) not in kept:
                    kept[len(x)] = directions(len(x), seed)
                bits = (x @ kept[len(x)]) > 0
                out.append(int(np.packbits(bits).view(">i8")[0]))
            yield pd.Series(out, dtype="Int64")
    return (vectors.select(F.col(key).alias("id"), signs(F.col(vector)).alias("code"))
            .where(F.col("code").isNotNull() & F.col("id").isNotNull()))


def segment_count(n_codes: int) -> int:
    """How many segments suit so many codes."""
    return max(1, min(BITS, round(BITS / max(1.0, math.log2(max(2, n_codes)) - 2))))


def segments(m: int, bits: int = BITS) -> list[tuple[int, int]]:
    """(first bit, width) of each of m segments, as even as can be."""
    edges = [round(i * bits / m) for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def ceilings(queries: DataFrame, sized: DataFrame, k: int, sample: int) -> DataFrame:
    """(code, most): an upper bound of each query's kth distance, its kth distance
    within a bounded sample of the codes.  Candidates beyond it need not be kept."""
    some = [r[0] for r in sized.select("code").orderBy(F.xxhash64("code"), "code").limit(sample).collect()]
    codes = np.array(some, np.int64)

    @F.pandas_udf("int")
    def kth(part: pd.Series) -> pd.Series:
        if len(codes) < k:
            return pd.Series(np.full(len(part), BITS, np.int32))
        return pd.Series([int(np.partition(np.bitwise_count((codes ^ q).view(np.uint64)), k - 1)[k - 1])
                          for q in part.to_numpy(np.int64)], dtype="int32")
    return queries.select("code", kth("code").alias("most"))


def with_segments(df: DataFrame, cuts: list[tuple[int, int]]) -> DataFrame:
    """One row per segment: seg, val."""
    values = F.array(*[F.struct(F.lit(s).alias("seg"),
                                F.shiftrightunsigned("code", a).bitwiseAND(F.lit((1 << w) - 1)).alias("val"))
                       for s, (a, w) in enumerate(cuts)])
    return df.withColumn("_x", F.explode(values)).select(*df.columns, "_x.seg", "_x.val")


def flipped(probes: DataFrame, cuts: list[tuple[int, int]]) -> DataFrame:
    """The probes of the next radius: one more bit flipped, behind the last one (``at``)."""
    width = F.element_at(F.array(*[F.lit(w) for _, w in cuts]), F.col("seg") + 1)
    behind = F.when(F.col("at") + 1 < width, F.sequence(F.col("at") + 1, width - 1))
    return probes.withColumn("at", F.explode(behind)).withColumn(
        "val", F.col("val").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("at"))))


def smallest(df: DataFrame, by: list[str], order: list[str], k: int) -> DataFrame:
    """The first k rows per key; Spark limits each task's groups before the shuffle."""
    w = W.partitionBy(*by).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k)


def top_k(vectors: DataFrame, k: int = 10, every: int = 100, key: str = "vec_id",
          vector: str = "embedding", seed: int = 5, parts: int | None = None, sample: int = 2048) -> DataFrame:
    """(query_id, rank, neighbor_id, distance): the k nearest of every row whose id is
    divisible by ``every``.

    ``parts``: segments of a code, by default from the measured number of codes.
    ``sample``: codes that give the first bound of a query's kth distance.  The result
    depends on neither.
    """
    spark = vectors.sparkSession
    coded = common.cut(codes(vectors, key, vector, seed), "mih-codes")
    # the k smallest ids of every code
    kept = smallest(coded, ["code"], ["id"], k)
    index = common.cut(kept.groupBy("code").agg(F.array_sort(F.collect_list("id")).alias("ids")),
                       "mih-index")
    cuts = segments(parts or segment_count(index.count()))
    # of equal distances the code with the smaller first id comes first: a code behind
    # k others has k ids before its own
    sized = index.select("code", F.element_at("ids", 1).alias("lo"), F.size("ids").alias("n"))
    entries = common.cut(with_segments(sized, cuts), "mih-entries").withColumnsRenamed({"seg": "_seg", "val": "_val"})
    asked = coded.where(F.col("id") % every == 0).select("code").distinct()
    open_q, found, done, last = common.cut(ceilings(asked, sized, k, sample), "mih-queries"), None, None, max(w for _, w in cuts)
    probes = with_segments(open_q.select("code"), cuts).select(F.col("code").alias("q"), "seg", "val", F.lit(-1).alias("at"))
    for r in range(last + 1):
        probes = common.cut(probes, "mih-probes")
        far = F.bit_count(F.col("q").bitwiseXOR(F.col("code")))
        met = (F.col("seg") == F.col("_seg")) & (F.col("val") == F.col("_val")) & (far <= F.col("most"))
        wanted = probes.join(open_q.select(F.col("code").alias("_q"), "most"), F.col("q") == F.col("_q"))
        hits = wanted.join(entries, met).select("q", "code", "lo", "n", far.alias("d"))
        pool = (hits if found is None else hits.union(found)).distinct()
        best = common.cut(smallest(pool, ["q"], ["d", "lo", "code"], k).drop("_r"), "mih-best")
        upto = W.partitionBy("q").orderBy("d").rangeBetween(W.unboundedPreceding, 0)
        reach = common.cut(best.withColumn("have", F.sum("n").over(upto)).where(F.col("have") >= k)
                           .groupBy(F.col("q").alias("_q")).agg(F.min("d").alias("kth")), "mih-kth")
        # once whole segments have been flipped, every code has been seen
        covered = F.lit(r == last) | (F.coalesce("kth", F.lit(BITS)) <= len(cuts) * (r + 1) - 1)
        state = common.cut(open_q.join(reach, F.col("code") == F.col("_q"), "left").select(
            "code", F.least("most", F.coalesce("kth", "most")).alias("most"), covered.alias("covered")), "mih-open")
        ended, open_q = state.where("covered"), state.where(~F.col("covered")).drop("covered")
        mine = best.join(ended.select(F.col("code").alias("_q")), F.col("q") == F.col("_q"), "left_semi").select("q", "code", "d")
        done = mine if done is None else done.union(mine)
        if open_q.isEmpty():
            break
        still = open_q.select(F.col("code").alias("_q"))
        found = best.join(still, F.col("q") == F.col("_q"), "left_semi").select(*hits.columns)
        probes = flipped(probes.join(still, F.col("q") == F.col("_q"), "left_semi"), cuts)
    # codes to ids, k per query code; then to the queries' own ids
    rows = done.join(index, "code").select("q", "d", F.explode("ids").alias("neighbor_id"))
    ranked = smallest(rows, ["q"], ["d", "neighbor_id"], k)
    asked = coded.where(F.col("id") % every == 0).select(F.col("id").alias("query_id"),
                                                         F.col("code").alias("q"))
    return asked.join(ranked, "q").select("query_id", F.col("_r").cast("int").alias("rank"),
                                          "neighbor_id", F.col("d").cast("int").alias("distance"))
