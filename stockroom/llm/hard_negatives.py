"""Hard negatives from a secondary-sort shuffle.

A row's score is the integer inner product of its vector with the anchor's, after every
component x became floor(256 * x).  Scores of an anchor's rows are packed into (anchor,
descending score, positives first, id) keys, dealt by anchor and sorted within
partitions (``repartition`` and ``sortWithinPartitions``, the DataFrame form of
repartitionAndSortWithinPartitions).  One iterator then streams over them: a positive
opens a window from its score down to ``low`` percent of it, a negative goes to every
open window, and a window closes when it is full or the scores have fallen below it.
It holds the open windows of one anchor, never the anchor's rows.

The anchors are a stated query set against all rows: both sides are packed into blocks
of bounded size, the rows' blocks are dealt to parts of bounded bytes, and a copy of the
anchors' blocks is shuffled to every part.  Nothing is broadcast, so the driver holds
neither anchors nor rows.  A task holds the rows of one part and meets one block of
anchors after the other with all of them in matrix products.  Only rows that can matter
are shuffled on, per anchor and part: first the part's best positives; then, with an
anchor's positives known, the first negatives the part has in each of their windows.
Both are merged exactly; no row is left out of a product.

Defined cases: rows with a null id, label or vector, or a null or non-finite component
take no part; ties in score go to the smaller id; an anchor's own id is neither its
positive nor its negative; repeated rows count as often as they are stored, as anchors
too; vectors of different length never meet; components beyond a long are cut to it and
sums of products wrap like a long's; a negative positive score admits nothing; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stockroom.llm import common

BLOCK = 1 << 10         # rows in one block
ANCHORS = 1 << 8        # anchors in one block
PART = 32 << 20         # bytes of components that one copy of the anchors is sent to, about
AT_ONCE = 1 << 20       # scores of rows with anchors that are held at once
STEP = 1 << 13          # rows of them, at most
SCALE = 256.0
EXACT = (("<f4", float(1 << 24)), ("<f8", float(1 << 53)))     # floats are exact integers up to here
LEAST, MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max

FIELDS = ["dim", "n", "keys", "ids", "labels", "vals"]
PACKED = "dim int, n int, keys binary, ids binary, labels array<string>, vals binary"
HITS = "anchor long, anchor_id long, score long, id long"


def usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(fine, F.lit(False))


def whole_numbers(vectors: np.ndarray) -> np.ndarray:
    """floor(256 * x) in the smallest signed type that holds the block."""
    x = np.floor(vectors.astype(np.float64) * SCALE)
    edge = np.abs(x).max(initial=0)
    for kind, top in (("<i2", 2.0 ** 15), ("<i4", 2.0 ** 31), ("<i8", 2.0 ** 62)):
        if edge < top:
            return x.astype(kind)
    out = np.where(x < 0, np.iinfo(np.int64).min, np.iinfo(np.int64).max)
    fits = (x > -2.0 ** 63) & (x < 2.0 ** 63)
    out[fits] = x[fits].astype(np.int64)
    return out.astype("<i8")


def packer(size: int):
    """Rows (key, id, label, vector) -> blocks of at most ``size`` rows of one length."""
    def block(dim: int, rows: list[tuple]) -> tuple:
        keys, ids, labels, vectors = zip(*rows)
        vals = whole_numbers(np.array(vectors, np.float64).reshape(len(rows), dim))
        return (dim, len(rows), np.array(keys, "<i8").tobytes(), np.array(ids, "<i8").tobytes(),
                list(labels), vals.tobytes())

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list[tuple]] = {}
        for part in parts:
            full = []
            for row in part[["key", "id", "label", "vector"]].itertuples(index=False):
                rows = held.setdefault(len(row.vector), [])
                rows.append(tuple(row))
                if len(rows) == size:
                    full.append(block(len(row.vector), rows))
                    held[len(row.vector)] = []
            if full:
                yield pd.DataFrame(full, columns=FIELDS)
        for dim, rows in held.items():
            if rows:
                yield pd.DataFrame([block(dim, rows)], columns=FIELDS)
    return run


class Block:
    """A packed block as arrays."""

    def __init__(self, dim: int, n: int, keys: bytes, ids: bytes, labels, vals: bytes):
        self.keys, self.ids = np.frombuffer(keys, "<i8"), np.frombuffer(ids, "<i8")
        self.labels = list(labels)
        width = len(vals) // (dim * n) if dim else 2
        self.vals = np.frombuffer(vals, f"<i{width}").reshape(n, dim)
        self.norms = np.sqrt(np.square(self.vals, dtype=np.float64).sum(axis=1))

    def scores(self, rows: Block | Part, mine=slice(None), theirs=slice(None)) -> np.ndarray:
        """Every inner product, as whole numbers: through floats where these are exact.
        No sum of some of the products is larger than the product of both norms."""
        edge = self.norms[mine].max(initial=0) * rows.norms[theirs].max(initial=0) * (1 + 1e-6)
        kind = next((k for k, top in EXACT if edge < top), "<i8")
        return self.vals[mine].astype(kind) @ rows.vals[theirs].astype(kind).T


class Part:
    """Blocks of rows of one length as one table, by label and id."""

    def __init__(self, blocks: list[Block]):
        codes, kinds = pd.factorize(np.array([x for b in blocks for x in b.labels], object))
        ids = np.concatenate([b.ids for b in blocks])
        order = np.lexsort((ids, codes))
        self.ids, self.codes = ids[order], codes[order]
        self.vals = np.concatenate([b.vals for b in blocks])[order]
        self.norms = np.concatenate([b.norms for b in blocks])[order]
        edges = np.searchsorted(self.codes, np.arange(len(kinds) + 1))
        self.code_of = {k: i for i, k in enumerate(kinds)}
        self.span_of = {k: (edges[i], edges[i + 1]) for i, k in enumerate(kinds)}


def steps(begin: int, end: int, most: int) -> Iterator[slice]:
    """The places from begin to end: few at first, as the first ones bound the others."""
    size = max(1, min(most, 64))
    while begin < end:
        yield slice(begin, min(begin + size, end))
        begin, size = begin + size, max(1, min(most, 8 * size))


def foremost(anchors: Block, mine: np.ndarray, part: Part, span: tuple[int, int], lower: np.ndarray,
             upper: np.ndarray, n: int, others: bool, at_once: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per anchor (of the places ``mine``) and window of scores (a column of ``lower`` and
    ``upper``) the first n rows of the span by descending score, then id, but rows with the
    anchor's id and, with ``others``, its label: places of anchors, scores, ids.

    A window's nth score so far becomes its lower bound, so few scores of later rows are
    looked at twice.
    """
    own = anchors.ids[mine]
    code = np.array([part.code_of.get(anchors.labels[i], -1) for i in mine])
    lower, open_ = lower.copy(), lower <= upper
    high = np.where(open_, upper, LEAST).max(axis=1)
    who, score, ids = (np.zeros(0, np.int64) for _ in range(3))
    for at in steps(*span, min(at_once // len(mine), STEP)):
        table = anchors.scores(part, mine, at)
        low = np.where(open_, lower, MOST).min(axis=1).astype(table.dtype)
        i, j = np.divmod(np.flatnonzero(table >= low[:, None]), table.shape[1])
        fine = (table[i, j] <= high.astype(table.dtype)[i]) & (part.ids[at][j] != own[i])
        if others:
            fine &= part.codes[at][j] != code[i]
        i, j = i[fine], j[fine]
        if not len(i):
            continue
        who, score = np.r_[who, i], np.r_[score, table[i, j].astype(np.int64)]
        ids = np.r_[ids, part.ids[at][j]]
        order = np.lexsort((ids, ~score, who))
        who, score, ids = who[order], score[order], ids[order]
        begin = np.searchsorted(who, np.arange(len(mine)))
        keep = np.zeros(len(who), bool)
        for w in range(lower.shape[1]):
            within = (score >= lower[who, w]) & (score <= upper[who, w])
            count = np.r_[0, np.cumsum(within)]
            rank = count[1:] - count[begin][who]
            keep |= within & (rank <= n)
            last = within & (rank == n)
            lower[who[last], w] = score[last]
        who, score, ids = who[keep], score[keep], ids[keep]
    return mine[who], score, ids


def floor_of(score: int, low: int, high: int) -> int:
    """The least integer s with low * score <= high * s."""
    return -((-low * score) // high)


def dealt(number: Column, parts: int) -> Column:
    """The part of a numbered block: a task's blocks lie in successive parts, and each task
    begins elsewhere."""
    task = F.shiftrightunsigned(number, 33)
    begin = F.floor(F.pmod(task * F.lit(0.6180339887498949), F.lit(1.0)) * parts)
    return F.pmod(begin + number.bitwiseAND((1 << 33) - 1), F.lit(parts)).cast("int")


def meet(anchors: DataFrame, rows: DataFrame, parts: int, chosen) -> DataFrame:
    """Every block of anchors with all rows of the same length, part by part; ``chosen``
    gives, per block of anchors and part, the places of anchors, scores and ids to keep.

    The copies of the anchors are shuffled beside the rows.  As a join their size would be
    guessed from the anchors' file before the copying, and a table of many times that size
    broadcast through the driver.
    """
    windows = "windows" if "windows" in anchors.columns else "cast(null as array<array<long>>) as windows"
    copies = anchors.selectExpr(f"explode(sequence(0, {parts - 1})) as part", "1 as side", *FIELDS, windows)
    held = rows.selectExpr("part", "0 as side", *FIELDS, "cast(null as array<array<long>>) as windows")
    both = held.union(copies).repartitionById(parts, "part").sortWithinPartitions("part", "dim", "side")
    names = [c.strip().split(" ")[0] for c in HITS.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, blocks, part = None, [], None
        for batch in batches:
            for r in batch.to_dict("records"):
                if at != (r["part"], r["dim"]):
                    at, blocks, part = (r["part"], r["dim"]), [], None
                block = Block(*[r[f] for f in FIELDS])
                if r["side"] == 0:
                    blocks.append(block)
                    continue
                if blocks:
                    blocks, part = [], Part(blocks)
                if part is not None:
                    who, score, ids = chosen(block, part, r["windows"])
                    yield pd.DataFrame(dict(zip(names, (block.keys[who], block.ids[who], score, ids))))
    return both.mapInPandas(run, HITS)


def best(positives: int, at_once: int):
    """The first rows of an anchor's label."""
    def chosen(block: Block, part: Part, _) -> tuple[np.ndarray, ...]:
        labels = np.array(block.labels, object)
        found = [(np.zeros(0, np.int64),) * 3]
        for label in set(block.labels) & set(part.span_of):
            mine = np.flatnonzero(labels == label)
            every = np.full((len(mine), 1), LEAST), np.full((len(mine), 1), MOST)
            found.append(foremost(block, mine, part, part.span_of[label], *every, positives, False, at_once))
        return tuple(map(np.concatenate, zip(*found)))
    return chosen


def inside(negatives: int, low: int, high: int, at_once: int):
    """The first rows of other labels in each window below an anchor's positives."""
    def chosen(block: Block, part: Part, windows) -> tuple[np.ndarray, ...]:
        scores = [set(map(int, x)) for x in windows]
        upper = np.full((len(scores), max(map(len, scores))), LEAST)
        lower = np.full_like(upper, MOST)
        for i, x in enumerate(scores):
            for w, s in enumerate(x):
                if floor_of(s, low, high) <= s:
                    lower[i, w], upper[i, w] = max(floor_of(s, low, high), LEAST), s
        every = np.arange(len(scores))
        return foremost(block, every, part, (0, len(part.ids)), lower, upper, negatives, True, at_once)
    return chosen


def mine(vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 5, low: int = 80,
         high: int = 100, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows whose id is divisible by ``every``; their positives the first
    ``positives`` other rows of their label; per positive the first ``negatives`` rows of
    another label whose score lies between ``low`` / ``high`` of its score and its score.
    """
    spark = vectors.sparkSession
    common.python_ready(spark)
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(label).cast("string").alias("label"),
                          F.col(vector).cast("array<double>").alias("vector"))
    fine = F.col("id").isNotNull() & F.col("label").isNotNull() & usable(F.col("vector"))
    anchors = common.cut(rows.where(F.col("id") % every == 0).where(fine)      # vectors of few rows are looked at
                         .select(F.monotonically_increasing_id().alias("key"), "id", "label", "vector"), "mined-anchors")
    packed = rows.where(fine).select(F.lit(0).cast("long").alias("key"), "id", "label", "vector").mapInPandas(
        packer(BLOCK), PACKED)
    packed = common.cut(packed.withColumn("number", F.monotonically_increasing_id()), "mined-rows")
    blocks, n, size = packed.agg(F.count("n"), F.sum("n"), F.sum(F.length("vals"))).first()
    # a part per task, unless the copies of the anchors came to over a quarter of the rows
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    copies = max((n or 0) // max(1, 4 * anchors.count()), 2 * spark.sparkContext.defaultParallelism)
    parts = max(1, -(-(size or 0) // PART), min(tasks, blocks, copies))
    placed = packed.withColumn("part", dealt(F.col("number"), parts))

    asked = anchors.mapInPandas(packer(ANCHORS), PACKED)
    found = meet(asked, placed, parts, best(positives, AT_ONCE))
    w = W.partitionBy("anchor").orderBy(F.desc("score"), "id")
    found = common.cut(found.withColumn("r", F.row_number().over(w)).where(F.col("r") <= positives).drop("r"),
                       "mined-positives")

    # at most ``positives`` distinct scores an anchor, sent along with its block
    known = found.groupBy(F.col("anchor").alias("key")).agg(F.collect_set("score").alias("windows"))

    def with_windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, group in batch.groupby(batch["vector"].map(len)):
                for i in range(0, len(group), ANCHORS):
                    held = group.iloc[i:i + ANCHORS]
                    for block in packer(ANCHORS)(iter([held])):
                        yield block.assign(windows=[[list(x) for x in held["windows"]]])

    opened = anchors.join(known.hint("merge"), "key")
    opened = opened.mapInPandas(with_windows, PACKED + ", windows array<array<long>>")
    near = meet(opened, placed, parts, inside(negatives, low, high, AT_ONCE))
    keyed = found.withColumn("kind", F.lit(0)).union(near.withColumn("kind", F.lit(1)))
    keyed = keyed.withColumn("drop", F.bitwise_not("score"))      # ascending where scores descend
    sorted_keys = keyed.repartition(tasks, "anchor").sortWithinPartitions("anchor", "drop", "kind", "id")
    return sorted_keys.mapInPandas(stream(negatives, low, high),
                                   "anchor_id long, positive_id long, rank int, negative_id long, "
                                   "positive_score long, negative_score long")


def stream(negatives: int, low: int, high: int):
    """Sorted keys -> mined rows, one pass, holding the open windows of one anchor."""
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        anchor, open_ = None, []
        for batch in batches:
            out = []
            for key, own, score, kind, row in batch[["anchor", "anchor_id", "score", "kind", "id"]].itertuples(
                    index=False):
                if key != anchor:
                    anchor, open_ = key, []
                if kind == 0:
                    open_.append([row, score, floor_of(score, low, high), 0])
                    continue
                open_ = [x for x in open_ if x[2] <= score and x[3] < negatives]
                for x in open_:
                    x[3] += 1
                    out.append((own, x[0], x[3], row, x[1], score))
            yield pd.DataFrame(out, columns=names)
    return run
