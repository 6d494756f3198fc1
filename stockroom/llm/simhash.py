"""SimHash near-duplicates by anchor-point covering.

Fingerprints are cut into ``BLOCKS`` blocks.  Two fingerprints at distance at
most ``max_bits`` differ in at most t = max_bits // BLOCKS bits of some block.
Each block has a covering code as its anchors: the Hamming [15, 11] code on its
first 15 bits and all words on the rest, with covering radius 1.  A block's
value is replicated to every anchor within 1 + t, found from its syndrome; the
anchor that covers one of two linked values is therefore an anchor of the other
too, and comparing fingerprints per anchor finds every link.

Per anchor only a spanning forest of the links is emitted, never all pairs.  An
anchor's members are dealt into home groups of bounded size, and each group
meets all members of the anchor (see ``link``), so no task holds an unbounded
group.  Equal fingerprints are one node from the start.  Components come from
alternating star contractions on the distinct fingerprints, with a written
table after each round.

Defined cases: a null or empty text has fingerprint zero and is linked like any
other; texts of fewer words than a shingle use the whole sequence; rows of one
id get the fingerprint of their own text; null ids are kept, and a component's
id is the smallest non-null one; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockroom.llm import common

BITS = 64
BLOCKS = ((0, 21), (21, 21), (42, 22))      # first bit, width
COVERED = 15                                # bits of a block under the Hamming code
SEED = 42
HOME = 1024         # members of an anchor that one home group holds
SLICE = 1 << 16     # rows that a worker compares at a time, about
SHINGLES = 65536    # shingles hashed at once
LOWER = {c: c + 32 for c in range(65, 91)}


def fingerprint(text: str | None, shingle: int, find=regex.compile("[^\\x20\\x09-\\x0D]+").findall) -> int:
    """Bit b is set if it is set in over half the shingles' hashes."""
    words = find((text or "").translate(LOWER))
    if not words:
        return 0
    raw = [w.encode("utf-8", "replace") for w in words]
    line = b" ".join(raw)
    ends = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    k = min(shingle, len(raw))
    a, z = starts[:len(raw) - k + 1].tolist(), ends[k - 1:].tolist()
    digest, total = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for i in range(0, len(a), SHINGLES):
        h = np.fromiter((digest(line[x:y], SEED) for x, y in
                         zip(a[i:i + SHINGLES], z[i:i + SHINGLES])), np.uint64)
        total += bit_counts(h)
    return int(np.packbits(2 * total > len(a)).view(">u8")[0])


def bit_counts(h: np.ndarray) -> np.ndarray:
    """How often each bit is set, the highest bit first: bits are summed per byte value."""
    octets = h.astype(">u8").view(np.uint8).reshape(-1, 8)
    out = np.empty((8, 8), np.int64)
    for j in range(8):
        out[j] = np.bincount(octets[:, j], minlength=256) @ _BYTE_BITS
    return out.ravel()


_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def fingerprints(docs: DataFrame, shingle: int = 4, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long."""
    common.python_ready(docs.sparkSession)

    @F.pandas_udf("long")
    def hashed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            got = np.fromiter((fingerprint(t, shingle) for t in texts), np.uint64, len(texts))
            yield pd.Series(got.view(np.int64))
    return docs.select(F.col(key).alias("doc_id"), hashed(F.col(text)).alias("fp"))


def syndrome(values: np.ndarray) -> np.ndarray:
    """Hamming syndrome of the first 15 bits: the xor of the places (1..15) of set bits."""
    out = np.zeros(len(values), np.int64)
    for i in range(COVERED):
        out ^= np.where((values >> i) & 1, i + 1, 0)
    return out


def offsets(width: int, within: int) -> list[np.ndarray]:
    """Per syndrome, all bit masks of weight up to ``within`` that lead from a value
    with that syndrome to an anchor."""
    by: list[list[int]] = [[] for _ in range(COVERED + 1)]
    for weight in range(within + 1):
        for places in combinations(range(width), weight):
            s = 0
            for p in places:
                s ^= p + 1 if p < COVERED else 0
            by[s].append(sum(1 << p for p in places))
    return [np.array(m, np.int64) for m in by]


def anchors(values: np.ndarray, width: int, within: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor) for all anchors within the radius of each value."""
    table = offsets(width, within)
    s = syndrome(values)
    rows, found = [], []
    for k, masks in enumerate(table):
        at = np.flatnonzero(s == k)
        rows.append(np.repeat(at, len(masks)))
        found.append((values[at][:, None] ^ masks[None, :]).ravel())
    return np.concatenate(rows), np.concatenate(found)


def replicated(distinct: DataFrame, max_bits: int) -> DataFrame:
    """(anchor, fp, home): each fingerprint at every anchor in reach; ``home`` where
    the anchor is the one that covers it (distance at most 1)."""
    allowed = max_bits // len(BLOCKS)

    def spread(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            fps = part["fp"].to_numpy(np.int64).view(np.uint64)
            for n, (first, width) in enumerate(BLOCKS):
                block = ((fps >> np.uint64(first)) & np.uint64((1 << width) - 1)).astype(np.int64)
                for i in range(0, len(block), 4096):
                    v = block[i:i + 4096]
                    rows, at = anchors(v, width, 1 + allowed)
                    own = v ^ np.where((s := syndrome(v)) > 0, 1 << np.maximum(s - 1, 0), 0)
                    yield pd.DataFrame({"anchor": at * len(BLOCKS) + n,
                                        "fp": fps[i:i + 4096].view(np.int64)[rows],
                                        "home": at == own[rows]})
    return distinct.mapInPandas(spread, "anchor long, fp long, home boolean")


def forest(fps: np.ndarray, home: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the links between home members and all members.

    A search from each home member in turn compares it with members not reached
    yet; a reached member is never compared again, and guests meet only the home
    members still waiting.  Dense groups end after a few steps.
    """
    waiting = np.argsort(~home, kind="stable")         # home members first
    left, right = [], []
    while len(waiting) and home[waiting[0]]:
        queue, waiting = [waiting[0]], waiting[1:]
        while queue and len(waiting):
            x = queue.pop()
            n = len(waiting) if home[x] else int(home[waiting].sum())
            near = np.bitwise_count(fps[waiting[:n]] ^ fps[x]) <= max_bits
            got = waiting[:n][near]
            if len(got):
                left.append(np.full(len(got), x))
                right.append(got)
                queue += got.tolist()
                waiting = np.concatenate([waiting[:n][~near], waiting[n:]])
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(left), np.concatenate(right)


def small_links(anchor: np.ndarray, fps: np.ndarray, home: np.ndarray,
                max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of many small anchors at once (rows sorted by anchor)."""
    heads = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
    sizes = np.diff(np.r_[heads, len(anchor)])
    of = np.repeat(np.arange(len(heads)), sizes)
    mine = np.flatnonzero(home)
    left, right, i = [], [], 0
    work = np.cumsum(sizes[of[mine]]) if len(mine) else np.zeros(0, np.int64)
    while i < len(mine):
        j = max(i + 1, int(np.searchsorted(work, (work[i - 1] if i else 0) + 500_000)))
        rows = mine[i:j]
        n = sizes[of[rows]]
        a = np.repeat(rows, n)
        b = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(heads[of[rows]], n)
        near = (np.bitwise_count(fps[a] ^ fps[b]) <= max_bits) & (a != b)
        left.append(a[near])
        right.append(b[near])
        i = j
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(left), np.concatenate(right)


def linked(members: pd.DataFrame, max_bits: int) -> pd.DataFrame:
    """Spanning edges of one or more groups of members."""
    m = members.sort_values("anchor", kind="stable")
    anchor = m["anchor"].to_numpy(np.int64)
    fps, home = m["fp"].to_numpy(np.int64).view(np.uint64), m["home"].to_numpy(bool)
    heads = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
    stops = np.r_[heads[1:], len(anchor)]
    small = stops - heads <= 256
    row_small = np.repeat(small, stops - heads)
    pairs = []
    if row_small.any():
        a, b = small_links(anchor[row_small], fps[row_small], home[row_small], max_bits)
        f = fps[row_small]
        pairs.append((f[a], f[b]))
    for lo, hi in zip(heads[~small], stops[~small]):
        a, b = forest(fps[lo:hi], home[lo:hi], max_bits)
        f = fps[lo:hi]
        pairs.append((f[a], f[b]))
    x = np.concatenate([p[0] for p in pairs]).view(np.int64) if pairs else np.zeros(0, np.int64)
    y = np.concatenate([p[1] for p in pairs]).view(np.int64) if pairs else np.zeros(0, np.int64)
    out = pd.DataFrame({"a": np.minimum(x, y), "b": np.maximum(x, y)})
    return out[out["a"] != out["b"]].drop_duplicates()


def sliced(parts: Iterator[pd.DataFrame], most: int) -> Iterator[pd.DataFrame]:
    """Groups (anchor, part), their home members first, in frames of about ``most`` rows; a
    group that goes on meets its home members again in every further frame."""
    held, n = [], 0

    def whole() -> pd.DataFrame:
        rows = pd.concat(held, ignore_index=True)
        key = rows[["anchor", "part"]].to_numpy()
        new = np.r_[True, (key[1:] != key[:-1]).any(axis=1)]
        return rows.assign(group=np.cumsum(new))

    def frame(rows: pd.DataFrame) -> pd.DataFrame:
        return rows[["group", "fp", "home"]].rename(columns={"group": "anchor"})
    for part in parts:
        held.append(part)
        n += len(part)
        if n >= most:
            rows = whole()
            yield frame(rows)
            last = rows[(rows["group"] == rows["group"].iloc[-1]) & rows["home"]]
            # the last group may go on: its home members stay, and do not count as new rows
            held, n = [last[["anchor", "part", "fp", "home"]]], 0
    if n:
        yield frame(whole())


def links(distinct: DataFrame, max_bits: int = 4) -> DataFrame:
    """(a, b): spanning edges among distinct fingerprints, a < b.

    Anchors with more than ``HOME`` home members are split: each of their home
    members goes to one of several groups by its hash, every member is a guest
    of all groups of the anchor.  A group's home members are thereby bounded; its
    guests may be many, so they pass by in slices and a worker holds one of them.
    """
    spark = distinct.sparkSession
    spread = common.cut(replicated(distinct, max_bits), "simhash-anchors")
    crowded = (spread.where("home").groupBy(F.col("anchor").alias("_a"))
               .agg(F.ceil(F.count(F.lit(1)) / HOME).cast("int").alias("_n")).where(F.col("_n") > 1))
    parts = F.coalesce(F.col("_n"), F.lit(1))
    dealt = (spread.join(crowded, F.col("anchor") == F.col("_a"), "left")
             .select("anchor", "fp", "home", F.pmod(F.xxhash64("fp"), parts).cast("int").alias("own"),
                     F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
             .select("anchor", "part", "fp",
                     (F.col("home") & (F.col("own") == F.col("part"))).alias("home")))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(n, "anchor", "part").sortWithinPartitions("anchor", "part", F.desc("home"))
    most = SLICE

    def compare(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in sliced(parts, most):
            yield linked(rows, max_bits)

    found = dealt.mapInPandas(compare, "a long, b long")
    return found.groupBy("a", "b").agg(F.lit(1).alias("_x")).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an edge, root the smallest fingerprint reached.

    Alternating stars: a large star links every larger neighbour of a node to the
    smallest of its neighbourhood, a small star does so for the smaller ones,
    until nothing changes.  Minima are pre-aggregated, so a hub's neighbours are
    never gathered.
    """
    now = common.cut(edges.select("a", "b"), "star")
    state = None
    while True:
        now = common.cut(star(star(now, large=True), large=False), "star")
        # a sum over hashes tells whether the edge set has changed
        new = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if new == state:
            break
        state = new
    return now.select(F.col("b").alias("node"), F.col("a").alias("root"))


def star(edges: DataFrame, large: bool) -> DataFrame:
    """One contraction; edges (a, b) have a < b."""
    both = (edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
            .union(edges.select(F.col("b").alias("u"), F.col("a").alias("v"))))
    if not large:
        both = edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    low = both.groupBy(F.col("u").alias("c")).agg(F.min("v").alias("m"))
    low = low.select("c", F.least("c", "m").alias("m"))
    met = both.join(low, F.col("u") == F.col("c"))
    if large:
        out = met.where(F.col("v") > F.col("u")).select(F.col("m").alias("a"), F.col("v").alias("b"))
    else:
        out = (met.select(F.col("m").alias("a"), F.col("v").alias("b"))
               .union(low.select(F.col("m").alias("a"), F.col("c").alias("b"))))
    return out.where(F.col("a") < F.col("b")).distinct()


def near_duplicates(docs: DataFrame, shingle: int = 4, max_bits: int = 4, text: str = "text",
                    key: str = "doc_id") -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``."""
    prints = common.cut(fingerprints(docs, shingle, text, key), "simhash-prints")
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    found = components(links(distinct.select("fp"), max_bits))
    node = distinct.join(found, F.col("fp") == F.col("node"), "left").select(
        F.col("fp").alias("_fp"), "first", F.coalesce("root", "fp").alias("root"))
    low = node.groupBy(F.col("root").alias("_root")).agg(F.min("first").alias("component_id"))
    named = node.join(low, F.col("root") == F.col("_root")).select("_fp", "component_id")
    return (prints.join(named, F.col("fp") == F.col("_fp"))
            .select("doc_id", "fp", "component_id"))


def written(fp: Column) -> Column:
    """16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
