"""Exact dedup, hard negatives and alignment against their plain versions."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stockroom.llm import alignment, common, entries, exact_dedup, hard_negatives, quotient
from stockroom.llm.token_count import vocabulary_path
from tests.conftest import SF_SMALL
from tests.llm import brute
from tests.llm.test_llm import SCHEMA, awkward, clash


@pytest.fixture(scope="module")
def rows():
    copies = [(50 + i, t, None, "a", 0) for i, t in enumerate(
        ["a b c", "ab c", "abc", " abc\n", "a bc", "a b\tc\x0b\x0c\r", "ABC", "a b c"])]
    return awkward() + copies + [(None, "abc", None, None, None), (7, "a b\tc\x0b\x0c\r", None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    path = common.scratch_path(spark, "awkward-more")
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def empty(spark):
    return common.cut(spark.createDataFrame([], SCHEMA), "empty")


@pytest.mark.parametrize("bits,block_bits", [(64, 0), (64, 5), (40, 8), (9, 8), (5, 0), (64, 63)])
def test_filters_keep_everything(bits, block_bits):
    rnd = np.random.default_rng(bits)
    parts, want = [], {}
    for n in (1, 0, 7, 5000):
        prints = rnd.integers(0, 2**64, n, dtype=np.uint64) >> np.uint64(64 - bits)
        prints = np.r_[prints, prints[: n // 2], np.full(n, prints[0] if n else 0, np.uint64)]
        for p in prints.tolist():
            want[p] = want.get(p, 0) + 1
        made = quotient.build(prints, bits, block_bits)
        assert [f.block for f in made] == sorted({p >> (bits - block_bits) for p in prints.tolist()})
        parts += [quotient.items(f, bits, block_bits) for f in made]
    found, counts = quotient.merge(parts)
    assert dict(zip(found.tolist(), counts.tolist())) == want
    assert (np.diff(found.astype(object)) > 0).all()
    again = [quotient.items(f, bits, block_bits) for f in quotient.build(found, bits, block_bits, counts)]
    assert dict(zip(*(x.tolist() for x in quotient.merge(again)))) == want


@pytest.mark.parametrize("bits", [64, 8, 2])
def test_exact_duplicates(docs, rows, empty, bits):
    """Few bits make texts share fingerprints: their bytes keep them apart."""
    want = brute.exact_groups([(r[0], r[1]) for r in rows])
    got = exact_dedup.duplicates(clash(docs, "KEEP_ID", "fp", "part"), bits=bits).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert exact_dedup.duplicates(empty, bits=bits).count() == 0


def test_deduplicated_rows(docs, rows):
    kept = [r for r, w in zip(rows, brute.exact_groups([(r[0], r[1]) for r in rows])) if w[3]]
    got = exact_dedup.deduplicated(clash(docs, "place", "_ROW", "kept"))
    assert got.columns[-3:] == ["place", "_ROW", "kept"]
    assert sorted(repr(tuple(r)[:5]) for r in got.collect()) == sorted(map(repr, kept))
    doubled = docs.withColumn("twice", F.explode(F.array(F.lit(1), F.lit(2))))
    assert exact_dedup.deduplicated(doubled).count() == len(kept)


def test_hot_group_is_spread(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "HOT", 3)
    rows = [(i, "copy of one" if i % 2 else f"text {i}") for i in range(400)]
    docs = common.cut(spark.createDataFrame(rows, "doc_id long, text string"), "hot")
    got = exact_dedup.duplicates(docs).collect()
    assert sorted(map(tuple, got)) == sorted(brute.exact_groups(rows))


def vectors():
    rnd = random.Random(3)
    rows = [(i, [rnd.gauss(0, 1) for _ in range(6)], rnd.randrange(4)) for i in range(400)]
    rows += [(i, rows[i][1], rows[i][2]) for i in (3, 17, 100, 200)]        # repeated rows, anchors too
    rows += [(500 + i, rows[17][1], i % 4) for i in range(12)]              # ties
    rows += [(600, [0.0] * 6, 1), (601, [0.0] * 6, 2), (700, None, 1), (701, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1),
             (800, [float("nan")] * 6, 1), (801, [float("inf")] * 6, 1), (900, [1.0] * 6, None), (None, [1.0] * 6, 1),
             (1000, [1.0, 2.0], 1), (1001, [1.0, 2.0], 1), (1002, [1.0, 1.9], 2), (1100, [], 1), (1101, [], 1),
             (1102, [], 2), (1200, [1e6] * 6, 1), (1201, [1e6] * 6, 1), (1203, [9e5] * 6, 2)]
    return rows


def test_hard_negatives(spark):
    rows = vectors()
    schema = "vec_id long, embedding array<double>, label int"
    df = spark.createDataFrame(rows, schema).repartition(5)
    want = brute.hard_negatives(rows)
    assert {r[0] for r in want} >= {0, 100, 200, 300, 600, 1000, 1100, 1200}
    got = hard_negatives.mine(clash(df, "anchor", "SCORE", "rank")).collect()
    assert sorted(map(tuple, got)) == sorted(want)
    few = hard_negatives.mine(df, every=50, positives=2, negatives=1, low=95).collect()
    assert sorted(map(tuple, few)) == sorted(brute.hard_negatives(rows, 50, 2, 1, 95))
    assert hard_negatives.mine(spark.createDataFrame([], schema)).count() == 0
    assert hard_negatives.mine(spark.createDataFrame(rows[1:99], schema)).count() == 0     # no anchor


def test_small_blocks_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BLOCK", 7)
    monkeypatch.setattr(hard_negatives, "ANCHORS", 2)
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert sorted(map(tuple, hard_negatives.mine(df).collect())) == sorted(brute.hard_negatives(rows))


def test_many_parts_and_steps_change_nothing(spark, monkeypatch):
    for name, value in (("BLOCK", 5), ("ANCHORS", 3), ("PART", 200), ("AT_ONCE", 21)):
        monkeypatch.setattr(hard_negatives, name, value)
    rnd = random.Random(5)
    # all alike: nearly every row lies in every window, and many scores are equal
    rows = [(i, [1 + rnd.randrange(3) / 16 for _ in range(3)], rnd.randrange(3)) for i in range(250)]
    df = spark.createDataFrame(rows + vectors(), "vec_id long, embedding array<double>, label int").repartition(3)
    for options in ({}, {"every": 20, "positives": 7, "negatives": 3, "low": 97}):
        got = hard_negatives.mine(df, **options).collect()
        assert sorted(map(tuple, got)) == sorted(brute.hard_negatives(rows + vectors(), **options))


def test_nothing_is_broadcast(spark, monkeypatch):
    """The copies of the anchors outgrow by far what Spark guesses from the anchors' file."""
    plans, cut = [], common.cut

    def planned(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df

    monkeypatch.setattr(common, "cut", lambda df, name: cut(planned(df), name))
    df = spark.createDataFrame(vectors(), "vec_id long, embedding array<double>, label int")
    assert int(spark.conf.get("spark.sql.autoBroadcastJoinThreshold").rstrip("b")) >= 10 << 20
    planned(hard_negatives.mine(df))
    assert len(plans) == 4 and not [p for p in plans if "Broadcast" in p]


def test_huge_components():
    x = hard_negatives.whole_numbers(np.array([[1e300, -1e300, 0.5, 2.0 ** 53]]))
    assert x.tolist() == [[2**63 - 1, -2**63, 128, 2**61]]
    big = hard_negatives.Block(1, 1, b"\0" * 8, b"\0" * 8, ["a"], np.array([[2**62]], "<i8").tobytes())
    two = hard_negatives.Block(1, 1, b"\0" * 8, b"\0" * 8, ["a"], np.array([[3]], "<i8").tobytes())
    assert big.scores(two).tolist() == [[3 * 2**62 - 2**64]]


ODD = ["a  b", " a", "a ", "\n x\ty", "a▁b c", "<s> hi <|endoftext|> x", "café 你好 \U0001f642 \U0001f642",
       " nbsp here", "\x00 nul", "tab\tand  two   spaces end ", "x", "  og", "\x1c \x1d a"]


@pytest.mark.parametrize("frequent", [alignment.FREQUENT, 40, 0])
def test_alignment(spark, docs, rows, empty, frequent):
    texts = [(r[0], r[1]) for r in rows] + [(1000 + i, t) for i, t in enumerate(ODD)]
    df = docs.select("doc_id", "text").union(
        spark.createDataFrame(texts[len(rows):], "doc_id long, text string"))
    want = brute.alignment(texts, vocabulary_path(alignment.A_FILE), vocabulary_path(alignment.B_FILE))
    got = alignment.align(clash(df, "N_BEST", "found", "row"), frequent=frequent)
    assert {"found", "row", "text"} <= set(got.columns) and "N_BEST" not in got.columns
    got = got.select("doc_id", *alignment.SUMS, "groups_sha256").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    if frequent:
        assert alignment.align(empty).count() == 0


def test_small_tables_of_fragments_change_nothing(monkeypatch):
    words = alignment.Vocabularies(vocabulary_path(alignment.A_FILE), vocabulary_path(alignment.B_FILE))
    assert words.cuttable
    texts = [t for _, t, *_ in awkward() if t] + ODD
    own = alignment.Aligner(words)
    at, sizes = own.places(texts)
    monkeypatch.setattr(alignment, "AT_ONCE", 3)
    single = alignment.Aligner(words)
    at2, _ = single.places(texts)
    assert (own.sums[at] == single.sums[at2]).all() and (own.good[at] == single.good[at2]).all()
    assert [own.strings[i] for i in at] == [single.strings[i] for i in at2]
    # a text taken whole, without cuts, gives the sums of its fragments
    words.cuttable = False
    uncut = alignment.Aligner(words)
    for i, t in enumerate(texts):
        (k,), _ = uncut.places([t])
        mine = at[sizes[:i].sum():sizes[:i + 1].sum()]
        if own.good[mine].all():
            assert uncut.sums[k].tolist() == own.sums[mine].sum(axis=0).tolist()
            assert uncut.strings[k] == b";".join(own.strings[x] for x in mine)
        else:
            assert not uncut.good[k]


def test_pointers_reach_the_terminal_token():
    a, b = np.array([2, 3, 6, 7, 8, 12]), np.array([1, 4, 5, 8, 9, 10, 11, 12])
    to_a, to_b = alignment.terminals(a, b)
    assert to_a.tolist() == [4, 4, 4, 4, 4, 5] and to_b.tolist() == [4, 4, 4, 4, 5, 5, 5, 5]


def test_registered_queries_on_small_tables(spark):
    docs = [(r.doc_id, r.text) for r in common.read(spark, SF_SMALL, "documents").collect()]
    got = entries.op11_exact_dedup(spark, SF_SMALL).collect()
    assert sorted(map(tuple, got)) == sorted(brute.exact_groups(docs))
    got = entries.op13_alignment(spark, SF_SMALL).collect()
    want = brute.alignment(docs, vocabulary_path(alignment.A_FILE), vocabulary_path(alignment.B_FILE))
    assert sorted(map(tuple, got)) == sorted(want)
    rows = [(r.vec_id, r.embedding, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label)
            for r in common.read(spark, SF_SMALL, "embeddings").collect()]
    got = entries.op12_hard_negatives(spark, SF_SMALL).collect()
    assert sorted(map(tuple, got)) == sorted(brute.hard_negatives(rows))
