"""Each operator against its plain version, on awkward rows and on the small tables."""

from __future__ import annotations

import array
import random

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from stockroom.llm import (bpe_codec, common, entries, hamming_topk, lang_id, line_quality, mixture, oracles, pii,
                           pu_quality, simhash, token_count, warc)
from stockroom.llm.merging import merge_all
from tests.conftest import SF_SMALL
from tests.llm import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EN = "The quick brown fox jumps over the lazy dog and runs home to the old house by the river. "
DE = "Der schnelle braune Fuchs springt über den faulen Hund und läuft nach Hause zum Fluß. "


def awkward():
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 7)))
    long = " ".join(word() for _ in range(30_000))
    near = [word() for _ in range(400)]
    edit = near[:200] + ["changed"] + near[201:]
    pii_text = ("mail a.b@x.org_c@y.com, ip 10.0.0.1 999.1.1.1 1.2.3.4.5.6.7.8, card 4111 1111 1111 1111 and "
                "4111111111111112, call +1 (202) 555-0100 or +12, IBAN GB82 WEST 1234 5698 7654 32 "
                "bad GB82 WEST 1234 5698 7654 33, amex card 378282246310005, ssn 123-45-6789 é🙂 z@é.com q@w.de")
    texts = [None, "", " \t\n", "one", "one two three", EN * 3, EN * 3, DE * 4, long, long, " ".join(near),
             " ".join(edit), pii_text, "é🙂 " + pii_text, "x" * 50_000, "1234 " * 900, "1 " * 40,
             "line one is here\nline one is here\n\n  LINE   one is HERE \n" + EN,
             "a\x0bb\x0cc\rd\x85e\xa0f g", "<|endoftext|>Hi<|startoftext|> it's I'LL 42 İΣ café !!! ՘b",
             "#*$%&|<> " * 30, "A B C D E F G H " * 9]
    rows = [(i, t, "de" if t and t.startswith("Der") else "en" if i % 3 else None, [None, "a", "b"][i % 3], 1)
            for i, t in enumerate(texts)]
    return rows + [rows[5], rows[8], (None, EN, None, None, None), (None, None, None, None, None)]


@pytest.fixture(scope="module")
def rows():
    return awkward()


@pytest.fixture(scope="module")
def docs(spark, rows):
    path = common.scratch_path(spark, "awkward")
    spark.createDataFrame(rows, SCHEMA).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def empty(spark):
    return common.cut(spark.createDataFrame([], SCHEMA), "empty")


def clash(df, *names):
    """Extra columns named like an operator's results, in another case."""
    for n in names:
        df = df.withColumn(n, F.lit("old"))
    return df


def test_language_id(spark, docs, rows, empty):
    model = lang_id.train(docs.where("lang is not null"), per_lang=50, epochs=20)
    assert model.langs == ["de", "en"]
    got = lang_id.identify(clash(docs, "LANG_PRED"), model).collect()
    assert len(got) == len(rows) and got[0].asDict().keys() >= {"doc_id", "lang_pred", "score"}
    for r in got:
        known = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == (not known) and 0 <= r.score <= 1
        if r.text and r.text.startswith(("Der", "The quick")):
            assert r.lang_pred == ("de" if r.text.startswith("Der") else "en")
    assert lang_id.train(empty) is None
    assert {r.lang_pred for r in lang_id.identify(docs, None).collect()} == {"und"}
    assert lang_id.identify(empty, model).count() == 0


def test_language_sample_counts_texts_not_copies(spark):
    rows = [("de", "der eine Text")] * 1990 + [("de", f"ein Text mit Nummer {i}") for i in range(10)]
    rows += [("en", f"a text of number {i}") for i in range(500)] + [("fr", "un seul")] * 700
    docs = spark.createDataFrame(rows, "lang string, text string")
    got = lang_id.training_windows(docs, "text", "lang", 600, 4, 400)
    assert sorted(zip(got["lang"], got["part"])) == sorted(set(rows))
    few = lang_id.training_windows(docs, "text", "lang", 20, 4, 400)
    assert few["lang"].value_counts().to_dict() == {"en": 20, "de": 11, "fr": 1}


def test_convolution_matches_a_direct_one():
    net = lang_id.ByteConvNet.start(["a", "b"])
    w = np.random.default_rng(0).integers(0, 256, (3, 40)).astype(np.uint8)
    top = net.pooled(w)[1]
    for i in range(3):
        for f in range(top.shape[1]):
            width = lang_id.WIDTHS[f // lang_id.PER_WIDTH]
            kernel = net.kernel[:width * lang_id.EMBED, f]
            last = 40 - max(lang_id.WIDTHS) + 1
            best = max(float(net.embed[w[i, p:p + width]].ravel() @ kernel) for p in range(last))
            assert abs(max(best + net.bias[f], 0) - top[i, f]) < 1e-4


def test_language_held_out_accuracy(spark):
    want = {r.doc_id: r.lang for r in common.read(spark, "/root/testdata/sf0.01", "documents").collect()}
    got = [r for r in entries.op1_language_id(spark, "/root/testdata/sf0.01").collect() if r.held_out]
    assert all(brute.fold(r.doc_id, 5) == 0 for r in got)
    assert sum(r.lang_pred == want[r.doc_id] for r in got) >= 0.97 * len(got)


def test_line_quality(docs, rows, empty):
    want = brute.quality([(r[0], r[1], r[3]) for r in rows], 1, 0.01, 0.3)
    got = line_quality.score(clash(docs, "N_WORDS", "kept"), least=1)
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["n_words"], r["kept"])
    assert sorted((r.asDict() for r in got.collect()), key=key) == sorted(want, key=key)
    assert line_quality.score(empty).count() == 0


def test_boilerplate_lines_are_removed(docs, rows, empty):
    """The documents themselves, without the lines that others of their host share."""
    per = {}
    for _, t, _, host, _ in rows:
        for x in {brute.norm_line(x) for x in (t or "").split("\n") if brute.words(x)}:
            per[host, x] = per.get((host, x), 0) + 1
    left = lambda t, host: t and "\n".join(x for x in t.split("\n") if per.get((host, brute.norm_line(x)), 0) < 2)
    got = line_quality.clean(clash(docs, "N_WORDS", "kept", "gone", "place"), least=1).collect()
    want = [(r[0], left(r[1], r[3]), *r[2:]) for r in rows]
    assert sorted(map(repr, ((r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in got))) == sorted(map(repr, want))
    assert any(a[1] != b[1] for a, b in zip(want, rows))
    for r in got:
        assert len(brute.words(r.text)) == r.n_words - r.removed_words
    counts = ("doc_id", *line_quality.COUNTS)
    assert sorted(repr(tuple(r[c] for c in counts)) for r in got) == sorted(
        repr(tuple(r)) for r in line_quality.score(docs, least=1).select(*counts).collect())
    assert line_quality.clean(empty).count() == 0


def test_token_counts(docs, rows, empty):
    from tokenizers import Tokenizer
    own = Tokenizer.from_file(token_count.vocabulary_path(token_count.VOCABULARY))
    want = {t: len(own.encode(t or "", add_special_tokens=False).ids) for _, t, *_ in rows}
    got = token_count.count_tokens(clash(docs, "N_TOKENS")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_tokens, r.n_bytes) == (want[r.text], len((r.text or "").encode()))
        assert r.over_limit == (r.n_tokens > 512)
    assert token_count.count_tokens(empty).count() == 0


def test_bpe_codec(docs, rows, empty):
    from tokenizers import Tokenizer
    own = Tokenizer.from_file(token_count.vocabulary_path(bpe_codec.VOCABULARY))
    got = bpe_codec.encode(clash(docs, "IDS", "decoded")).collect()
    assert len(got) == len(rows)
    for r in got:
        ids = own.encode(r.text or "", add_special_tokens=False).ids
        assert bpe_codec.ids_list(r.ids) == ids and r.n_tokens == len(ids)
        assert r.decoded == own.decode(ids, skip_special_tokens=False)
    assert bpe_codec.encode(empty).count() == 0


def test_bpe_on_every_character():
    """Texts with one of each character (in blocks), against the library."""
    from tokenizers import Tokenizer
    path = token_count.vocabulary_path(bpe_codec.VOCABULARY)
    own, codec = Tokenizer.from_file(path), bpe_codec.Codec(path)
    byte_path = token_count.vocabulary_path(token_count.VOCABULARY)
    lib, counter = Tokenizer.from_file(byte_path), token_count.Counter(byte_path)
    points = [c for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{chr(c)}B {chr(c)}1" for c in points[i:i + 64]) for i in range(0, len(points), 64)]
    for t, (ids, _) in zip(texts, codec.encode(texts)):
        assert bpe_codec.ids_list(ids) == own.encode(t, add_special_tokens=False).ids
    assert counter.counts(texts) == [len(lib.encode(t, add_special_tokens=False).ids) for t in texts]


def test_forced_cuts_change_nothing():
    codec = bpe_codec.Codec(token_count.vocabulary_path(bpe_codec.VOCABULARY))
    rnd = random.Random(1)
    words = ["".join(rnd.choice("qxzaeéthin") for _ in range(rnd.randint(1, 12))).encode() for _ in range(500)]
    data = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words]) - 1
    symbols = codec.symbol[data]
    symbols[ends] = codec.last[data[ends]]
    parts = codec.fragments(data, ends)
    assert len(parts) > len(words)
    whole, _ = merge_all(codec.merges, symbols, np.diff(np.r_[-1, ends]))
    cut, _ = merge_all(codec.merges, symbols, parts)
    assert whole.tolist() == cut.tolist()


def test_pii_spans(docs, rows, empty):
    got = pii.detect(clash(docs, "PII")).collect()
    assert len(got) == len(rows)
    for r in got:
        spans = [(s["kind"], s["start"], s["end"]) for s in r["pii"]]
        assert [s for s in spans if s[0] in pii.BASE_KINDS] == brute.base_spans(r.text)
    by = {r.doc_id: r for r in got}
    text = by[12].text
    more = {(s["kind"], text[s["start"]:s["end"]]) for s in by[12]["pii"] if s["kind"] not in pii.BASE_KINDS}
    assert more == {("iban", "GB82 WEST 1234 5698 7654 32"), ("card_short", "378282246310005"), ("ssn", "123-45-6789")}
    assert pii.detect(empty).count() == 0


def test_pii_needs_checksum_and_context(spark):
    rows = [(1, "number 378282246310005 here"), (2, "pay with amex 378282246310005"), (3, "credit 378282246310006"),
            (4, "DE89 3704 0044 0532 0130 00"), (5, "DE88 3704 0044 0532 0130 00"), (6, "example amex 378282246310005")]
    got = {r.doc_id: [s["kind"] for s in r["pii"]]
           for r in pii.detect(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: [], 2: ["card_short"], 3: [], 4: ["iban"], 5: [], 6: []}


def test_pii_ibans_before_capitals_and_digits(spark):
    gb, de, no = "GB82 WEST 1234 5698 7654 32", "DE89370400440532013000", "NO93 8601 1117 947"
    rows = [(gb + " Please pay", [gb]), (de + " BIC COBADEFFXXX", [de]), ("GB82WEST12345698765432 I paid", ["GB82WEST12345698765432"]),
            ("GB82WEST12345698765432 2 copies", ["GB82WEST12345698765432"]), (gb + " 2 AND 3 MORE", [gb]),
            (f"{de} {gb} {no} OK", [de, gb, no]), (f"AB12 {de} AB12 X", [de]), (gb + "é", [gb]), (gb + "x", []),
            (f"İ🙂 {no}, {no}\n{de}.", [no, no, de]), (de + "0", []), ("GB82 WEST 1234 5698 7654 33 Please", []),
            ("x" + de, []), ("A B C D " * 3000 + de + " E F" * 3000, [de]), ("AB12 " * 5000 + gb + " P", [gb])]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: [r.text[s["start"]:s["end"]] for s in r["pii"] if s["kind"] == "iban"] for r in pii.detect(df).collect()}
    assert [got[i] for i in range(len(rows))] == [w for _, w in rows]
    assert pii.redact(df).where("doc_id = 1").first().text == "[IBAN] BIC COBADEFFXXX"


def test_pii_context_of_listed_numbers(spark):
    """The words before a list are context of every number within reach."""
    rows = [(1, "SSN list: 123-45-6789, 987-65-4321, 222-33-4444."), (2, "amex 378282246310005, 371449635398431"),
            (3, "123-45-6789, 987-65-4321 are ssn"), (4, "ssn 123-45-6789," + " " * 60 + "987-65-4321"),
            (5, "example amex 378282246310005, 371449635398431"), (6, "İé🙂 ssn 123-45-6789, 987-65-4321"),
            (7, "ssn " + "123-45-6789, ssn " * 600 + "987-65-4321")]
    got = {r.doc_id: [(s["kind"], r.text[s["start"]:s["end"]]) for s in r["pii"]]
           for r in pii.detect(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    ssn = [("ssn", "123-45-6789"), ("ssn", "987-65-4321")]
    short = [("card_short", "378282246310005"), ("card_short", "371449635398431")]
    assert got == {1: [*ssn, ("ssn", "222-33-4444")], 2: short, 3: ssn, 4: ssn[:1], 5: [], 6: ssn,
                   7: ssn[:1] * 600 + ssn[1:]}


def test_pii_redaction(docs):
    for r in pii.redact(docs).collect():
        if r.doc_id == 12:
            assert "[EMAIL]" in r.text and "[IBAN]" in r.text and "4111 1111 1111 1111" not in r.text
            assert "999.1.1.1" in r.text and "4111111111111112" in r.text       # failed their checks
            assert brute.base_spans(r.text) == []
        if r.doc_id == 0:
            assert r.text is None
        if r.doc_id == 5:
            assert r.text == EN * 3


def test_pii_in_long_texts(spark):
    """Tens of thousands of matches, and runs of digits of any length."""
    text = " ".join([f"{i:05d}, " for i in range(20_000)] + [f"a{i}@b.com 10.0.0.{i % 300}" for i in range(5_000)]
                    + ["4111 1111 1111 1111 -4111111111111111", "1" * 4_000, "+1 (555) 010-9999"])
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = pii.detect(docs).first()
    spans = [(s["kind"], s["start"], s["end"]) for s in row["pii"]]
    assert [s for s in spans if s[0] in pii.BASE_KINDS] == brute.base_spans(text)
    clean = pii.redact(docs).first().text
    want, at = [], 0
    for kind, start, end in sorted((s for s in spans), key=lambda s: s[1]):
        want += [text[at:start], f"[{kind.upper()}]"]
        at = end
    assert clean == "".join(want) + text[at:]


def test_pii_base_columns_in_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.01/documents.parquet'")
    want = con.execute(oracles.OP4_BASE).df().sort_values("doc_id").reset_index(drop=True)
    got = entries.op4_pii(spark, "/root/testdata/sf0.01").toPandas()[list(want.columns)]
    assert got.sort_values("doc_id").reset_index(drop=True).equals(want)


def test_mixture(docs, rows, empty):
    size, longest = {}, {}
    for _, t, _, s, _ in rows:
        n = len(brute.words(t))
        size[s], longest[s] = size.get(s, 0) + n, max(longest.get(s, 0), n)
    want = brute.targets(size)
    got = mixture.mix(clash(docs, "SIZE", "target")).collect()
    again = mixture.mix(docs).collect()
    assert len(got) == len(rows) and sorted(map(repr, got)) == sorted(map(repr, again))
    taken = dict.fromkeys(size, 0)
    for r in got:
        assert r.source_size == size[r.source] and abs(r.target - want[r.source]) < 1e-6
        assert 0 <= r.taken <= 2 * r.size and r.taken == r.copies * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= longest[s] for s in size)
    assert mixture.mix(empty).count() == 0
    assert mixture.emit(docs).count() == sum(r.copies for r in got)


def test_targets_of_many_sources(spark):
    rnd = random.Random(9)
    size = {f"s{i:03d}": rnd.choice([0, 1, 5, 50, 4000]) for i in range(60)} | {None: 70}
    df = spark.createDataFrame([(k, v) for k, v in size.items()], "source string, source_size long")
    want = brute.targets(size)
    for r in mixture.targets(df).collect():
        assert abs(r.target - want[r.source]) < 1e-6


def test_pu_quality(spark, docs, empty):
    labels = spark.createDataFrame([(i, int(i in (5, 6, 7, 8, 9, 10))) for i in range(20)] + [(5, 0), (None, 1)],
                                   "doc_id long, quality int")
    net = pu_quality.train(docs, labels)
    got = pu_quality.score(clash(docs, "SCORE"), net).collect()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    by = {}
    assert all(by.setdefault(r.text, r.score) == r.score for r in got)
    assert pu_quality.train(docs, labels.where("quality = 0")) is None
    assert pu_quality.train(empty, labels) is None
    assert {r.score for r in pu_quality.score(docs, None).collect()} == {0.0}
    assert pu_quality.score(empty, net).count() == 0


def test_pu_sample_counts_texts_not_copies(spark, monkeypatch):
    rows = [(i, "the same good text") for i in range(3000)] + [(3000 + i, f"text of number {i}") for i in range(79)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 3040)) for i in range(3060)], "doc_id long, quality int")
    monkeypatch.setattr(pu_quality, "fit", lambda pos, unl, prior: (len(pos), len(unl)))
    assert pu_quality.train(docs, labels, positives=50, unlabelled=60) == (41, 60)
    assert pu_quality.train(docs, labels, positives=30, unlabelled=500) == (30, 80)


def test_pu_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    mark = {r.doc_id: r.quality for r in common.read(spark, sf, "labels").collect()}
    got = [r for r in entries.op6_pu_quality(spark, sf).collect() if r.held_out and r.doc_id in mark]
    assert all(brute.fold(r.doc_id, 4) == 2 for r in got)
    assert sum(r.predicted == mark[r.doc_id] for r in got) >= 0.95 * len(got)


def test_warc_round_trip(spark):
    page = "<p>\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n é🙂</p>"
    rows = [(1, "http://B.example.org:80/x#y", page), (2, None, None), (3, "https://a.example.org/", page * 40),
            (4, "https://a.example.org/", page * 40), (5, "https://a.example.org/", page * 41), (None, "u", "x"),
            (6, "http://z.org", ""), (7, "https://a.example.org/", "é" * 500), (8, "q", "é" * 500), (9, "q", "é" * 499),
            (10, "q", "é" * 499)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("offset", F.lit("old"))
    for size in (1 << 20, 600):       # one archive, and many
        got = {r.page_id: r for r in warc.archive(df, file_bytes=size).collect()}
        assert len(got) == len(rows)
        for page_id, _, html in rows:
            data, r = (html or "").encode(), got[page_id]
            assert r.payload_bytes == len(data)
            assert r.payload_digest == __import__("hashlib").sha1(data).hexdigest()
        assert {i: r.refers_to for i, r in got.items() if r.record_type == "revisit"} == {3: 4, 7: 8}
        order = [warc.order_of(tuple(r)) for r in sorted(got.values(), key=lambda r: warc.order_of(tuple(r)))]
        assert order == [warc.order_of(tuple(r)) for r in warc.archive(df, file_bytes=size).collect()]
    assert warc.archive(df.limit(0)).count() == 0


def test_equal_pages_spread_over_archives_and_partitions(spark, monkeypatch):
    rows = [(None, None, "same")] * 1500 + [(7, "http://a.org", "p" * 1200)] * 300 + [(None, None, "other")] * 200
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = warc.archive(df, file_bytes=24_000).withColumn("part", F.spark_partition_id()).collect()
    count = lambda xs: pd.Series(list(xs)).value_counts()
    assert len(got) == len(rows) and sum(r.page_id is None for r in got) == 1700
    assert count(r.payload_bytes for r in got).to_dict() == {4: 1500, 1200: 300, 5: 200}
    assert count(r.archive for r in got).max() < 200
    assert count(r.part for r in got if r.page_id is None).max() < 1000
    order = [warc.order_of(tuple(r)) for r in sorted(got, key=lambda r: (r.part, r.place))]
    assert order == sorted(order)
    monkeypatch.setattr(warc, "FILE_RECORDS", 50)
    assert count(r.archive for r in warc.archive(df).collect()).max() <= 50


def test_loser_tree():
    rnd = random.Random(2)
    for k in range(0, 9):
        runs = [sorted((rnd.choice("abc"), "t", rnd.randint(0, 3), "r") for _ in range(rnd.randint(0, 6))) for _ in range(k)]
        got = list(warc.LoserTree([iter(r) for r in runs]))
        assert got == sorted(x for r in runs for x in r)


@pytest.mark.parametrize("k,parts", [(3, 4), (10, 4), (40, 8)])
def test_hamming_topk(spark, k, parts):
    rng = np.random.default_rng(k)
    base = rng.normal(size=(60, 64))
    data = [(i, (base[i % 60] + rng.normal(scale=.3 * (i % 4), size=64)).tolist()) for i in range(400)]
    data += [(1000 + i, data[0][1]) for i in range(30)] + [(400, None), (500, []), (600, [1.0] * 63 + [float("nan")])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>").withColumn("code", F.lit("old"))
    good = [(i, np.array(v) > 0) for i, v in data if v and np.isfinite(v).all()]
    want = set()
    for q, c in good:
        if q % 100 == 0:
            best = sorted((int((c != o).sum()), i) for i, o in good)[:k]
            want |= {(q, n + 1, i, d) for n, (d, i) in enumerate(best)}
    assert {tuple(r) for r in hamming_topk.top_k(df, k=k, parts=parts, sample=64).collect()} == want


@pytest.mark.parametrize("n,parts", [(1, 64), (2, 64), (500, 9), (2000, 7), (51282, 5), (10**6, 4), (10**9, 2)])
def test_segments_follow_from_the_number_of_codes(n, parts):
    assert hamming_topk.segment_count(n) == parts
    assert sum(w for _, w in hamming_topk.segments(parts)) == 64


def test_probes_are_all_values_within_the_radius(spark):
    cuts = [(0, 5), (5, 7)]
    start = spark.createDataFrame([(7, 0, 19), (7, 1, 100)], "q long, seg int, val long").withColumn("at", F.lit(-1))
    seen, probes = {0: set(), 1: set()}, start
    for r in range(4):
        rows = probes.collect()
        for seg, (_, width) in enumerate(cuts):
            first = (19, 100)[seg]
            mine = [x.val for x in rows if x.seg == seg]
            assert sorted(mine) == sorted(v for v in range(1 << width) if (v ^ first).bit_count() == r)
        probes = hamming_topk.flipped(probes, cuts)


def test_every_query_is_answered_by_the_index(spark):
    """The registered query on the small tables, whose distances no radius of zero covers."""
    rows = {r.vec_id: np.array(r.embedding) > 0 for r in common.read(spark, "/root/testdata/sf0.01", "embeddings").collect()}
    want = {(q, n + 1, i, d) for q in rows if q % 100 == 0 for n, (d, i) in enumerate(
        sorted((int((rows[q] != v).sum()), i) for i, v in rows.items())[:10])}
    assert {tuple(r) for r in entries.op9_hamming_topk(spark, "/root/testdata/sf0.01").collect()} == want
    assert not hasattr(hamming_topk, "scan")


def test_capture_times_do_not_depend_on_the_zone(spark):
    ids = spark.createDataFrame([(15_000_000,), (0,), (999_999_999,), (1_000_000_000,), (None,), (-1,)], "id long")
    before, got = spark.conf.get("spark.sql.session.timeZone"), set()
    for zone in ("America/New_York", "UTC"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        got.add(tuple(r[0] for r in ids.select(warc.capture_time(F.col("id"))).collect()))
    spark.conf.set("spark.sql.session.timeZone", before)
    first = np.datetime64("2024-01-01T00:00:00")
    want = [str(first + np.timedelta64((i or 0) % 10**9, "s")) + "Z" for i in (15_000_000, 0, 999_999_999, 10**9, None, -1)]
    assert got == {tuple(want)}


def test_hamming_topk_of_few(spark):
    schema = "vec_id long, embedding array<double>"
    assert hamming_topk.top_k(spark.createDataFrame([], schema)).count() == 0
    two = spark.createDataFrame([(0, [1.0] * 64), (1, [-1.0] * 64)], schema)
    assert [tuple(r) for r in hamming_topk.top_k(two).orderBy("rank").collect()] == [(0, 1, 0, 0), (0, 2, 1, 64)]


def test_anchors_cover_every_close_pair():
    rng = np.random.default_rng(3)
    for _, width in simhash.BLOCKS:
        v = rng.integers(0, 1 << width, 300)
        rows, at = simhash.anchors(v, width, 2)
        reach = [set(at[rows == i].tolist()) for i in range(300)]
        for i in range(300):
            s = int(simhash.syndrome(v[i:i + 1])[0])
            own = int(v[i]) ^ (1 << (s - 1) if s else 0)
            assert (int(v[i]) ^ own).bit_count() <= 1 and own in reach[i]
            other = int(v[i]) ^ (1 << int(rng.integers(0, width)))
            r2, a2 = simhash.anchors(np.array([other]), width, 2)
            assert own in set(a2.tolist())


def test_near_duplicates(docs, rows, empty):
    want = brute.near_duplicates([(i, r[1]) for i, r in enumerate(rows)])
    numbered = docs.sparkSession.createDataFrame(
        [(i, r[1], "old", "old") for i, r in enumerate(rows)], "doc_id long, text string, fp string, anchor string")
    got = simhash.near_duplicates(numbered).select(
        "doc_id", simhash.written(F.col("fp")).alias("f"), "component_id").collect()
    assert {r.doc_id: (r.f, r.component_id) for r in got} == want
    assert simhash.near_duplicates(docs).count() == len(rows)
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("home", [3, 1024])
def test_links_of_dense_groups(spark, monkeypatch, home):
    """Chains and balls of fingerprints; crowded anchors are split when few may share one."""
    monkeypatch.setattr(simhash, "HOME", home)
    rnd = random.Random(7)
    prints, at = {}, 0
    for _ in range(4):
        x = rnd.getrandbits(64)
        for _ in range(60):
            prints[at], at = x, at + 1
            for _ in range(rnd.choice([1, 2, 4, 9])):
                x ^= 1 << rnd.randrange(64)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(p),) for p in set(prints.values())], "fp long")
    common.python_ready(spark)
    found = {r.node: r.root for r in simhash.components(simhash.links(df)).collect()}
    want = brute.components(prints)
    mine = {}
    for i, p in prints.items():
        mine.setdefault(found.get(signed(p), signed(p)), []).append(i)
    assert sorted(mine.values()) == sorted(
        [sorted(i for i in want if want[i][1] == c) for c in {v[1] for v in want.values()}])


def test_guests_pass_in_slices():
    """No frame holds all members of a crowded group, and no pair of home member and member is lost."""
    rows = [(a, p, a * 1000 + p * 100_000 + i, i < 7) for a, p, m in ((1, 0, 300), (1, 4096, 9), (2, 0, 5), (2, 1, 100))
            for i in range(m)]
    df = pd.DataFrame(rows, columns=["anchor", "part", "fp", "home"])
    frames = list(simhash.sliced((df[i:i + 3] for i in range(0, len(df), 3)), 20))
    assert max(map(len, frames)) <= 20 + 3 + 7
    met = {(x, y) for f in frames for _, g in f.groupby("anchor") for x in g["fp"][g["home"]] for y in g["fp"]}
    want = {(x, y) for _, g in df.groupby(["anchor", "part"]) for x in g["fp"][g["home"]] for y in g["fp"]}
    assert met == want


def test_near_duplicates_of_small_table(spark):
    sf = SF_SMALL
    want = brute.near_duplicates([(r.doc_id, r.text) for r in common.read(spark, sf, "documents").collect()])
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in entries.op10_simhash(spark, sf).collect()}
    assert got == want


def test_pipeline(spark):
    """run() against the plain versions, stage by stage; the learned stage by its own model."""
    from tokenizers import Tokenizer
    docs = common.read(spark, SF_SMALL, "documents")
    kept = common.cut(corpus_pipeline.known_language(spark, docs, SF_SMALL), "kept")
    ids = {r.doc_id for r in kept.collect()}
    assert len(ids) >= 0.99 * docs.count()
    prints = brute.near_duplicates([(r.doc_id, r.text) for r in kept.collect()])
    one = common.cut(corpus_pipeline.one_of_each(spark, kept, SF_SMALL), "one")
    assert sorted(r.doc_id for r in one.collect()) == sorted({c for _, c in prints.values()})
    clean = common.cut(corpus_pipeline.without_personal_data(spark, one, SF_SMALL), "clean")
    assert all(not brute.base_spans(r.text) and r.n_chars == len(r.text) for r in clean.collect())
    mixed = common.cut(corpus_pipeline.mixed_sources(spark, clean, SF_SMALL), "mixed")
    assert all(d.columns == list(corpus_pipeline.COLUMNS) for d in (kept, one, clean, mixed))
    own = Tokenizer.from_file(token_count.vocabulary_path(bpe_codec.VOCABULARY))
    want = []
    for r in mixed.collect():
        e = own.encode(r.text, add_special_tokens=False).ids
        want.append((r.doc_id, len(e), brute.sha256(array.array("I", e).tobytes())))
    got = corpus_pipeline.run(spark, SF_SMALL).collect()
    assert sorted((r.doc_id, r.n_tokens, r.ids_sha256) for r in got) == sorted(want)


def test_pipeline_on_awkward_rows(spark, docs, empty):
    for d in (docs, empty):
        for name, stage in corpus_pipeline.STAGES:
            d = common.cut(stage(spark, d, SF_SMALL), name)
        assert "ids_sha256" in d.columns


def test_sql_agrees(spark):
    from tests.oracle_harness import compare
    got = compare(spark, SF_SMALL, list(oracles.ORACLES), verbose=False)
    assert all(v.startswith("ok") for v in got.values()), got


def test_rows_made_from_one_stored_row_stay_apart(spark, docs, rows):
    """Three rows from each stored one: emitted and cleaned one by one."""
    few = docs.where(F.length("text") < 2000)
    tripled = few.withColumn("nr", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
    assert common.is_scan(few) and not common.is_scan(tripled) and not common.is_scan(few.union(few))
    n = tripled.count()
    mixed = mixture.emit(tripled)
    assert mixed.columns == tripled.columns
    assert mixed.count() == mixture.mix(tripled).agg(F.sum("copies")).first()[0]
    kept = line_quality.clean(tripled, least=100)
    assert kept.count() == n and kept.select("nr", "doc_id", "text").exceptAll(
        tripled.select("nr", "doc_id", "text")).count() == 0


def test_columns_named_like_internal_ones_are_kept(docs):
    names = ["copies", "_row", "row", "pii", "spans", "cuts", "value_of_row", "_value_of_row", "of", "found", "id"]
    few = clash(docs.where(F.length("text") < 2000), *names)
    n = few.count()
    for made, some in ((mixture.emit(few), True), (line_quality.clean(few), False), (pii.redact(few), False),
                       (lang_id.identify(few, None), False), (bpe_codec.encode(few), False)):
        assert set(few.columns) <= set(made.columns)
        values = made.select(*names).distinct().collect()
        assert [tuple(v) for v in values] == [("old",) * len(names)]
        assert some or made.count() == n


def test_pipeline_leaves_only_its_result(spark):
    """The shared folder holds no intermediate of a finished run."""
    import os

    from stockroom.session import shared_dir
    folder = shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    out = corpus_pipeline.run(spark, SF_SMALL)
    left = set(os.listdir(folder)) - before
    assert len(left) == 1 and left.pop().startswith("stage-bpe_codec") and out.count() > 0


def test_pipeline_values_on_awkward_rows(spark, docs, rows):
    """Stage by stage: what stays of rows without text, copies, long texts and personal data."""
    kept = common.cut(corpus_pipeline.known_language(spark, docs, SF_SMALL), "kept")
    ids = [r.doc_id for r in kept.collect()]
    lettered = [r[0] for r in rows if any(c.isalpha() for c in r[1] or "")]
    assert set(ids) <= set(lettered) and ids.count(5) == 2 and ids.count(8) == 2        # repeated rows are rows
    one = common.cut(corpus_pipeline.one_of_each(spark, kept, SF_SMALL), "one")
    prints = brute.near_duplicates([((r.doc_id is None, r.doc_id or 0, i), r.text) for i, r in enumerate(kept.collect())])
    assert one.count() == len({c for _, c in prints.values()})
    assert {5, 8} & {r.doc_id for r in one.collect()} == {5, 8} and 6 not in {r.doc_id for r in one.collect()}
    clean = {r.doc_id: r.text for r in corpus_pipeline.without_personal_data(spark, one, SF_SMALL).collect()}
    for i in {12, 13} & set(clean):
        assert "[IBAN]" in clean[i] and "[EMAIL]" in clean[i] and not brute.base_spans(clean[i])
    assert clean[8] == rows[8][1]
