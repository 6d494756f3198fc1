"""Cross-tokenizer alignment by pointer jumping.

A text is encoded under two vocabularies, A (byte-level BPE) and B (pieces with byte
fallback).  Every token points to the farthest-right token it overlaps: the token of the
other vocabulary that covers its last byte if that ends further right (where both end
at one byte, B's points to A's), else itself.  Successors are doubled (next =
next[next]) for all tokens of a batch at once until nothing moves; each token then
holds the terminal token of its component, which labels its group.  Groups end where
tokens of both vocabularies end.

Both vocabularies keep a space with the word after it: a space between two characters
that are not white is the start of a token in both (B is checked for it when it is
loaded).  Texts are cut there, and equal fragments are aligned once per task and kept
in a table of bounded size; all counts of a text are sums over its fragments.

Every text is aligned once.  Its linked id pairs, each once with how often it is linked,
are written beside its counts as packed integers.  From these the corpus-wide counts of
pairs are added up (per task before they are shuffled), and a last pass over them adds
up what each document needs: the pairs above a count that at most FREQUENT pairs reach
are held by every task; rarer ones are joined with their counts.

Defined cases: a null or empty text has no tokens; neither has one whose tokens do not
spell space + text; special strings are plain text; repeated rows are documents of their
own; other columns, or those named in ``keep``, are kept (result columns replace equal
names).
"""

from __future__ import annotations

import gc
import hashlib
import json
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockroom.llm import common
from stockroom.llm.merging import byte_letters
from stockroom.llm.token_count import PATTERN, SETTLED, vocabulary_path

A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
SPACE = "▁"                # how pieces write a space
BETWEEN = r"(?<=\S) (?=\S)"     # a certain cut in both vocabularies
BESIDE_WHITE = r" \s|\s |^ | $"  # spaces that are none
FREQUENT = 1_000_000            # pairs whose counts every task holds
KNOWN, KNOWN_CHARS = 400_000, 1 << 26    # fragments, and characters of theirs, a task holds
AT_ONCE = 400_000               # characters encoded together
PAIRS_HELD = 4_000_000          # entries a task adds up before it passes them on
COUNTS = ("n_a", "n_b", "n_groups", "n_links")
SUMS = (*COUNTS, "n_best", "count_sum")


class Ragged:
    """Byte strings by id, end to end."""

    def __init__(self, strings: list[bytes]):
        self.sizes = np.fromiter(map(len, strings), np.int64, len(strings))
        self.starts = np.r_[0, np.cumsum(self.sizes)[:-1]]
        self.data = np.frombuffer(b"".join(strings), np.uint8)

    def join(self, ids: np.ndarray) -> bytes:
        return self.data[spread(self.starts[ids], self.sizes[ids])].tobytes()


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... (sizes[0] of them), then those of the next."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


class Vocabularies:
    """Both encoders and the bytes of their tokens.

    A's merges rank in the order of their ids, so tiktoken, several times as fast, gives
    the ids of the tokenizers library; that library itself encodes where ranks differ
    from ids or characters are too new for all Unicode tables to agree on their class.
    """

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"      # Spark runs the tasks
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer
        self.library = Tokenizer.from_file(a_path)
        self.library.encode_special_tokens = True
        with open(a_path, encoding="utf-8") as f:
            spec = json.load(f)
        byte_of = {c: b for b, c in byte_letters().items()}
        vocab, added = spec["model"]["vocab"], {t["content"] for t in spec["added_tokens"]}
        names = {i: t for t, i in vocab.items()}
        spelled = {i: bytes(byte_of[c] for c in t) for i, t in names.items() if t not in added}
        self.a_bytes = Ragged([spelled.get(i, b"") for i in range(max(names) + 1)])
        ranked = all(vocab[a + b] == 256 + i for i, (a, b) in enumerate(spec["model"]["merges"]))
        self.fast = tiktoken.Encoding("A", pat_str=PATTERN, mergeable_ranks={t: i for i, t in spelled.items()},
                                      special_tokens={}) if ranked else None
        self.unsettled = regex.compile(SETTLED).search
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.n_b = self.b.get_piece_size()
        pieces = [self.b.id_to_piece(i) for i in range(self.n_b)]
        self.b_bytes = Ragged([bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else
                               p.replace(SPACE, " ").encode("utf-8") for i, p in enumerate(pieces)])
        # no piece holds a space behind another character, so no piece crosses a cut
        self.cuttable = not any(SPACE in p.lstrip(SPACE) for p in pieces)

    def settled(self, text: str) -> bool:
        return self.fast is not None and (text.isascii() or not self.unsettled(text))

    def encode(self, fragments: list[str], settled: bool) -> tuple[np.ndarray, np.ndarray]:
        """Ids of both vocabularies of fragments with a certain cut between each two."""
        text = " " + " ".join(fragments)
        a = self.fast.encode_ordinary(text) if settled else self.library.encode(text, add_special_tokens=False).ids
        b = self.b.encode(fragments, num_threads=1)
        return np.array(a, np.int64), np.fromiter(chain.from_iterable(b), np.int64)


def terminals(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The terminal token (an index into A's tokens) of every A and every B token, given
    where tokens end in one row of bytes that both cover."""
    n = len(a_ends)
    over_a = np.searchsorted(b_ends, a_ends)        # B's token that covers A's last byte
    over_b = np.searchsorted(a_ends, b_ends)
    step = np.concatenate([np.where(b_ends[over_a] > a_ends, n + over_a, np.arange(n)), over_b])
    while True:
        further = step[step]
        if np.array_equal(further, step):
            return step[:n], step[n:]
        step = further


def links(a_starts, a_ends, b_starts, b_ends) -> tuple[np.ndarray, np.ndarray]:
    """(A, B) indices of all pairs of tokens whose byte ranges overlap."""
    lo = np.searchsorted(b_ends, a_starts, side="right")
    hi = np.searchsorted(b_starts, a_ends, side="left")
    return np.repeat(np.arange(len(a_ends)), hi - lo), spread(lo, hi - lo)


class Aligner:
    """Aligns fragments and keeps what their documents need.

    ``sums[i]`` holds COUNTS of fragment i, ``strings[i]`` its groups as written;
    ``pairs`` its linked id pairs (``a * n_b + b``).  A fragment whose tokens do not
    spell it has ``good[i]`` false.
    """

    def __init__(self, words: Vocabularies, frequent: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None):
        self.words, self.frequent = words, frequent
        self.between, self.beside_white = regex.compile(BETWEEN), re.compile(BESIDE_WHITE)
        digits = max(len(words.a_bytes.sizes), words.n_b)
        self.written = Ragged([f"{i}{s}".encode() for s in ",|;" for i in range(digits)])
        self.digits = digits
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.chars = 0
        self.sums = np.zeros((1024, len(COUNTS)), np.int64)
        self.good = np.zeros(1024, bool)
        self.strings: list[bytes] = []
        self.pairs: list[np.ndarray] = []       # of every chunk of fragments
        self.owners: list[np.ndarray] = []      # and the fragment of each pair

    def full(self) -> bool:
        return len(self.place) > KNOWN or self.chars > KNOWN_CHARS

    def split(self, text: str) -> list[str]:
        """A text's fragments; none of an empty text."""
        if not self.words.cuttable or not text:
            return [text] if text else []
        return self.between.split(text) if self.beside_white.search(text) else text.split(" ")

    def places(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(fragment indices of all texts end to end, number of fragments of each)."""
        cut = [self.split(t) for t in texts]
        new = [f for f in set().union(*cut) if f not in self.place] if cut else []
        kinds: dict[bool, list[str]] = {True: [], False: []}
        for f in new:
            settled = self.words.settled(f)
            if f[0].isspace() or f[-1].isspace():       # no certain cut beside it: encoded alone
                self.learn([f], settled)
            else:
                kinds[settled].append(f)
        for settled, held in kinds.items():
            start, size = 0, 0
            for i, f in enumerate(held):
                size += len(f) + 1
                if size >= AT_ONCE or i == len(held) - 1:
                    self.learn(held[start:i + 1], settled)
                    start, size = i + 1, 0
        sizes = np.fromiter(map(len, cut), np.int64, len(cut))
        flat = map(self.place.__getitem__, chain.from_iterable(cut))
        return np.fromiter(flat, np.int64, int(sizes.sum())), sizes

    def learn(self, fragments: list[str], settled: bool) -> None:
        """Align new fragments, laid end to end with a cut before each."""
        first = len(self.strings)
        a, b = self.words.encode(fragments, settled)
        spelled = b"".join(b" " + f.encode("utf-8", "replace") for f in fragments)
        if self.words.a_bytes.join(a) != spelled or self.words.b_bytes.join(b) != spelled:
            if len(fragments) > 1:      # find the ones at fault
                half = len(fragments) // 2
                self.learn(fragments[:half], settled)
                self.learn(fragments[half:], settled)
                return
            self.keep(fragments, np.zeros((1, len(COUNTS)), np.int64), [b""], np.array([False]))
            return
        a_ends, b_ends = np.cumsum(self.words.a_bytes.sizes[a]), np.cumsum(self.words.b_bytes.sizes[b])
        ends = np.cumsum([len(f.encode("utf-8", "replace")) + 1 for f in fragments])
        a_of, b_of = np.searchsorted(ends, a_ends), np.searchsorted(ends, b_ends)
        a_last, b_last = terminals(a_ends, b_ends)
        x, y = links(a_ends - self.words.a_bytes.sizes[a], a_ends, b_ends - self.words.b_bytes.sizes[b], b_ends)
        n = len(fragments)
        count = lambda owner: np.bincount(owner, minlength=n)
        sums = np.stack([count(a_of), count(b_of), count(a_of[a_last == np.arange(len(a))]), count(a_of[x])], 1)
        strings = self.groups(a, b, a_last, b_last, a_of, b_of, n)
        self.keep(fragments, sums, strings, np.ones(n, bool))
        self.pairs.append(a[x] * self.words.n_b + b[y])
        self.owners.append(first + a_of[x])

    def groups(self, a, b, a_last, b_last, a_of, b_of, n: int) -> list[bytes]:
        """The groups of each fragment as written: A's ids, a bar, B's ids, a semicolon."""
        group = np.r_[a_last, b_last]
        order = np.lexsort((np.r_[np.zeros(len(a)), np.ones(len(b))], group))    # stable: tokens in order
        is_b, group = order >= len(a), group[order]
        turn = np.r_[group[1:] != group[:-1], True]
        mark = np.where(turn, 2, np.where(np.r_[is_b[1:], True] & ~is_b, 1, 0))
        codes = np.r_[a, b][order] + mark * self.digits
        sizes = self.written.sizes[codes]
        data = self.written.join(codes)
        owner = np.r_[a_of, b_of][order]
        stops = np.cumsum(np.bincount(owner, sizes, minlength=n).astype(np.int64)).tolist()
        return [data[i:j - 1] for i, j in zip([0, *stops], stops)]

    def keep(self, fragments: list[str], sums: np.ndarray, strings: list[bytes], good: np.ndarray) -> None:
        first, n = len(self.strings), len(fragments)
        while first + n > len(self.good):
            self.sums = np.concatenate([self.sums, np.zeros_like(self.sums)])
            self.good = np.concatenate([self.good, np.zeros_like(self.good)])
        self.sums[first:first + n] = sums
        self.good[first:first + n] = good
        self.strings += strings
        self.place.update(zip(fragments, range(first, first + n)))
        self.chars += sum(map(len, fragments))

    def all_pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pairs of all fragments end to end, first place and number of each fragment)."""
        pairs = np.concatenate([np.zeros(0, np.int64), *self.pairs])
        owners = np.concatenate([np.zeros(0, np.int64), *self.owners])
        sizes = np.bincount(owners, minlength=len(self.strings))
        return pairs, np.cumsum(sizes) - sizes, sizes


def groups_of_texts(texts: list[str]) -> Iterator[list[str]]:
    """Texts in groups of about a million characters."""
    held, size = [], 0
    for t in texts:
        if held and size + len(t) > 1_000_000:
            yield held
            held, size = [], 0
        held.append(t)
        size += len(t)
    if held:
        yield held


def whole(good: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether all fragments of each text are good."""
    bad = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[~good[at]], minlength=len(sizes))
    return (bad == 0) & (sizes > 0)


def packed(values: np.ndarray) -> bytes:
    """Counts or ids in as few bytes each as hold the largest."""
    top = int(values.max(initial=0))
    return values.astype(next(f"<u{n}" for n in (1, 2, 4, 8) if top < 1 << (8 * n))).tobytes()


def unpacked(parts: list[bytes], sizes: np.ndarray) -> np.ndarray:
    """Packed arrays of known lengths, end to end."""
    return np.concatenate([np.zeros(0, np.int64), *(
        np.frombuffer(p, f"<u{len(p) // n}").astype(np.int64) for p, n in zip(parts, sizes.tolist()) if n)])


def aligner(a_file: str, b_file: str):
    """A text expression -> struct of COUNTS, groups_sha256, and its id pairs with how
    often each is linked (packed)."""
    fields = ", ".join(f"{c} long" for c in COUNTS)

    @F.pandas_udf(f"{fields}, groups_sha256 string, n_pairs int, pairs binary, times binary")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = Aligner(Vocabularies(vocabulary_path(a_file), vocabulary_path(b_file)))
        span = np.int64(len(own.words.a_bytes.sizes) * own.words.n_b)
        gc.disable()            # millions of short-lived lists, none of them in a cycle
        for part in parts:
            rows: list[tuple] = []
            for texts in groups_of_texts(part.tolist()):
                at, sizes = own.places(texts)
                fine = whole(own.good, at, sizes)
                stops = np.cumsum(sizes)
                pairs, starts, many = own.all_pairs()
                doc = np.repeat(np.arange(len(texts)), sizes)
                keys, times = np.unique(np.repeat(doc * span, many[at]) + pairs[spread(starts[at], many[at])],
                                        return_counts=True)
                edges = np.searchsorted(keys, np.arange(len(texts) + 1) * span).tolist()
                sums = np.zeros((len(texts), len(COUNTS)), np.int64)
                np.add.at(sums, doc, own.sums[at])
                order = at.tolist()
                for d, (ok, i, j) in enumerate(zip(fine, (stops - sizes).tolist(), stops.tolist())):
                    if not ok:
                        rows.append((0,) * len(COUNTS) + ("", 0, b"", b""))
                        continue
                    digest = hashlib.sha256(b";".join([own.strings[x] for x in order[i:j]])).hexdigest()
                    lo, hi = edges[d], edges[d + 1]
                    rows.append((*sums[d].tolist(), digest, hi - lo, packed(keys[lo:hi] - d * span), packed(times[lo:hi])))
                if own.full():
                    own.forget()
            yield pd.DataFrame(rows, columns=[*COUNTS, "groups_sha256", "n_pairs", "pairs", "times"])
    return run


def added(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Packed pairs and times of documents -> (pair, n), added up per task."""
    held = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]

    def together() -> tuple[np.ndarray, np.ndarray]:
        keys, inverse = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
        n = np.zeros(len(keys), np.int64)
        np.add.at(n, inverse, np.concatenate([c for _, c in held]))
        return keys, n
    for part in parts:
        sizes = part["n_pairs"].to_numpy()
        held.append((unpacked(part["pairs"].tolist(), sizes), unpacked(part["times"].tolist(), sizes)))
        if sum(len(k) for k, _ in held) > PAIRS_HELD:
            held = [together()]
            if len(held[0][0]) > PAIRS_HELD // 2:
                yield pd.DataFrame({"pair": held[0][0], "n": held[0][1]})
                held = held[:0]
    if held:
        keys, n = together()
        yield pd.DataFrame({"pair": keys, "n": n})


def weigher(keys: np.ndarray, counts: np.ndarray, best: np.ndarray):
    """Packed pairs -> n_best and count_sum over the frequent ones, and the rarer ones."""
    @F.pandas_udf("n_best long, count_sum long, rare array<long>, rare_times array<long>")
    def run(n_pairs: pd.Series, pairs: pd.Series, times: pd.Series) -> pd.DataFrame:
        sizes = n_pairs.to_numpy(np.int64)
        p, t = unpacked(pairs.tolist(), sizes), unpacked(times.tolist(), sizes)
        at = np.minimum(np.searchsorted(keys, p), max(0, len(keys) - 1))
        hit = keys[at] == p if len(keys) else np.zeros(len(p), bool)
        doc = np.repeat(np.arange(len(sizes)), sizes)
        out = np.zeros((len(sizes), 2), np.int64)
        np.add.at(out[:, 0], doc[hit], t[hit] * best[at[hit]])
        np.add.at(out[:, 1], doc[hit], t[hit] * counts[at[hit]])
        edges = np.searchsorted(doc[~hit], np.arange(1, len(sizes)))
        return pd.DataFrame({"n_best": out[:, 0], "count_sum": out[:, 1], "rare": np.split(p[~hit], edges),
                             "rare_times": np.split(t[~hit], edges)})
    return run


def pair_counts(linked: DataFrame, n_b: int) -> DataFrame:
    """(pair, n, best): corpus-wide links of every id pair, with ``a * n_b + b`` as pair,
    and 1 where no other A id is linked more often with its B id."""
    counted = linked.select("n_pairs", "pairs", "times").mapInPandas(added, "pair long, n long")
    total = common.cut(counted.groupBy("pair").agg(F.sum("n").alias("n")), "align-pairs")
    b = F.pmod("pair", F.lit(n_b))
    # one row per id of vocabulary B at most
    top = total.groupBy(b.alias("b")).agg(F.max("n").alias("top"))
    return common.cut(total.join(F.broadcast(top), b == F.col("b")).select(
        "pair", "n", (F.col("n") == F.col("top")).cast("long").alias("best")), "align-counts")


def frequent_pairs(counts: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """``counts`` in two: the pairs above a power of two that at most ``most`` pairs
    reach, and the rest."""
    level = F.floor(F.log2("n")).cast("int")
    sizes = counts.groupBy(level.alias("level")).agg(F.count("*").alias("c")).collect()   # 63 rows at most
    edge, held = 64, 0
    for r in sorted(sizes, key=lambda r: -r["level"]):
        held += r["c"]
        if held > most:
            break
        edge = r["level"]
    return counts.where(level >= edge), counts.where(level < edge)


def align(docs: DataFrame, text: str = "text", a_file: str = A_FILE, b_file: str = B_FILE,
          frequent: int = FREQUENT, keep: list[str] | None = None) -> DataFrame:
    """Every row of ``docs`` with SUMS and ``groups_sha256``.

    ``frequent``: how many pairs' counts every task may hold; the result does not
    depend on it.  ``keep``: the columns of ``docs`` to return, by default all.
    """
    import sentencepiece
    common.python_ready(docs.sparkSession)
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in (*SUMS, "groups_sha256")]
    row, found = common.free_name(docs, "row"), common.free_name(docs, "found")
    run = aligner(a_file, b_file)
    linked = common.cut(docs.select(*[F.col(f"`{c}`") for c in kept], F.monotonically_increasing_id().alias(row),
                                    run(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias(found)), "align-linked")
    n_b = sentencepiece.SentencePieceProcessor(model_file=vocabulary_path(b_file)).get_piece_size()
    often, seldom = frequent_pairs(pair_counts(linked.select(f"{found}.*"), n_b), frequent)
    table = often.toPandas().sort_values("pair")         # at most ``frequent`` rows
    weigh = weigher(*(table[c].to_numpy(np.int64) for c in ("pair", "n", "best")))
    mine = F.struct(*[F.col(f"{found}.{c}") for c in (*COUNTS, "groups_sha256")],
                    weigh(*[F.col(f"{found}.{c}") for c in ("n_pairs", "pairs", "times")]).alias("w")).alias(found)
    weighed = common.cut(linked.select(*[F.col(f"`{c}`") for c in kept], row, mine), "align-weighed")
    rare = (weighed.select(F.col(row).alias("of"), F.explode(F.arrays_zip(
        F.col(f"{found}.w.rare").alias("pair"), F.col(f"{found}.w.rare_times").alias("times"))).alias("x"))
            .select("of", "x.pair", "x.times").join(seldom, "pair").groupBy("of")
            .agg(F.sum(F.col("times") * F.col("best")).alias("more_best"),
                 F.sum(F.col("times") * F.col("n")).alias("more_sum")))
    new = {c: F.col(f"d.{found}.{c}") for c in (*COUNTS, "groups_sha256")}
    new["n_best"] = F.col(f"d.{found}.w.n_best") + F.coalesce("r.more_best", F.lit(0))
    new["count_sum"] = F.col(f"d.{found}.w.count_sum") + F.coalesce("r.more_sum", F.lit(0))
    return weighed.alias("d").join(rare.alias("r"), F.col(f"d.{row}") == F.col("r.of"), "left").select(
        *[F.col(f"d.`{c}`") for c in kept], *[new[c].alias(c) for c in (*SUMS, "groups_sha256")])
