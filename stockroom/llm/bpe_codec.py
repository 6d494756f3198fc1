"""BPE encoding and decoding with forced-boundary splitting.

Two neighbouring byte symbols that are neighbours inside no vocabulary token can
never be merged: between them is a certain cut.  Pre-tokens are split at all
such places, the fragments are encoded independently (a fragment's merges never
look across a cut) and their ids concatenated.  The ids of known pre-tokens are kept in
a table of bounded size per task.

Normalising, pre-token pattern and word ends follow the vocabulary file: NFC,
white space runs as one space, lower case per character; letters, single digits
or other signs; the last symbol of a pre-token carries ``</w>``.

Decoding joins the token strings with single spaces, as the library does for a
file that names no decoder.

Defined cases: a null text is empty and has no ids; special strings inside a
text are one token each and split it; equal rows get equal ids; other columns
are kept (result columns replace equal names).
"""

from __future__ import annotations

import json
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockroom.llm import common
from stockroom.llm.merging import Merges, byte_letters, merge_all
from stockroom.llm.token_count import vocabulary_path

VOCABULARY = "word_bpe_49k.json"
# fixed value: the pre-token pattern named in the vocabulary file
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
KNOWN = 300_000
LONGEST_KEPT = 64
AT_ONCE = 1_000_000
# Characters whose classes and case are old enough to agree between Unicode tables;
# a text with any other is normalised and cut by the tokenizers library itself.
SETTLED = r"[^\x00-\u052f\u2010-\u2027\u20ac\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3]"
WORD_END = "</w>"


class Codec:
    """Encoder and decoder under one word-level vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        letters = byte_letters()
        byte_of = {c: b for b, c in letters.items()}
        self.symbol = np.array([vocab[letters[b]] for b in range(256)], np.int32)
        self.last = np.array([vocab[letters[b] + WORD_END] for b in range(256)], np.int32)
        pairs = [(vocab[a], vocab[b], vocab[a + b]) for a, b in spec["model"]["merges"]]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: t for t, i in {**vocab, **self.special}.items()}
        self.merges = Merges(pairs, max(self.names) + 1)
        self.joined = joined_pairs(vocab, byte_of)
        self.find = regex.compile(PATTERN).findall
        self.white = regex.compile(r"\s+")
        self.unsettled = regex.compile(SETTLED).search
        order = sorted(self.special, key=len, reverse=True)
        self.special_at = regex.compile("(" + "|".join(map(regex.escape, order)) + ")")
        self.path, self.library = path, None
        self.known: dict[str, tuple[bytes, str]] = {
            c: (array("I", [i]).tobytes(), c) for c, i in self.special.items()}

    def pre_tokens(self, text: str) -> list[str]:
        if self.unsettled(text):
            if self.library is None:
                from tokenizers import Tokenizer
                self.library = Tokenizer.from_file(self.path)
            plain = self.library.normalizer.normalize_str(text)
            return [plain[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(plain)]
        plain = self.white.sub(" ", unicodedata.normalize("NFC", text))
        # lower() gives a word-final sigma a form of its own; per character it has none
        return self.find(plain.replace("\u03a3", "\u03c3").lower())

    def cut(self, text: str) -> list[str]:
        """Pre-tokens and special strings of a whole text."""
        if "<|" not in text:
            return self.pre_tokens(text)
        out: list[str] = []
        for part in self.special_at.split(text):
            if part in self.special:
                out.append(part)
            elif part:
                out += self.pre_tokens(part)
        return out

    def fragments(self, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Lengths of the fragments of pre-tokens laid end to end; ``ends`` are the
        places of their last bytes."""
        cut = np.ones(len(data), bool)               # a fragment ends after this byte
        cut[:-1] = ~self.joined[data[:-1], data[1:]]
        cut[ends] = True
        return np.diff(np.r_[-1, np.flatnonzero(cut)])

    def encode_new(self, tokens: list[str]) -> None:
        """Put (ids, their token strings) of unknown pre-tokens into the table."""
        raw = [t.encode("utf-8", "replace") for t in tokens]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        data = np.frombuffer(b"".join(raw), np.uint8)
        ends = np.cumsum(sizes) - 1
        symbols = self.symbol[data]
        symbols[ends] = self.last[data[ends]]
        lengths = self.fragments(data, ends)
        ids, counts = merge_all(self.merges, symbols, lengths)
        stops = np.cumsum(counts)[np.searchsorted(np.cumsum(lengths) - 1, ends)].tolist()
        packed, listed, name, at = ids.astype("<u4").tobytes(), ids.tolist(), self.names, 0
        for t, stop in zip(tokens, stops):
            self.known[t] = (packed[4 * at:4 * stop], " ".join([name[i] for i in listed[at:stop]]))
            at = stop

    def encode(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """(ids as little-endian unsigned 32-bit, decoded text) of each text."""
        cuts = [self.cut(t) for t in texts]
        new = [t for t in set().union(*cuts) if t not in self.known] if cuts else []
        held, size = [], 0
        for t in new:
            held.append(t)
            size += len(t)
            if size >= AT_ONCE:
                self.encode_new(held)
                held, size = [], 0
        if held:
            self.encode_new(held)
        out = []
        for c in cuts:
            pairs = [self.known[t] for t in c]
            out.append((b"".join([p[0] for p in pairs]), " ".join([p[1] for p in pairs])))
        if len(self.known) > KNOWN:
            self.known = {c: self.known[c] for c in self.special}
        else:
            for t in new:
                if len(t) > LONGEST_KEPT:
                    del self.known[t]
        return out

    def decode(self, packed: bytes) -> str:
        return " ".join([self.names[i] for i in np.frombuffer(packed, "<u4").tolist()])


def joined_pairs(vocab: dict[str, int], byte_of: dict[str, int]) -> np.ndarray:
    """256 x 256: whether two bytes are neighbours inside some vocabulary token."""
    out = np.zeros((256, 256), bool)
    for token in vocab:
        b = [byte_of[c] for c in token.removesuffix(WORD_END)]
        out[b[:-1], b[1:]] = True
    return out


def coder(name: str):
    """A text expression -> struct<ids, decoded>."""
    @F.pandas_udf("ids binary, decoded string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = Codec(vocabulary_path(name))
        for texts in parts:
            whole = texts.tolist()
            out: list[tuple[bytes, str]] = []
            i = 0
            while i < len(whole):       # groups of about a million characters
                j, size = i, 0
                while j < len(whole) and (j == i or size + len(whole[j]) <= 1_000_000):
                    size += len(whole[j])
                    j += 1
                out += own.encode(whole[i:j])
                i = j
            yield pd.DataFrame(out, columns=["ids", "decoded"])
    return run


def encode(docs: DataFrame, text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """Every row of ``docs`` with ``ids`` (packed little-endian unsigned 32-bit
    integers), ``decoded`` and ``n_tokens``."""
    common.python_ready(docs.sparkSession)
    whole = F.coalesce(F.col(text), F.lit(""))
    out = common.put_struct(docs, coder(vocabulary)(whole), ["ids", "decoded"])
    return common.put(out, n_tokens=(F.octet_length("ids") / 4).cast("long"))


def ids_list(ids) -> list[int]:
    """Packed ids as a list."""
    return np.frombuffer(bytes(ids), "<u4").tolist()
