"""Token counts by rank-synchronous array merging of batched pre-tokens.

Texts are cut into pre-tokens by the vocabulary's pattern; the distinct ones of
a batch that are not yet known are laid out as ragged arrays of byte symbols and
merged together (``merging.merge_all``), and the symbols that survive are
counted.  Known pre-tokens are kept in a table of bounded size per task.

Defined cases: a null text is empty and has 0 bytes and 0 tokens; special
strings inside a text are one token each, as is the library's default; equal
rows get equal counts; other columns are kept (result columns replace equal
names).
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockroom.llm import common
from stockroom.llm.merging import Merges, byte_letters, merge_all

VOCABULARY = "byte_bpe_50k.json"
# fixed value: the pre-token pattern of byte-level vocabularies of this kind
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Characters whose classes are old enough to agree between Unicode tables; a text
# with any other is cut by the tokenizers library's own pattern.
SETTLED = r"[^\x00-\u052f\u2010-\u2027\u20ac\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3]"
KNOWN = 400_000         # pre-tokens a task keeps
LONGEST_KEPT = 64       # longer ones are counted but not kept
AT_ONCE = 2_000_000     # symbols merged together


def vocabulary_path(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


class Counter:
    """Counts tokens of texts under one byte-level vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        letters = byte_letters()
        self.symbol = np.array([vocab[letters[b]] for b in range(256)], np.int32)
        pairs = [(vocab[a], vocab[b], vocab[a + b]) for a, b in spec["model"]["merges"]]
        self.merges = Merges(pairs, max(vocab.values()) + 1)
        self.find = regex.compile(PATTERN).findall
        special = [t["content"] for t in spec["added_tokens"]]
        special.sort(key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.unsettled = regex.compile(SETTLED).search
        self.path, self.library = path, None
        self.known: dict[str, int] = {}

    def pre_tokens(self, text: str) -> list[str]:
        if not self.unsettled(text):
            return self.find(text)
        if self.library is None:
            from tokenizers import Tokenizer
            self.library = Tokenizer.from_file(self.path).pre_tokenizer
        return [text[a:b] for _, (a, b) in self.library.pre_tokenize_str(text)]

    def learn(self, tokens: list[str]) -> dict[str, int]:
        """Counts of distinct pre-tokens."""
        out, held, size = {}, [], 0
        for t in tokens:
            data = t.encode("utf-8", "replace")
            held.append((t, data))
            size += len(data)
            if size >= AT_ONCE:
                out.update(self._merged(held))
                held, size = [], 0
        if held:
            out.update(self._merged(held))
        return out

    def _merged(self, held: list[tuple[str, bytes]]) -> dict[str, int]:
        lengths = np.fromiter((len(d) for _, d in held), np.int64, len(held))
        symbols = self.symbol[np.frombuffer(b"".join(d for _, d in held), np.uint8)]
        _, counts = merge_all(self.merges, symbols, lengths)
        return dict(zip((t for t, _ in held), counts.tolist()))

    def counts(self, texts: list[str]) -> list[int]:
        cut, extra = [], []
        for t in texts:
            parts = [t]
            if self.special is not None and self.special.search(t):
                parts = self.special.split(t)
            cut.append([x for p in parts if p for x in self.pre_tokens(p)])
            extra.append(len(parts) - 1)
        known = self.known
        new = self.learn([x for x in set().union(*cut) if x not in known]) if cut else {}
        look = {**known, **new} if len(new) > len(known) else _Both(known, new)
        out = [sum(map(look.__getitem__, c)) + e for c, e in zip(cut, extra)]
        if len(known) + len(new) > KNOWN:
            known.clear()
        known.update((k, v) for k, v in new.items() if len(k) <= LONGEST_KEPT)
        return out


class _Both(dict):
    """The new counts, and behind them the known ones."""

    def __init__(self, known: dict, new: dict):
        super().__init__(new)
        self.known = known

    def __missing__(self, key):
        return self.known[key]


def counter(name: str):
    """A text expression -> its token count."""
    @F.pandas_udf("long")
    def tokens(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = Counter(vocabulary_path(name))
        for texts in parts:
            whole = texts.fillna("").tolist()
            out: list[int] = []
            i = 0
            while i < len(whole):       # groups of about a million characters
                j, size = i, 0
                while j < len(whole) and (j == i or size + len(whole[j]) <= 1_000_000):
                    size += len(whole[j])
                    j += 1
                out += own.counts(whole[i:j])
                i = j
            yield pd.Series(out, dtype="int64")
    return tokens


def count_tokens(docs: DataFrame, text: str = "text", vocabulary: str = VOCABULARY,
                 limit: int = 512) -> DataFrame:
    """Every row of ``docs`` with ``n_bytes``, ``n_tokens`` and ``over_limit``."""
    common.python_ready(docs.sparkSession)
    whole = F.coalesce(F.col(text), F.lit(""))
    out = common.put(docs, n_bytes=F.octet_length(whole).cast("long"),
                     n_tokens=counter(vocabulary)(whole))
    return common.put(out, over_limit=F.col("n_tokens") > limit)
