"""Byte-pair merging of many symbol sequences at once, in numpy.

All sequences lie end to end in one array.  In every round each sequence finds
its lowest-rank adjacent pair and merges all its occurrences from left to right
at the same time; a sequence without a mergeable pair is done and leaves the
round.  In a learned vocabulary a pair that contains a merged symbol ranks after
the pair that made it, so this gives the same symbols as merging one at a time.
"""

from __future__ import annotations

import numpy as np

NONE = np.int64(1) << 40       # rank of a pair that is not in the vocabulary


class Merges:
    """Pair -> (rank, merged symbol), as sorted keys for binary search."""

    def __init__(self, pairs: list[tuple[int, int, int]], n_symbols: int):
        self.n = np.int64(n_symbols)
        keys = np.array([a * n_symbols + b for a, b, _ in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.rank = keys[order], order.astype(np.int64)
        self.made = np.array([m for _, _, m in pairs], np.int32)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) * self.n + right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.rank[at], NONE)


def merge_all(merges: Merges, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols left of every sequence and their counts, both in the given order.

    ``symbols``: the sequences end to end; ``lengths``: their lengths, at least 1.
    """
    counts = lengths.astype(np.int64).copy()
    if not len(counts):
        return symbols[:0], counts
    sym = symbols.astype(np.int32)
    owner = np.repeat(np.arange(len(counts)), counts)
    done_sym: list[np.ndarray] = []
    done_own: list[np.ndarray] = []
    rank = pair_ranks(merges, sym, owner)
    while len(sym):
        heads = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        low = np.minimum.reduceat(rank, heads)
        live = np.repeat(low < NONE, np.diff(np.r_[heads, len(sym)]))
        if not live.all():
            done_sym.append(sym[~live])
            done_own.append(owner[~live])
            sym, owner, rank = sym[live], owner[live], rank[live]
            if not len(sym):
                break
            heads = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            low = low[low < NONE]
        sizes = np.diff(np.r_[heads, len(sym)])
        hit = rank == np.repeat(low, sizes)
        # in a run of overlapping hits (a a a ...) every second one, from the left
        at = np.flatnonzero(hit)
        first = np.r_[True, at[1:] != at[:-1] + 1]
        start = np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
        at = at[(np.arange(len(at)) - start) % 2 == 0]
        sym[at] = merges.made[rank[at]]
        stay = np.ones(len(sym), bool)
        stay[at + 1] = False
        # only pairs beside a merge have a new rank
        moved = np.cumsum(stay) - 1
        sym, owner, rank = sym[stay], owner[stay], rank[stay]
        new = moved[at]
        touched = np.unique(np.r_[new, new[new > 0] - 1])
        inner = touched[touched + 1 < len(sym)]
        rank[touched] = NONE
        same = inner[owner[inner] == owner[inner + 1]]
        rank[same] = merges.ranks(sym[same], sym[same + 1])
    out_sym, out_own = np.concatenate(done_sym), np.concatenate(done_own)
    order = np.argsort(out_own, kind="stable")
    return out_sym[order], np.bincount(out_own, minlength=len(counts))


def pair_ranks(merges: Merges, sym: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Rank of the pair that starts at each place; NONE at the end of a sequence."""
    rank = np.full(len(sym), NONE)
    if len(sym) > 1:
        inner = owner[1:] == owner[:-1]
        found = merges.ranks(sym[:-1], sym[1:])
        rank[:-1] = np.where(inner, found, NONE)
    return rank


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies:
    printable Latin-1 bytes stand for themselves, the others follow from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in plain}
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + len(out) - len(plain))
    return out
