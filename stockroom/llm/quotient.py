"""Counting quotient filters over fingerprints, built apart and merged without loss.

A fingerprint of ``bits`` bits is cut into a block (the unit that Spark shuffles), a
quotient and a remainder.  A filter of one block holds, in the order of (quotient,
remainder), one slot per distinct fingerprint: the remainder, whether it ends the run
of its quotient, and its count if above one.  Quotients that have a run are marked in
a bitmap.  Nothing is rounded away, so ``items`` gives back every fingerprint with its
count, and two filters merge by walking their sorted remainders.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np


class Filter(NamedTuple):
    """One block's filter; the fields are the columns of a filter table."""

    block: int
    quotient_bits: int
    occupied: bytes      # bit q: quotient q has a run
    run_ends: bytes      # bit i: slot i is the last of its run
    remainders: bytes    # of every slot, in as few whole bytes as hold them
    many: bytes          # bit i: slot i has a count above one
    counts: bytes        # the counts above one, in slot order


SCHEMA = ("block long, quotient_bits int, occupied binary, run_ends binary, remainders binary, "
          "many binary, counts binary")


def low(values: np.ndarray, n: int) -> np.ndarray:
    """The lowest n bits."""
    return values & np.uint64((1 << n) - 1)


def build(prints: np.ndarray, bits: int, block_bits: int, counts: np.ndarray | None = None) -> list[Filter]:
    """Filters, one per block, of unsigned fingerprints; with ``counts`` these are
    distinct and sorted already."""
    if counts is None:
        prints, counts = np.unique(prints, return_counts=True)
    blocks = (prints >> np.uint64(bits - block_bits)) if block_bits else np.zeros(len(prints), np.uint64)
    heads = np.flatnonzero(np.r_[True, blocks[1:] != blocks[:-1]]) if len(prints) else []
    return [_one(int(blocks[a]), prints[a:b], counts[a:b], bits - block_bits)
            for a, b in zip(heads, [*heads[1:], len(prints)])]


def _one(block: int, prints: np.ndarray, counts: np.ndarray, inner: int) -> Filter:
    q_bits = min(inner, int(len(prints)).bit_length())
    r_bits = inner - q_bits
    body = low(prints, inner)
    quotient = (body >> np.uint64(r_bits)).astype(np.int64) if r_bits < 64 else np.zeros(len(body), np.int64)
    occupied = np.zeros(1 << q_bits, np.uint8)
    occupied[quotient] = 1
    ends = np.r_[quotient[1:] != quotient[:-1], True]
    wide = low(body, r_bits).astype("<u8").view(np.uint8).reshape(-1, 8)
    return Filter(block, q_bits, np.packbits(occupied).tobytes(), np.packbits(ends).tobytes(),
                  wide[:, :_bytes(r_bits)].tobytes(), np.packbits(counts > 1).tobytes(),
                  counts[counts > 1].astype("<i8").tobytes())


def _bytes(r_bits: int) -> int:
    return max(1, -(-r_bits // 8))


def items(f: Filter, bits: int, block_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprints in ascending order, their counts)."""
    inner = bits - block_bits
    r_bits = inner - f.quotient_bits
    width = _bytes(r_bits)
    raw = np.frombuffer(f.remainders, np.uint8).reshape(-1, width)
    n = len(raw)
    wide = np.zeros((n, 8), np.uint8)
    wide[:, :width] = raw
    ends = np.unpackbits(np.frombuffer(f.run_ends, np.uint8), count=n).astype(np.int64)
    run = np.cumsum(ends) - ends
    runs = np.flatnonzero(np.unpackbits(np.frombuffer(f.occupied, np.uint8)))
    prints = wide.view("<u8").ravel().astype(np.uint64)
    if r_bits < 64:
        prints = prints | (runs[run].astype(np.uint64) << np.uint64(r_bits))
    if inner < 64:
        prints = prints | (np.uint64(f.block) << np.uint64(inner))
    counts = np.ones(n, np.int64)
    counts[np.unpackbits(np.frombuffer(f.many, np.uint8), count=n).astype(bool)] = np.frombuffer(f.counts, "<i8")
    return prints, counts


def merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Items of the union of filters, from the items of each: their sorted runs are
    merged and the counts of equal fingerprints added."""
    if len(parts) == 1:
        return parts[0]
    prints = np.concatenate([p for p, _ in parts])
    order = np.argsort(prints, kind="stable")       # a merge of sorted runs
    prints, counts = prints[order], np.concatenate([c for _, c in parts])[order]
    heads = np.flatnonzero(np.r_[True, prints[1:] != prints[:-1]])
    return prints[heads], np.add.reduceat(counts, heads)
