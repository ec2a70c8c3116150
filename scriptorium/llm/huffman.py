"""Canonical length-limited Huffman codes over token ids, vectorised with numpy."""

from __future__ import annotations

import struct

import numpy as np

#: Longest code, unless more ids are in use than there are codes of that length.
MOST_BITS = 16
#: Longest code at all: a table of that many bits is what a reader must hold.
WIDEST = 24
MAGIC = b"HUFB"
#: Ids between two bit-offset checkpoints.
STEP = 64
_HEAD = struct.Struct("<4sIQ")


def code_lengths(counts: np.ndarray, most: int = MOST_BITS) -> np.ndarray:
    """Optimal code lengths by package-merge; zero for unused ids.

    Codes have at most `most` bits, or as many as it takes to tell all used ids apart; a
    vocabulary with over 2**WIDEST ids in use is refused.
    """
    counts = np.asarray(counts, dtype=np.float64)
    used = np.flatnonzero(counts > 0)
    lengths = np.zeros(len(counts), dtype=np.uint8)
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    most = max(most, (len(used) - 1).bit_length())
    if most > WIDEST:
        raise ValueError(f"more than {1 << WIDEST} ids in use")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order]
    levels, packages = [], np.zeros(0)
    for _ in range(most):
        merged = np.concatenate([leaves, packages])
        is_leaf = np.arange(len(merged)) < len(leaves)
        by = np.argsort(merged, kind="stable")
        levels.append(is_leaf[by])
        merged = merged[by]
        pairs = len(merged) // 2
        packages = merged[: 2 * pairs].reshape(-1, 2).sum(axis=1)
    take = 2 * len(used) - 2
    for is_leaf in reversed(levels):
        n_leaves = int(is_leaf[:take].sum())
        lengths[order[:n_leaves]] += 1
        take = 2 * (take - n_leaves)
    return lengths


def _bits(lengths: np.ndarray) -> int:
    """Bits of the longest code."""
    return max(1, int(lengths.max(initial=0)))


def _lanes(bits: int) -> int:
    """Bytes that hold a code of that many bits wherever in a byte it begins."""
    return (bits + 14) // 8


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """The code of each id: by length, then id, counted up."""
    bits = _bits(lengths)
    codes = np.zeros(len(lengths), dtype=np.uint32)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    if len(order):
        sizes = lengths[order].astype(np.int64)
        steps = np.left_shift(1, bits - sizes)
        codes[order] = (np.concatenate([[0], np.cumsum(steps)[:-1]]) >> (bits - sizes)).astype(np.uint32)
    return codes


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every window of as many bits as the longest code: the id whose code it begins with, and that code's length."""
    bits = _bits(lengths)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    spans = np.left_shift(1, bits - lengths[order].astype(np.int64))
    symbol = np.zeros(1 << bits, dtype=np.uint32)
    size = np.ones(1 << bits, dtype=np.uint8)
    total = int(spans.sum())
    symbol[:total] = np.repeat(order, spans)
    size[:total] = np.repeat(lengths[order], spans)
    return symbol, size


def encode_block(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> bytes:
    """A block: magic, STEP, count, checkpoints (bit offset of every STEP-th id), bits."""
    size = lengths[ids].astype(np.int64)
    ends = np.cumsum(size)
    begins = ends - size
    bits = int(ends[-1]) if len(ids) else 0
    lanes = _lanes(_bits(lengths))
    shifted = codes[ids].astype(np.int64) << (8 * lanes - size - (begins & 7))
    at = begins >> 3
    n = (bits + 7) // 8 + lanes
    out = np.zeros(n)
    for lane in range(lanes):
        out += np.bincount(at + lane, weights=(shifted >> (8 * (lanes - 1 - lane))) & 0xFF, minlength=n)[:n]
    return _HEAD.pack(MAGIC, STEP, len(ids)) + begins[::STEP].astype("<u8").tobytes() + out.astype(np.uint8).tobytes()


def decode_block(block: bytes, symbol: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The ids of a block; all stretches between checkpoints advance together."""
    magic, step, n = _HEAD.unpack_from(block)
    if magic != MAGIC:
        raise ValueError("not a block of this format")
    marks = -(-n // step)
    at = np.frombuffer(block, dtype="<u8", count=marks, offset=_HEAD.size).astype(np.int64)
    data = np.frombuffer(block, dtype=np.uint8, offset=_HEAD.size + 8 * marks)
    bits = len(symbol).bit_length() - 1
    lanes = _lanes(bits)
    padded = np.zeros(len(data) + lanes, dtype=np.uint32)
    padded[: len(data)] = data
    wide = padded[: len(data) + 1].copy()
    for lane in range(1, lanes):
        wide = (wide << 8) | padded[lane : len(data) + 1 + lane]
    out = np.zeros((step, marks), dtype=np.uint32)
    last = len(wide) - 1
    for k in range(min(step, n)):
        window = (wide[np.minimum(at >> 3, last)] >> (8 * lanes - bits - (at & 7)).astype(np.uint32)) & (len(symbol) - 1)
        out[k] = symbol[window]
        at += size[window]
    return out.T.ravel()[:n]
