"""Patched frame-of-reference coding of token ids, all blocks of a chunk at once.

A block of 128 ids stores its minimum and, for each id, the low bits of its distance
from it, packed at the width that a percentile of the block needs; ids that need more
stand in an exception list by position and value.  An index of block starts lets a
reader jump to any block.
"""

from __future__ import annotations

import struct

import numpy as np

BLOCK = 128
#: magic, ids, blocks, words, exceptions
_HEAD = struct.Struct("<4sQIQQ")
_MAGIC = b"PFR1"


def _widths(x: np.ndarray) -> np.ndarray:
    """Bits that each value below 2**53 needs: the exponent of its float, 0 for 0."""
    return np.frexp(x.astype(np.float64))[1]


def pack(ids: np.ndarray, percentile: float = 0.9) -> bytes:
    """One self-describing chunk.  ``ids``: any number of unsigned 32-bit integers."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    full = np.zeros(blocks * BLOCK, np.uint32)
    full[:n] = ids
    if n:
        full[n:] = ids[-1]
    full = full.reshape(blocks, BLOCK)
    low = full.min(axis=1) if blocks else np.zeros(0, np.uint32)
    rest = (full - low[:, None]).astype(np.uint64)
    bits, place = _widths(rest), min(BLOCK - 1, int(percentile * BLOCK))
    width = np.partition(bits, place, axis=1)[:, place].astype(np.int64) if blocks else np.zeros(0, np.int64)
    starts = np.concatenate([[0], np.cumsum(2 * width)]).astype(np.uint32)  # in 64-bit words: 128 values of w bits are 2w words
    at = np.flatnonzero((bits > width[:, None]).ravel()).astype(np.uint32)
    values = full.ravel()[at]
    words = np.zeros(int(starts[-1]), np.uint64)
    for w in np.unique(width[width > 0]):
        mine = np.flatnonzero(width == w)
        kept = np.ascontiguousarray(rest[mine].T) & np.uint64((1 << int(w)) - 1)
        out = np.zeros((2 * int(w), len(mine)), np.uint64)
        for i in range(BLOCK):
            word, shift = divmod(i * int(w), 64)
            out[word] |= kept[i] << np.uint64(shift)
            if shift + w > 64:
                out[word + 1] |= kept[i] >> np.uint64(64 - shift)
        words[starts[mine][:, None] + np.arange(2 * int(w), dtype=np.uint32)] = out.T
    return b"".join([_HEAD.pack(_MAGIC, n, blocks, len(words), len(at)), low.astype("<u4").tobytes(), width.astype("u1").tobytes(), starts.astype("<u4").tobytes(), words.astype("<u8").tobytes(), at.astype("<u4").tobytes(), values.astype("<u4").tobytes()])


def unpack(chunk: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """The ids of a chunk, or of its blocks first..last-1 only, found by the index."""
    magic, n, blocks, n_words, n_over = _HEAD.unpack_from(chunk)
    if magic != _MAGIC:
        raise ValueError("not a chunk of token ids")
    take, pos = {}, _HEAD.size
    for name, kind, count in (("low", "<u4", blocks), ("width", "u1", blocks), ("starts", "<u4", blocks + 1), ("words", "<u8", n_words), ("at", "<u4", n_over), ("values", "<u4", n_over)):
        take[name] = np.frombuffer(chunk, kind, count, pos)
        pos += take[name].nbytes
    last = blocks if last is None else min(last, blocks)
    width = take["width"][first:last].astype(np.int64)
    out = np.repeat(take["low"][first:last].astype(np.uint64)[:, None], BLOCK, axis=1)
    for w in np.unique(width[width > 0]):
        mine = np.flatnonzero(width == w)
        got = take["words"][take["starts"][first + mine].astype(np.int64) + np.arange(2 * int(w))[:, None]]
        mask = np.uint64((1 << int(w)) - 1)
        part = np.empty((BLOCK, len(mine)), np.uint64)
        for i in range(BLOCK):
            word, shift = divmod(i * int(w), 64)
            part[i] = got[word] >> np.uint64(shift)
            if shift + w > 64:
                part[i] |= got[word + 1] << np.uint64(64 - shift)
        out[mine] += (part & mask).T
    flat = out.ravel().astype(np.uint32)
    a, b = np.searchsorted(take["at"], [first * BLOCK, last * BLOCK])
    flat[take["at"][a:b].astype(np.int64) - first * BLOCK] = take["values"][a:b]
    return flat[: max(0, n - first * BLOCK)]
