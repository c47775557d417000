"""Simple-8b: integers packed into 64-bit words, the selector in the top four bits.

A selector says how many values of how many bits a word holds. Values of more than 60 bits go to a list of escapes, and a word
with selector 0 holds their place in it. Values are coded in blocks of ``BLOCK``, each block begins a new word, and the word
offsets of the blocks are kept, so that all words of a file decode at once.
"""
from __future__ import annotations

import numpy as np

BLOCK = 1024
ESCAPE = 0
#: Values in a word and bits of each, by selector. Fixed values of the format.
COUNTS = np.array([1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1], dtype=np.int64)
BITS = np.array([0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60], dtype=np.uint64)
_PAD = int(COUNTS.max())
_LOW60 = np.uint64((1 << 60) - 1)


def _widths(values: np.ndarray) -> np.ndarray:
    """Bits that each value needs, 1 at least."""
    if values.size and values.max() < 1 << 53:  # the exponent of such a number as a double
        return np.maximum(np.frexp(values.astype(np.float64))[1], 1).astype(np.uint8)
    out = np.ones(values.shape, dtype=np.uint8)
    for bits in range(1, 64):
        over = values >> np.uint64(bits)
        if not over.any():
            break
        out += over != 0
    return out


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """words (uint64), word offset of each block (int64, one more than blocks), escapes (uint64)."""
    values = np.asarray(values, dtype=np.uint64)
    n = len(values)
    blocks = -(-n // BLOCK)
    padded = np.zeros((blocks, BLOCK + _PAD), dtype=np.uint64)
    flat = np.zeros(blocks * BLOCK, dtype=np.uint64)
    flat[:n] = values
    padded[:, :BLOCK] = flat.reshape(blocks, BLOCK)
    width = _widths(padded)
    longest = {1: width}
    size = 1
    while size < _PAD:  # the widest of the next 2, 4, 8 ... values
        w = longest[size].copy()
        w[:, :-size] = np.maximum(w[:, :-size], longest[size][:, size:])
        longest[2 * size] = w
        size *= 2
    fitting = np.zeros(width.shape, dtype=np.uint8)  # a word of fewer, wider values fits wherever one of more values does
    for s in range(1, len(COUNTS)):
        count = int(COUNTS[s])
        base = 1 << (count.bit_length() - 1)
        w = longest[base]
        if count > base:
            w = w.copy()
            w[:, :-(count - base)] = np.maximum(w[:, :-(count - base)], longest[base][:, count - base:])
        fitting += w <= BITS[s].astype(np.uint8)
    selector = np.where(fitting > 0, len(COUNTS) - fitting, ESCAPE)  # more values in a word win
    lengths = np.full(blocks, BLOCK, dtype=np.int64)
    if blocks:
        lengths[-1] = n - BLOCK * (blocks - 1)
    at, rows = np.zeros(blocks, dtype=np.int64), np.arange(blocks)
    picked_rows, picked_at, picked_sel = [], [], []
    while len(rows):  # one word of every block that is not done
        sel = selector[rows, at]
        picked_rows.append(rows)
        picked_at.append(at)
        picked_sel.append(sel)
        at = at + COUNTS[sel]
        left = at < lengths[rows]
        rows, at = rows[left], at[left]
    if not blocks:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64), np.zeros(0, np.uint64)
    row, at, sel = np.concatenate(picked_rows), np.concatenate(picked_at), np.concatenate(picked_sel)
    order = np.argsort(row, kind="stable")  # within a block they are in order already
    row, at, sel = row[order], at[order], sel[order]
    words = sel.astype(np.uint64) << np.uint64(60)
    escapes = np.zeros(0, np.uint64)
    for s in range(len(COUNTS)):
        mine = np.flatnonzero(sel == s)
        if not len(mine):
            continue
        if s == ESCAPE:
            escapes = padded[row[mine], at[mine]]
            words[mine] |= np.arange(len(mine), dtype=np.uint64)
            continue
        for k in range(int(COUNTS[s])):
            words[mine] |= padded[row[mine], at[mine] + k] << np.uint64(k * int(BITS[s]))
    offsets = np.searchsorted(row, np.arange(blocks + 1)).astype(np.int64)
    return words, offsets, escapes


def decode(words: np.ndarray, offsets: np.ndarray, escapes: np.ndarray, n: int) -> np.ndarray:
    """The first n values; the inverse of ``encode``."""
    blocks = len(offsets) - 1
    if not blocks:
        return np.zeros(0, np.uint64)
    selector = (words >> np.uint64(60)).astype(np.int64)
    counts = COUNTS[selector]
    before = np.cumsum(counts) - counts
    block = np.repeat(np.arange(blocks), np.diff(offsets))
    place = before - before[offsets[:-1]][block] + block * (BLOCK + _PAD)
    out = np.zeros(blocks * (BLOCK + _PAD), dtype=np.uint64)
    body = words & _LOW60
    for s in range(len(COUNTS)):
        mine = np.flatnonzero(selector == s)
        if not len(mine):
            continue
        if s == ESCAPE:
            out[place[mine]] = escapes[body[mine].astype(np.int64)]
            continue
        mask = np.uint64((1 << int(BITS[s])) - 1)
        for k in range(int(COUNTS[s])):
            out[place[mine] + k] = (body[mine] >> np.uint64(k * int(BITS[s]))) & mask
    return out.reshape(blocks, BLOCK + _PAD)[:, :BLOCK].reshape(-1)[:n]
