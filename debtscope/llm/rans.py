"""Static range asymmetric numeral coding of token ids, vectorised over lanes."""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"TIDS"
LANES = 16
BLOCK = 16_384
_LEAST = np.uint64(1 << 31)
_WORD = np.uint64(32)
_MASK = np.uint64((1 << 32) - 1)
_HEAD = struct.Struct("<4sHBxIQIII")


def quantised(counts: np.ndarray, bits: int) -> np.ndarray:
    """Frequencies of at least 1 that add up to 2**bits, close to the counts."""
    freq = np.maximum(counts * (1 << bits) // counts.sum(), 1).astype(np.int64)
    order = np.argsort(-freq, kind="stable")
    over = int(freq.sum()) - (1 << bits)
    if over < 0:
        freq[order[0]] -= over
    for k in order:
        if over <= 0:
            break
        cut = min(over, int(freq[k] - 1))
        freq[k] -= cut
        over -= cut
    return freq


def _counted(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct ids, the number of each id among them, and their counts."""
    top = int(ids.max())
    if top > 1 << 22:
        return np.unique(ids, return_inverse=True, return_counts=True)
    counts = np.bincount(ids, minlength=top + 1)
    symbols = np.flatnonzero(counts)
    number = np.zeros(top + 1, np.int64)
    number[symbols] = np.arange(len(symbols))
    return symbols.astype(ids.dtype), number[ids], counts[symbols]


def _tables(freq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return freq.astype(np.uint64), (np.cumsum(freq) - freq).astype(np.uint64)


def _shape(n: int) -> tuple[int, int]:
    blocks = -(-n // BLOCK)
    return blocks, -(-min(n, BLOCK) // LANES) if blocks else 0


def encode(ids: np.ndarray) -> bytes:
    """One segment: a frequency table shared by blocks that decode on their own.

    Each block has ``LANES`` interleaved coders. Its checkpoint is the place of
    its words and the lanes' states, its checksum the CRC-32 of its ids.
    """
    n = len(ids)
    blocks, steps = _shape(n)
    if not n:
        return _HEAD.pack(MAGIC, LANES, 0, BLOCK, 0, 0, 0, 0)
    symbols, at, counts = _counted(ids)
    bits = max(18, int(len(symbols)).bit_length() + 2)
    freq = quantised(counts, bits)
    f_of, c_of = _tables(freq)

    grid = np.zeros(blocks * BLOCK, np.int64)
    grid[:n] = at
    there = np.zeros(blocks * BLOCK, bool)
    there[:n] = True
    wide = (blocks, BLOCK // LANES, LANES)
    grid, there = (np.ascontiguousarray(a.reshape(wide).transpose(1, 0, 2)[:steps]).reshape(steps, -1) for a in (grid, there))
    state = np.full(blocks * LANES, _LEAST, np.uint64)
    words = np.zeros(grid.shape, np.uint32)
    sent = np.zeros(grid.shape, bool)
    limit, shift = np.uint64(63 - bits), np.uint64(bits)
    full = there.all(axis=1)
    for s in range(steps - 1, -1, -1):
        f, c = f_of[grid[s]], c_of[grid[s]]
        over = state >= (f << limit)
        if not full[s]:
            over &= there[s]
        words[s] = state & _MASK
        sent[s] = over
        x = np.where(over, state >> _WORD, state)
        q = x // f
        x = (q << shift) + (x - q * f) + c
        state = x if full[s] else np.where(there[s], x, state)
    by_block = sent.reshape(steps, blocks, LANES)
    sizes = by_block.sum(axis=(0, 2))
    stream = words.reshape(steps, blocks, LANES).transpose(1, 0, 2)[by_block.transpose(1, 0, 2)]
    sums = np.array([zlib.crc32(ids[b * BLOCK : (b + 1) * BLOCK].astype("<u4").tobytes()) for b in range(blocks)], "<u4")
    table = zlib.compress(np.diff(symbols, prepend=0).astype("<u4").tobytes() + freq.astype("<u4").tobytes(), 6)
    head = _HEAD.pack(MAGIC, LANES, bits, BLOCK, n, len(symbols), len(table), len(stream))
    index = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype("<u8").tobytes() + sums.tobytes() + state.astype("<u8").tobytes()
    return head + table + index + stream.astype("<u4").tobytes()


def decode(payload: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """Ids of the blocks ``first`` up to, not including, ``last``; checksums and final states are verified."""
    magic, lanes, bits, block, n, n_symbols, n_table, n_words = _HEAD.unpack_from(payload)
    if magic != MAGIC:
        raise ValueError("not a token segment")
    if not n:
        return np.zeros(0, np.uint32)
    at = _HEAD.size
    table = zlib.decompress(payload[at : at + n_table])
    symbols = np.cumsum(np.frombuffer(table, "<u4", n_symbols)).astype(np.uint32)
    freq = np.frombuffer(table, "<u4", n_symbols, n_symbols * 4).astype(np.int64)
    f_of, c_of = _tables(freq)
    slots = np.repeat(np.arange(n_symbols), freq)
    at += n_table
    blocks = -(-n // block)
    starts = np.frombuffer(payload, "<u8", blocks, at)
    sums = np.frombuffer(payload, "<u4", blocks, at + blocks * 8)
    states = np.frombuffer(payload, "<u8", blocks * lanes, at + blocks * 12).reshape(blocks, lanes)
    stream = np.frombuffer(payload, "<u4", n_words, at + blocks * (12 + 8 * lanes))
    last = blocks if last is None else min(last, blocks)
    some = last - first
    lengths = np.minimum(n - np.arange(first, last) * block, block)
    steps = int(-(-lengths.max() // lanes))
    state = states[first:last].astype(np.uint64)
    place = starts[first:last].astype(np.int64)
    out = np.zeros((steps, some, lanes), np.uint32)
    low, shift = np.uint64((1 << bits) - 1), np.uint64(bits)
    lane = np.arange(lanes)
    short = int(lengths.min()) // lanes
    for s in range(steps):
        slot = state & low
        k = slots[slot.astype(np.int64)]
        x = f_of[k] * (state >> shift) + slot - c_of[k]
        need = x < _LEAST
        if s >= short:
            there = s * lanes + lane[None, :] < lengths[:, None]
            need &= there
            x = np.where(there, x, state)
        out[s] = k
        if need.any():
            order = np.cumsum(need, axis=1)
            spot = place[:, None] + order - 1
            x[need] = (x[need] << _WORD) | stream[spot[need]].astype(np.uint64)
            place += order[:, -1]
        state = x
    if (state != _LEAST).any():
        raise ValueError("a coder did not end where it began: the segment is damaged")
    flat = out.transpose(1, 0, 2).reshape(some, steps * lanes)
    ids = symbols[flat[np.arange(steps * lanes)[None, :] < lengths[:, None]]]
    for b, (a, size) in enumerate(zip(np.cumsum(lengths) - lengths, lengths, strict=True)):
        if zlib.crc32(ids[a : a + size].astype("<u4").tobytes()) != int(sums[first + b]):
            raise ValueError(f"block {first + b} is damaged")
    return ids
