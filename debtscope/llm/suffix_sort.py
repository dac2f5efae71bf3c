"""Two-stage suffix sorting of short texts in one byte array."""

from __future__ import annotations

import numpy as np


def _words_at(text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Eight bytes from each place as one number in byte order."""
    return np.lib.stride_tricks.sliding_window_view(text, 8)[at].view(">u8").astype(np.uint64).ravel()


def smaller_than_next(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the one that starts a byte later; the last one counts as smaller."""
    step = np.sign(np.diff(text.astype(np.int16), append=256))
    n = len(text)
    changes = np.where(step != 0, np.arange(n), n)
    return step[np.minimum.accumulate(changes[::-1])[::-1]] > 0


def _direct(text: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """``at`` ordered by the ``depth`` bytes from each place, eight bytes a round; only ties go on."""
    key = _words_at(text, at)
    order = np.argsort(key, kind="stable")
    at, key = at[order], key[order]
    group = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])]) if len(at) else np.zeros(0, np.int64)
    tied = _ties(group)
    for done in range(8, depth, 8):
        if not len(tied):
            break
        key, mine = _words_at(text, at[tied] + done), group[tied]
        order = np.lexsort((key, mine))
        at[tied], key, mine = at[tied][order], key[order], mine[order]
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (mine[1:] != mine[:-1])])
        group[tied] = tied[np.maximum.accumulate(np.where(new, np.arange(len(tied)), 0))]
        tied = tied[_ties(group[tied])]
    return at


def _ties(group: np.ndarray) -> np.ndarray:
    same = group[1:] == group[:-1]
    return np.flatnonzero(np.concatenate([[False], same]) | np.concatenate([same, [False]]))


def suffix_order(text: np.ndarray, wanted: np.ndarray, depth: int) -> np.ndarray:
    """The ``wanted`` places in suffix order, right to ``depth`` bytes.

    ``text`` ends with ``depth`` + 8 spare bytes. First stage: suffixes that
    are smaller than their successors are sorted directly. Second stage: the
    buckets of first bytes are scanned upwards, and each suffix met puts the
    larger one that starts a byte before it at the head of that one's bucket,
    so the rest is induced without comparing. Only wanted places take part, and
    those up to the next directly sorted one that lead to them.
    """
    small = smaller_than_next(text)
    n = len(text)
    next_small = np.minimum.accumulate(np.where(small, np.arange(n), n - 1)[::-1])[::-1]
    ends = np.flatnonzero(wanted & ~np.append(wanted[1:], False))
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, ends, 1)
    np.add.at(change, np.where(small[ends], ends, next_small[ends]) + 1, -1)
    needed = wanted | (np.cumsum(change)[:n] > 0)

    direct = _direct(text, np.flatnonzero(needed & small), depth)
    bounds = np.searchsorted(text[direct], np.arange(257))
    larger = needed & ~small
    heads: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []
    for c in range(256):
        induced = heads[c]
        front = np.concatenate(induced) if induced else np.zeros(0, np.int64)
        bucket = [front]
        while len(front):  # runs of one byte put their members into the bucket being scanned
            front = front[front > 0] - 1
            front = front[larger[front] & (text[front] == c)]
            bucket.append(front)
        bucket.append(direct[bounds[c] : bounds[c + 1]])
        whole = np.concatenate(bucket)
        if not len(whole):
            continue
        out.append(whole)
        before = whole[whole > 0] - 1
        before = before[larger[before] & (text[before] > c)]
        if len(before):
            first = text[before]
            before = before[np.argsort(first, kind="stable")]
            cuts = np.searchsorted(text[before], np.arange(257))
            for b in np.flatnonzero(cuts[1:] > cuts[:-1]):
                heads[b].append(before[cuts[b] : cuts[b + 1]])
    order = np.concatenate(out) if out else np.zeros(0, np.int64)
    return order[wanted[order]]


def common_prefixes(text: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Common bytes of each place and the next one in the order, in steps of 8 up to ``depth``."""
    out = np.zeros(max(len(order) - 1, 0), np.int64)
    alike = np.arange(len(out))
    for done in range(0, depth, 8):
        if not len(alike):
            break
        same = _words_at(text, order[alike] + done) == _words_at(text, order[alike + 1] + done)
        alike = alike[same]
        out[alike] += 8
    return out


def repeated_starts(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of places of ``texts`` whose ``width`` bytes (a multiple of 8) start at another place too.

    Returns the number of the text, the first place of each run and its last.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    begins = np.cumsum(sizes) - sizes
    text = np.frombuffer(b"".join(texts) + bytes(width + 16), np.uint8)
    change = np.zeros(len(text) + 1, np.int64)
    long = sizes >= width
    np.add.at(change, begins[long], 1)
    np.add.at(change, (begins + sizes - width + 1)[long], -1)
    wanted = np.cumsum(change)[: len(text)] > 0
    order = suffix_order(text, wanted, width)
    alike = np.flatnonzero(common_prefixes(text, order, width) >= width)
    again = np.zeros(len(text) + 1, bool)
    again[order[alike]] = again[order[alike + 1]] = True
    firsts = np.flatnonzero(again[:-1] & ~np.concatenate([[False], again[:-2]]))
    lasts = np.flatnonzero(again[:-1] & ~again[1:])
    which = np.searchsorted(begins, firsts, "right") - 1
    return which, firsts - begins[which], lasts - begins[which]
