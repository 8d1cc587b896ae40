"""Numpy parts of substring deduplication: content-defined parsing and the run-length index."""

from __future__ import annotations

import numpy as np

#: Length of the grams whose minimum names a window's group.
GRAM = 32
_MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)
_BYTES = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)


def _pair(a: np.ndarray, b: np.ndarray, level: int) -> np.ndarray:
    h = (a * np.uint64(_MIX[level % 6]) + b) * np.uint64(_MIX[(level + 3) % 6] | 1)
    h ^= h >> np.uint64(29)
    return h


def gram_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all 32-byte and of all 64-byte strings of ``data``."""
    h, size = _BYTES[data], 1
    for level in range(5):
        h = _pair(h[: max(0, len(h) - size)], h[size:], level)
        size *= 2
    return h, _pair(h[: max(0, len(h) - 32)], h[32:], 5)


def parse(data: np.ndarray, valid: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Cut the window starts marked ``valid`` into segments by their windows' smallest gram.

    Returns ``key, content, start, count``: equal windows always lie in segments
    of the same key, and a segment holds its key's gram once, so no two windows
    of one segment are equal.  ``content`` is a hash of all bytes of a
    segment's windows.  Segments have at most ``window - GRAM + 1`` starts.
    """
    none = (np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    if len(data) < window or not valid.any():
        return none
    h32, h64 = gram_hashes(data)
    low, reach, wide = h32, 1, window - GRAM + 1
    while 2 * reach <= wide:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    if reach < wide:
        low = np.minimum(low[: len(low) - (wide - reach)], low[wide - reach :])
    valid = valid[: len(low)]
    fresh = np.ones(len(low), bool)
    fresh[1:] = (low[1:] != low[:-1]) | (h32[: len(low) - 1] == low[:-1]) | ~valid[:-1]
    starts = np.flatnonzero(fresh & valid)
    stop = np.r_[np.flatnonzero(fresh[1:] | ~valid[1:]) + 1, len(low)]
    last = stop[np.searchsorted(stop, starts, side="right")] - 1
    tail = last + window - 64
    middle = h64[(starts + tail) // 2]
    content = _pair(_pair(h64[starts], middle, 1), h64[tail], 2) + (last - starts).astype(np.uint64)
    return low[starts], content, starts, last - starts + 1


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Places of all suffixes in lexicographic order, by prefix doubling; symbols are not negative."""
    n = len(text)
    bits = int(text.max() + 1).bit_length()
    have = max(1, 62 // bits)
    padded = np.zeros(n + have, np.int64)
    padded[:n] = text + 1
    rank = np.zeros(n, np.int64)
    for k in range(have):
        rank = (rank << bits) | padded[k : k + n]
    while True:
        order = np.argsort(rank, kind="stable")
        ordered = rank[order]
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(np.r_[1, ordered[1:] != ordered[:-1]])
        if new[order[-1]] == n:
            return order
        after = np.zeros(n, np.int64)
        after[: max(0, n - have)] = new[have:]
        rank, have = new * (n + 1) + after, have * 2


class RunIndex:
    """Run-length Burrows-Wheeler transform of a text with the text places at its run ends.

    ``common`` are matching statistics of the text against its neighbour in
    suffix order.  They are compared symbol by symbol only at run heads; inside
    a run a value is its left neighbour's in the text less one, so repetitive
    text costs in proportion to its runs.  No two suffixes may be equal.
    """

    def __init__(self, text: np.ndarray) -> None:
        self.text = text
        order = self.order = suffix_array(text)
        before = np.where(order > 0, text[order - 1], -1)
        self.run_heads = np.flatnonzero(np.r_[True, before[1:] != before[:-1]])
        self.run_symbols = before[self.run_heads]
        self.first_places = order[self.run_heads]
        self.last_places = order[np.r_[self.run_heads[1:], len(order)] - 1]

    def common(self) -> np.ndarray:
        """Length of each suffix's match with the one before it in suffix order, by row."""
        n = len(self.text)
        sampled = np.full(n, -1)
        sampled[self.first_places[1:]] = self._match(self.first_places[1:], self.last_places[:-1])
        sampled[self.first_places[0]] = 0
        # Stream the samples along the text: one symbol less at every step.
        source = np.maximum.accumulate(np.where(sampled >= 0, np.arange(n), 0))
        return (sampled[source] - (np.arange(n) - source))[self.order]

    def _match(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        padded = np.r_[self.text, -2]
        length, live = np.zeros(len(a), np.int64), np.arange(len(a))
        while len(live):
            at = length[live]
            live = live[padded[a[live] + at] == padded[b[live] + at]]
            length[live] += 1
        return length


def earlier_windows(contexts: list[bytes], counts: np.ndarray, window: int, ids: np.ndarray, docs: np.ndarray) -> list[np.ndarray]:
    """For each context: which of its first ``counts`` windows occur at a smaller id or earlier in its document.

    Contexts are ordered by id, document and place.  They are concatenated
    behind separators and indexed; neighbours in suffix order that share a
    window form a class.  All but its first place are marked, and the first
    places of other documents that have the first one's id.
    """
    sizes = np.array([len(c) for c in contexts]) + 1
    begin = np.cumsum(sizes) - sizes
    # A separator of its own behind every context: matches end there, and no two suffixes are equal.
    text = np.frombuffer(b"\0".join(contexts) + b"\0", np.uint8).astype(np.int32) + len(contexts)
    text[begin + sizes - 1] = np.arange(len(contexts))
    owned = np.zeros(len(text) + 1, np.int64)
    np.add.at(owned, begin, 1)
    np.add.at(owned, begin + counts, -1)
    owned = np.cumsum(owned)[:-1] > 0
    index = RunIndex(text)
    place = np.where(owned[index.order], index.order, len(text))
    starts = np.flatnonzero(np.r_[True, index.common()[1:] < window])
    first = np.minimum.reduceat(place, starts)
    marked = np.zeros(len(text) + 1, bool)
    first = np.repeat(first, np.diff(np.r_[starts, len(place)]))
    marked[place] = place > first
    marked[-1] = False
    if (ids[1:] == ids[:-1]).any() and (docs[1:] != docs[:-1])[ids[1:] == ids[:-1]].any():
        id_, doc = (np.r_[np.repeat(x, sizes), 0] for x in (ids, docs))
        level = np.flatnonzero(marked[place] & (id_[place] == id_[first]) & (doc[place] != doc[first]))
        level = level[np.lexsort((place[level], doc[place[level]], first[level]))]
        own, of = doc[place[level]], first[level]
        fresh = np.ones(len(level), bool)
        fresh[1:] = (own[1:] != own[:-1]) | (of[1:] != of[:-1])
        marked[place[level[fresh]]] = False
    return [marked[b : b + c] for b, c in zip(begin, counts, strict=True)]
