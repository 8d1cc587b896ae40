"""Word shingle sets and their signatures, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

WORDS = 5
#: Sets up to this size may differ from a partner in one shingle at most, or have a partner that small.
TINY = 6
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xFF51AFD7ED558CCD)
_SYMBOL = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_SYMBOL[65:91] = _SYMBOL[97:123]  # A-Z as a-z
_IN_WORD = np.ones(256, bool)
_IN_WORD[[9, 10, 11, 12, 13, 32]] = False


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _M1
    h = (h ^ (h >> np.uint64(29))) * _M2
    return h ^ (h >> np.uint64(32))


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of each word of ``data``."""
    edge = np.diff(np.r_[False, _IN_WORD[data], False].astype(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        return np.zeros(0, np.uint64), start
    size = end - start
    powers = np.cumprod(np.r_[np.uint64(1), np.full(int(size.max()), _M3 | np.uint64(1), np.uint64)])
    inside = _IN_WORD[data]
    at = np.where(inside, np.arange(len(data)) - np.repeat(np.r_[0, start], np.diff(np.r_[0, start, len(data)])), 0)
    terms = np.where(inside, _SYMBOL[data] * powers[at], np.uint64(0))
    return mix(np.add.reduceat(terms, start) + size.astype(np.uint64)), start


def shingle_sets(texts: list[str | None], words: int = WORDS, chunk: int = 1 << 20) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; fewer words than a shingle has are one shingle."""
    at = 0
    while at < len(texts):
        parts, size = [], 0
        while at < len(texts) and (not parts or size < chunk):
            parts.append((texts[at] or "").encode("utf-8", "surrogatepass"))
            size += len(parts[-1]) + 1
            at += 1
        hashes, start = word_hashes(np.frombuffer(b"\n".join(parts) + b"\n", np.uint8))
        ends = np.cumsum([len(p) + 1 for p in parts])
        bounds = np.searchsorted(start, np.r_[0, ends])
        for low, high in zip(bounds, bounds[1:], strict=False):
            own = hashes[low:high]
            n = max(0, len(own) - words + 1) or min(1, len(own))
            total = np.full(n, len(own) if len(own) < words else words, np.uint64)
            for k in range(min(words, len(own))):
                total = (total + own[k : k + n]) * (_M3 | np.uint64(1))
                total ^= total >> np.uint64(30)
            yield np.unique(mix(total))


def set_hash(shingles: np.ndarray) -> int:
    total = mix(shingles).sum(dtype=np.uint64, keepdims=True) + np.array([len(shingles)], np.uint64) * _M2
    return int(mix(total)[0].view(np.int64))


def sketch(shingles: np.ndarray) -> bytes:
    """A bitmap of about four bits a shingle; its length is a power of two."""
    bits = 4 << max(1, int(len(shingles) - 1).bit_length())
    at = np.zeros(bits, np.uint8)
    at[(mix(shingles ^ _M1) & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(at, bitorder="little").tobytes()


def most_common(a: bytes, n_a: int, b: bytes, n_b: int) -> int:
    """An upper bound of the shingles two sets share: a bit that only one has stands for one it does not share."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    size = min(len(x), len(y))
    x, y = np.bitwise_or.reduce(x.reshape(-1, size)), np.bitwise_or.reduce(y.reshape(-1, size))
    return min(n_a - int(np.bitwise_count(x & ~y).sum()), n_b - int(np.bitwise_count(y & ~x).sum()))


def _subset_signatures(shingles: np.ndarray, segments: int, salt: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signature of each non-empty segment, and its shingles' order and bounds in it."""
    spread = mix(shingles + np.array([salt], np.uint64) * _M2)
    segment = spread % np.uint64(segments) if segments else spread
    order = np.argsort(segment, kind="stable")
    segment = segment[order]
    starts = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]])
    sums = np.add.reduceat(mix(shingles[order] ^ _M3), starts)
    return mix(sums + segment[starts] * _M1 + np.uint64(salt)), order, starts


def signatures(shingles: np.ndarray, hot: np.ndarray, uses: np.ndarray) -> np.ndarray:
    """What a set files itself under: any set with Jaccard similarity of 3/4 or more files under one of them too.

    Such sets differ in at most a seventh of their sizes' sum, so in at most
    ``n // 3`` shingles.  The universe is hashed into as many segments as the
    size band's upper end has shingles; each difference spoils one segment, so
    of the ``n // 3 + 1`` least used non-empty segment subsets of either set one
    is shared.  ``hot`` and ``uses`` are the frequent shingles (sorted) and
    their number of uses: they only set the order, which is the same for equal
    subsets.  Tiny sets differ in one shingle at most; they file under the whole
    set and its one-deletion neighbours instead, which is cheaper there.
    """
    n, out = len(shingles), []
    if not n:
        return np.zeros(0, np.uint64)
    if n <= TINY:
        part = mix(shingles ^ _M3)
        whole = part.sum(dtype=np.uint64, keepdims=True)
        out.append(mix(np.r_[whole, whole - part if n > 1 else part[:0]] + np.uint64(7)))
    if n >= TINY:
        band = int(np.log2(n)) // 2
        top = 4 ** (band + 1)
        for b in (band, band + 1) if 4 * n >= 3 * top else (band,):
            upper = 4 ** (b + 1)
            signature, order, starts = _subset_signatures(shingles, upper if upper > 64 else 0, 100 + b)
            most = (n + min(4 * n // 3, top - 1)) // 7 if b == band else n // 3
            if len(signature) > most + 1:
                cost = np.zeros(len(signature))
                if len(hot):
                    at = np.minimum(np.searchsorted(hot, shingles[order]), len(hot) - 1)
                    cost = np.minimum.reduceat(np.where(hot[at] == shingles[order], uses[at], 0), starts)
                signature = signature[np.lexsort((signature, cost))[: most + 1]]
            out.append(signature)
    return np.concatenate(out)
