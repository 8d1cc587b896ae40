"""Packing token sequences by fitted length patterns.

Only the histogram of piece lengths, as many counters as a sequence has tokens,
reaches the driver.  There, patterns of two or three lengths that fill a
sequence are enumerated, non-negative least squares gives how often each is
used, the numbers are rounded down, and what is left is packed best-fit in
batches of equal patterns.  Pieces find their place by their rank among pieces
of the same length, so no task ever holds the pieces of a length or a sequence.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docketlake.llm.common import bound_batches, materialise, once_a_worker, shuffle_partitions

VOCABULARY = "byte_bpe_50k"
CAPACITY = 1024
END_ID = 2
#: Pre-tokens whose ids a worker remembers.
REMEMBERED = 300_000
#: Patterns the fit chooses from.
PATTERNS = 20_000

# The splitting rule of the vocabulary for characters below U+0180.
_LETTERS = "a-zA-ZªµºÀ-ÖØ-öø-ſ"
_NUMBERS = "0-9²³¹¼-¾"
_SPACES = r"\t-\r \x85\xa0"
_END_OF_TEXT = "<|endoftext|>"
_END_OF_TEXT_ID = 50256


class TokenIds:
    """Ids of texts as little-endian unsigned 32-bit numbers, remembered by pre-token."""

    def __init__(self, path: str | None = None) -> None:
        import base64

        import public_tokenizers
        import tiktoken

        with open(path or public_tokenizers.path(f"{VOCABULARY}.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        coder = tiktoken.Encoding("ids", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

        class Remembered(dict):
            def __missing__(self, part: str) -> bytes:
                ids = array("I", coder.encode_ordinary(part)).tobytes()
                if len(self) < REMEMBERED:
                    self[part] = ids
                return ids

        self.ids, self.coder = Remembered(), coder
        n, w, s = _NUMBERS, _LETTERS, _SPACES
        self.parts = re.compile(
            rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{w}]+| ?[{n}]+| ?[^{s}{w}{n}]+|[{s}]+(?![^{s}])|[{s}]+"
        ).findall
        self.beyond = re.compile("[^\u0000-ſ]").search

    def plain(self, text: str) -> bytes:
        """Ids of a text in which special strings are ordinary text."""
        if self.beyond(text):
            return array("I", self.coder.encode_ordinary(text)).tobytes()
        return b"".join(map(self.ids.__getitem__, self.parts(text)))

    def encode(self, text: str) -> bytes:
        if _END_OF_TEXT not in text:
            return self.plain(text)
        return array("I", [_END_OF_TEXT_ID]).tobytes().join(map(self.plain, text.split(_END_OF_TEXT)))


def coder_of(path: str | None) -> TokenIds:
    """One coder, and what it remembers, for all tasks of a worker."""
    return once_a_worker(f"token ids of {path}", lambda: TokenIds(path))


_PIECES = pa.schema([("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def _cut(capacity: int, end_id: int, path: str | None):
    end = array("I", [end_id]).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_of(path)
        for batch in batches:
            texts, rows = batch.column("text").to_pylist(), []
            for at, text in enumerate(texts):
                ids = coder.encode(text or "") + end
                total = len(ids) // 4
                first = (total - 1) % capacity + 1
                borders = [0, *range(first, total + 1, capacity)]
                for piece, (low, high) in enumerate(zip(borders, borders[1:], strict=False)):
                    rows.append((at, piece, low, high - low, zlib.crc32(ids[4 * low : 4 * high])))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            at = pa.array(columns[0], pa.int64())
            others = [c.take(at) for n, c in zip(batch.schema.names, batch.columns, strict=True) if n != "text"]
            made = [pa.array(c, f.type) for c, f in zip(columns[1:], _PIECES, strict=True)]
            names = [n for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*others, *made], [*names, *_PIECES.names])

    return run


def cut_pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, path: str | None = None) -> DataFrame:
    """One row per piece of a document: other columns but ``text``, ``piece, start, length, ids_crc32``."""
    rest = docs.drop(*_PIECES.names)
    rest = rest.select(*[F.col(f"`{c}`") for c in rest.columns if c != "text"], "text")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema if f.name != "text")
    made = "piece int, start long, length long, ids_crc32 long"
    return rest.mapInArrow(_cut(capacity, end_id, path), f"{kinds}, {made}" if kinds else made)


def patterns(lengths: np.ndarray, capacity: int, most: int = PATTERNS) -> np.ndarray:
    """Two or three of the given lengths that fill a sequence, as rows of indexes (-1: no third).

    The triples are thinned evenly by their smallest length if there are more
    than ``most``; they only guide the fit, every piece is packed anyway.
    """
    where = np.full(capacity + 1, -1)
    where[lengths] = np.arange(len(lengths))
    pairs = [(i, where[capacity - a], -1) for i, a in enumerate(lengths) if 2 * a >= capacity > a and where[capacity - a] >= 0]
    a, b = np.meshgrid(lengths, lengths, indexing="ij")
    c = capacity - a - b
    at = (a >= b) & (b >= c) & (c > 0)
    a, b, c = a[at], b[at], c[at]
    at = where[c] >= 0
    triples = np.stack([where[a[at]], where[b[at]], where[c[at]]], axis=1)
    triples = triples[np.argsort(triples[:, 2], kind="stable")][:: max(1, -(-len(triples) // most))]
    return np.concatenate([np.array(pairs, np.int64).reshape(-1, 3), triples])


def fit_repeats(pattern: np.ndarray, counts: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Non-negative least squares of pattern repeats to length counts, by accelerated projected gradients."""
    n, third = len(counts), pattern[:, 2] >= 0
    index = np.where(pattern >= 0, pattern, n)
    used = np.bincount(index.ravel(), minlength=n + 1)[:n].max(initial=1)
    step, x, t = 1.0 / (3.0 * used), np.zeros(len(pattern)), 1.0
    y = x
    for _ in range(rounds):
        filled = sum(np.bincount(index[:, k], weights=y, minlength=n + 1) for k in range(3))
        left = np.append(counts - filled[:n], 0.0)
        slope = left[index[:, 0]] + left[index[:, 1]] + np.where(third, left[index[:, 2]], 0.0)
        new = np.maximum(0.0, y + step * slope)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, x, t = new + (t - 1) / t_new * (new - x), new, t_new
    return x


def plan_sequences(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """Patterns (lengths of a sequence's pieces) and how many sequences follow each; they use every piece once.

    Fits with and without triples, and the residual packing of everything, are
    rounded and completed; the plan with the fewest sequences counts.
    """
    plans = [_plan(histogram, capacity, most) for most in (3, 2, 0)]
    return min(plans, key=lambda plan: sum(times for _, times in plan))


def _plan(histogram: dict[int, int], capacity: int, most: int) -> list[tuple[list[int], int]]:
    left = np.zeros(capacity + 1, np.int64)
    for length, count in histogram.items():
        left[length] = count
    plan: list[tuple[list[int], int]] = []

    def use(chosen: list[int], times: int) -> None:
        plan.append((chosen, times))
        for length in chosen:
            left[length] -= times

    if left[capacity]:
        use([capacity], int(left[capacity]))
    lengths = np.flatnonzero(left)
    if len(lengths) and most:
        pattern = patterns(lengths, capacity)
        pattern = pattern[(pattern >= 0).sum(1) <= most]
        repeats = fit_repeats(pattern, left[lengths].astype(float)) if len(pattern) else np.zeros(0)
        for k in np.argsort(-repeats, kind="stable"):
            chosen = [int(lengths[i]) for i in pattern[k] if i >= 0]
            times = min([int(repeats[k]), *(int(left[v]) // chosen.count(v) for v in chosen)])
            if times > 0:
                use(chosen, times)
    while left.any():
        # Best fit: the longest piece, then again and again the longest that still fits.
        chosen, room, free = [], capacity, left.copy()
        while room and (fits := np.flatnonzero(free[: room + 1])).size:
            chosen.append(int(fits[-1]))
            free[chosen[-1]] -= 1
            room -= chosen[-1]
        use(chosen, min(int(left[v]) // chosen.count(v) for v in set(chosen)))
    return plan


def _places(plan: list[tuple[list[int], int]]) -> np.ndarray:
    """Rows ``length, first rank, sequence of that rank, offset``, by length and rank."""
    rows, used, sequence = [], {}, 0
    for chosen, times in plan:
        offset = 0
        for length in chosen:
            rows.append((length, used.get(length, 0), sequence, offset))
            used[length] = used.get(length, 0) + times
            offset += length
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def pack(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, path: str | None = None) -> DataFrame:
    """``cut_pieces`` with ``sequence_id`` and the piece's gapless ``offset`` in that sequence.

    A document is its ids and ``end_id``; a null or empty text is ``end_id``
    alone.  Only documents longer than ``capacity`` are cut, their first piece
    takes what the others leave.  Repeated rows are packed like any others; no
    rows give no rows.  Columns named like the new ones are replaced.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    slices = shuffle_partitions(spark)
    pieces = cut_pieces(docs.drop("sequence_id", "offset"), capacity, end_id, path)
    pieces = materialise(pieces.withColumn("_row", F.monotonically_increasing_id()))
    sliced = pieces.withColumn("_slice", F.pmod(F.xxhash64("_row"), F.lit(slices)))
    counts = materialise(sliced.groupBy("length", "_slice").agg(F.count("*").alias("n")))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = spark.sparkContext.broadcast(_places(plan_sequences(histogram, capacity)))

    before = Window.partitionBy("length").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "_slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base"))
    inside = F.row_number().over(Window.partitionBy("length", "_slice").orderBy("_row")) - 1
    ranked = sliced.withColumn("_rank", inside).join(base, ["length", "_slice"])

    @F.pandas_udf("struct<sequence_id: long, offset: long>")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        table = places.value
        big = np.int64(1) << 50
        at = np.searchsorted(table[:, 0] * big + table[:, 1], length.to_numpy() * big + rank.to_numpy(), side="right") - 1
        return pd.DataFrame({"sequence_id": table[at, 2] + rank.to_numpy() - table[at, 1], "offset": table[at, 3]})

    placed = ranked.withColumn("_place", place("length", F.col("_rank") + F.col("_base")))
    return placed.select(*[f"`{c}`" for c in pieces.columns if c != "_row"], "_place.sequence_id", "_place.offset")
