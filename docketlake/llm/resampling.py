"""Importance resampling towards a target by hashed n-grams.

Texts become bytes in which every run of separators is one space.  One
overlapped regex scan then emits, from every word on, the spans of the word and
of the one or two words behind it; a span's CRC continues the one before it, so
no n-gram is ever built as a string.  A document's features are kept as its
sorted bucket numbers, packed: counts of the corpus and weights of the documents
both come from them, and texts are scanned once.

Draws are Gumbel top-k: every document's log weight gets a noise that depends on
its id alone, and the highest scores are drawn.  Ranks come from a range
partitioned sort with row counts per partition, not from a window over everything.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketlake.llm.common import bound_batches, materialise, once_a_worker

BUCKETS = 10_000
SEED = 42
LEAST_WORDS = 20
PERCENT = 5


def collapsed(text: bytes) -> bytes:
    """Words in lower case (A-Z only) between single spaces, one at either end.

    Word bytes are a-z, 0-9 and everything beyond ASCII.
    """
    table = once_a_worker("word bytes", lambda: bytes(
        c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
    ))
    return b" ".join([b"", *text.translate(table).split(), b""])


def scanner():
    """Matches, one from every word on, whose groups are the word and up to two more with the space before each."""
    import regex

    return once_a_worker("n-gram scan", lambda: regex.compile(rb" ([^ ]++)(?:( [^ ]++)( [^ ]++)?)?(?= )"))


def feature_hashes(text: bytes | None) -> np.ndarray:
    """CRC-32 of every run of one to three words of a text; null and empty texts have none."""

    def scan(data: bytes) -> Iterator[int]:
        crc = zlib.crc32
        for match in scanner().finditer(data, overlapped=True):
            one, two, three = match.groups()
            value = crc(one)
            yield value
            if two is not None:
                value = crc(two, value)
                yield value
                if three is not None:
                    yield crc(three, value)

    return np.fromiter(scan(collapsed(text)) if text else (), np.uint32)


def pack_buckets(buckets: np.ndarray) -> bytes:
    """Sorted bucket numbers as byte planes of their differences: planes that are nearly all zero compress away."""
    steps = np.diff(np.sort(buckets.astype(np.uint32)), prepend=np.uint32(0))
    return steps.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def unpack_buckets(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(packed, np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel(), dtype=np.int64)


def words_of(features: int) -> int:
    """Words of a text with so many runs of one to three words."""
    return features if features < 2 else (features + 3) // 3


def _hash(buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [feature_hashes(text) % buckets for text in batch.column(batch.num_columns - 1).to_pylist()]
            sizes = pa.array([len(x) for x in found], pa.int64())
            packed = pa.array(map(pack_buckets, found), pa.binary())
            names = [*batch.schema.names[:-1], "n_features", "_packed"]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], sizes, packed], names)

    return run


def _histogram(buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for packed in batch.column(0).to_pylist():
                total += np.bincount(unpack_buckets(packed), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["bucket", "n"])

    return run


def hashed_features(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """The columns of ``docs`` but ``text``, and ``n_features`` and ``_packed``, the buckets of its features."""
    bound_batches(docs.sparkSession)
    rest = docs.drop("n_features", "_packed")
    others = [F.col(f"`{c}`") for c in rest.columns if c != "text"]
    rest = rest.select(*others, F.col("text").cast("binary"))
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema.fields[:-1]]
    return rest.mapInArrow(_hash(buckets), ", ".join([*kinds, "n_features long", "_packed binary"]))


def bucket_counts(features: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features in every bucket; ``buckets`` numbers reach the driver, whatever the input."""
    parts = features.select("_packed").mapInArrow(_histogram(buckets), "bucket int, n long")
    total = np.zeros(buckets, np.int64)
    for row in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        total[row.bucket] = row.n
    return total


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of target to corpus, by bucket, with one added to every count."""
    high, low = float(corpus.sum() + len(corpus)), float(target.sum() + len(corpus))
    ratios = [(t + 1.0) * high / ((s + 1.0) * low) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)]
    return np.array([math.floor(1000 * math.log(r)) for r in ratios], np.int64)


def noise(seed: int, name: object) -> int:
    """Gumbel noise in thousandths, from the hash of ``seed:name``; no name is an empty one."""
    h = int(sha256(f"{seed}:{'' if name is None else name}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def _weigh(gains: np.ndarray, seed: int, name: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weights = [int(gains[unpack_buckets(p)].sum()) for p in batch.column("_packed").to_pylist()]
            scores = [w + noise(seed, v) for w, v in zip(weights, batch.column(name).to_pylist(), strict=True)]
            words = [words_of(n) for n in batch.column("n_features").to_pylist()]
            at = batch.schema.get_field_index("_packed")
            kept = [c for i, c in enumerate(batch.columns) if i != at]
            names = [c for c in batch.schema.names if c != "_packed"]
            made = [pa.array(x, pa.int64()) for x in (words, weights, scores)]
            yield pa.RecordBatch.from_arrays([*kept, *made], [*names, "n_words", "weight", "score"])

    return run


def ranked(df: DataFrame, order: list, name: str, upto: int) -> DataFrame:
    """``df`` with the place of its first ``upto`` rows in ``order`` as ``name``; null for the others.

    Rows are dealt out by range and sorted inside each part; a part's first place
    is the number of rows in the parts before it.  Only those counts, one a part,
    reach the driver.
    """
    spark = df.sparkSession
    at = F.monotonically_increasing_id()
    parts = materialise(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", at))
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    sizes = {r.part: r.n for r in parts.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}
    first, before = [], 0
    for number in sorted(sizes):
        first.append((number, before))
        before += sizes[number]
    starts = spark.createDataFrame(first or [(-1, 0)], "_part long, _first long")
    placed = parts.withColumn("_part", part).join(F.broadcast(starts), "_part")
    rank = F.col("_first") + place + 1
    return placed.withColumn(name, F.when(rank <= upto, rank)).drop("_at", "_part", "_first")


def resample(
    docs: DataFrame,
    target: DataFrame,
    percent: int = PERCENT,
    least_words: int = LEAST_WORDS,
    seed: int = SEED,
    buckets: int = BUCKETS,
    key: str = "doc_id",
) -> DataFrame:
    """``docs`` without ``text``, with ``n_features, n_words, weight, score, rank``.

    ``target`` has a column ``text``.  Features are runs of one to three words,
    hashed into buckets; ``weight`` adds up the gains of a document's features,
    ``score`` adds noise that depends on the seed and ``key``.  ``percent`` of the
    documents with at least ``least_words`` words are drawn and ranked by score,
    ties by ``key``; the others have no rank.

    Null and empty texts have no features, weight 0 and are never drawn for
    ``least_words`` above 0.  Null keys share the noise of an empty name and come
    first among equal scores.  Repeated rows are ranked one by one.  An empty table
    gives no rows, an empty target equal counts of 0.  Columns named like the new
    ones are replaced.
    """
    made = ("n_words", "weight", "score", "rank", "_packed", "_row", "_at", "_part", "_first")
    features = materialise(hashed_features(docs.drop(*made), buckets), "zstd")
    corpus = bucket_counts(features, buckets)
    wanted = bucket_counts(hashed_features(target.select("text"), buckets), buckets)
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in features.schema if f.name != "_packed"]
    kinds += ["n_words long", "weight long", "score long"]
    weighed = features.mapInArrow(_weigh(bucket_gains(corpus, wanted), seed, key), ", ".join(kinds))
    weighed = materialise(weighed.withColumn("_row", F.monotonically_increasing_id()))

    enough = F.col("n_words") >= least_words
    eligible = weighed.where(enough)
    order = [F.desc("score"), F.asc(f"`{key}`"), F.asc("_row")]
    drawn = ranked(eligible, order, "rank", percent * eligible.count() // 100)
    rest = weighed.where(~enough).withColumn("rank", F.lit(None).cast("long"))
    return drawn.unionByName(rest).drop("_row")
