"""Splittable reading of quoted records whose values contain newlines.

Files are read line by line in splits.  A line starts a record when the number of
unescaped quotes before it is even; what a split cannot know is the number before
its first line.  It does not have to: a quote that stands where a value may begin
and is followed by an ordinary character can only open a value, never close one, so
a line whose first quote is of that kind certainly starts a record.  From the first
such line on, a split is cut into records where it is read, and each further one sets
the count to even again: behind a stray quote only the record that holds it is lost.

Lines before it are kept with what they mean under both parities, and the last record
of a split is kept open.  Only these fragments are shuffled: one row per split tells
which parity holds at its end, which settles where the fragments belong.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docketlake.session import stored

# Workers need not be able to import this package: what they run is sent by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

RECORD, TAIL, HEAD, SPLIT = range(4)
_PIECES = pa.schema(
    [("kind", pa.int8()), ("file", pa.string()), ("block", pa.int64()), ("line", pa.int64()), ("value", pa.binary())]
    + [("known", pa.bool_()), ("parity", pa.int8()), ("even", pa.int64()), ("odd", pa.int64())]
)


def unescaped_quotes(value: Column, quote: str) -> Column:
    """Number of quote characters in a line that no backslash escapes."""
    plain = F.when(value.contains("\\"), F.regexp_replace(value, r"\\.", "")).otherwise(value)
    return F.length(plain) - F.length(F.replace(plain, F.lit(quote), F.lit("")))


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines with the file and the split they come from, in their order inside each split."""
    return lines_of(spark.read.option("lineSep", "\n").text(path))


def lines_of(text: DataFrame) -> DataFrame:
    """The same from what a batch or stream reader of text files returns."""
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")]
    return text.select("value", *place)


class _Split:
    """One split while its lines are read in order.

    ``base`` is the number of quotes before the last line that certainly starts a
    record, -1 as long as there is none.  ``even`` and ``odd`` are the last lines
    before it with an even or odd number of quotes before them in the split.
    """

    def __init__(self, file: str, block: int) -> None:
        self.file, self.block, self.lines, self.quotes = file, block, 0, 0
        self.base = 0 if block == 0 else -1
        self.even = self.odd = -1
        self.open: list[pa.Array] = []
        self.first = 0

    def rows(self, kind: int, lines: np.ndarray, values: pa.Array, **others: np.ndarray | int) -> pa.RecordBatch:
        n = len(lines)
        columns = {"kind": kind, "block": self.block, "known": self.base >= 0, "parity": 0, "even": -1, "odd": -1} | others
        made = {k: pa.array(np.broadcast_to(v, n), _PIECES.field(k).type) for k, v in columns.items()}
        made |= {"file": pa.array([self.file] * n, pa.string()), "line": pa.array(lines, pa.int64()), "value": values}
        return pa.RecordBatch.from_arrays([made[f.name] for f in _PIECES], schema=_PIECES)

    def take(self, values: pa.Array, quotes: np.ndarray, opens: np.ndarray, joiner: bytes) -> Iterator[pa.RecordBatch]:
        """Rows for the next lines: complete records, or fragments while the parity is not known."""
        number = self.lines + np.arange(len(values))
        before = self.quotes + np.cumsum(quotes) - quotes
        base = np.maximum(self.base, np.maximum.accumulate(np.where(opens, before, -1)))
        self.lines += len(values)
        self.quotes += int(quotes.sum())
        unknown = int(np.searchsorted(base, 0))
        if unknown:
            odd = before[:unknown] % 2 == 1
            last = [np.maximum.accumulate(np.where(at, number[:unknown], -1)) for at in (~odd, odd)]
            even, odd = np.maximum(self.even, last[0]), np.maximum(self.odd, last[1])
            yield self.rows(HEAD, number[:unknown], values[:unknown], even=even, odd=odd)
            self.even, self.odd = int(even[-1]), int(odd[-1])
        self.base = int(base[-1])
        values, number = values[unknown:], number[unknown:]
        starts = np.flatnonzero((before[unknown:] - base[unknown:]) % 2 == 0)
        if len(starts) == 0:
            self.open += [values] if len(values) else []
            return
        if starts[0] or self.open:
            whole = pa.concat_arrays([*self.open, values[: starts[0]]])
            yield self.rows(RECORD, np.array([self.first]), _joined(whole, np.array([0, len(whole)]), joiner))
        if len(starts) > 1:
            inner = values[starts[0] : starts[-1]]
            yield self.rows(RECORD, number[starts[:-1]], _joined(inner, starts - starts[0], joiner))
        self.open, self.first = [values[starts[-1] :]], int(number[starts[-1]])

    def end(self, joiner: bytes) -> Iterator[pa.RecordBatch]:
        """The open record, and one row that says what holds at the end of the split."""
        if self.open:
            whole = pa.concat_arrays(self.open)
            yield self.rows(TAIL, np.array([self.first]), _joined(whole, np.array([0, len(whole)]), joiner))
        known = self.base >= 0
        places = {"even": self.first, "odd": self.first} if known else {"even": self.even, "odd": self.odd}
        parity = (self.quotes - max(self.base, 0)) % 2
        yield self.rows(SPLIT, np.array([self.lines]), pa.nulls(1, pa.binary()), parity=parity, **places)


def _joined(values: pa.Array, offsets: np.ndarray, joiner: bytes) -> pa.Array:
    lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)
    return pc.binary_join(lists, pa.scalar(joiner, pa.binary()))


def opening(quote: str) -> str:
    """Pattern of a line whose first quote opens a value that ends in the line."""
    q = re.escape(quote)
    return rf"^(?:[^{q}\\]*,)?{q}[^{q},\\\s][^{q}\\]*{q}(?:,|\s*$)"


def _cut(quote: str, joiner: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    pattern, join = opening(quote), joiner.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split: _Split | None = None
        for batch in batches:
            values, files, blocks = batch.column(0), batch.column(1), batch.column(2).to_numpy()
            plain = values
            escaped = pc.match_substring(values, "\\")
            if pc.any(escaped).as_py():
                plain = pc.if_else(escaped, pc.replace_substring_regex(values, r"\\.", ""), values)
            quotes = pc.count_substring(plain, quote).to_numpy(zero_copy_only=False).astype(np.int64)
            opens = pc.match_substring_regex(values, pattern).to_numpy(zero_copy_only=False)
            # Lines of a split follow each other, so a new split shows as a new place or another file.
            edges = [0, *(1 + np.flatnonzero(blocks[1:] != blocks[:-1])).tolist(), len(values)]
            if pc.any(pc.not_equal(files[1:], files[:-1])).as_py():
                changes = 1 + np.flatnonzero(pc.not_equal(files[1:], files[:-1]).to_numpy(zero_copy_only=False))
                edges = sorted({*edges, *changes.tolist()})
            for low, high in zip(edges, edges[1:], strict=False):
                if low == high:
                    continue
                file, block = files[low].as_py(), int(blocks[low])
                if split is None or (split.file, split.block) != (file, block):
                    if split is not None:
                        yield from split.end(join)
                    split = _Split(file, block)
                yield from split.take(values[low:high], quotes[low:high], opens[low:high], join)
        if split is not None:
            yield from split.end(join)

    return run


def cut_records(lines: DataFrame, quote: str = "`", joiner: str = "\n") -> DataFrame:
    """Rows ``(file, record, value)`` of the lines of whole files, as ``read_lines`` returns them.

    ``record`` is the place of the record's first line, a split and a number in it; the
    first record of a file is at ``(0, 0)``.  Records are never cut, however many splits
    they reach over.  The text is read once and written to the scratch folder in pieces.
    """
    kinds = "kind tinyint, file string, block bigint, line bigint, value binary, known boolean, parity tinyint, even bigint, odd bigint"
    raw = lines.select(F.col("value").cast("binary"), "file", "block")
    pieces = stored(raw.mapInArrow(_cut(quote, joiner), kinds), "pieces")

    by_file = Window.partitionBy("file").orderBy("block")
    earlier = by_file.rowsBetween(Window.unboundedPreceding, -1)
    splits = pieces.where(F.col("kind") == SPLIT).select("file", "block", "known", "parity", "even", "odd")
    # Parity at the end of the last split that knows it, plus the quotes of the splits since.
    since = F.coalesce(F.sum(F.when(~F.col("known"), F.col("parity")).otherwise(0)).over(earlier), F.lit(0))
    settled = F.last(F.when(F.col("known"), F.col("parity") - F.col("since")), ignorenulls=True).over(earlier)
    splits = splits.withColumn("since", since).withColumn("state", F.pmod(settled + F.col("since"), F.lit(2)))
    last = F.when(F.col("known") | (F.col("state") == 0), F.col("even")).otherwise(F.col("odd"))
    place = lambda line: F.struct(F.col("block"), line.alias("line"))
    splits = splits.withColumn("last", F.when(last >= 0, place(last)))
    splits = splits.withColumn("carried", F.last("last", ignorenulls=True).over(earlier))

    heads = pieces.where(F.col("kind") == HEAD).join(splits.select("file", "block", "state", "carried"), ["file", "block"])
    start = F.when(F.col("state") == 0, F.col("even")).otherwise(F.col("odd"))
    heads = heads.withColumn("record", F.when(start >= 0, place(start)).otherwise(F.col("carried")))
    tails = pieces.where(F.col("kind") == TAIL).withColumn("record", place(F.col("line")))
    parts = [f.select("file", "record", "block", "line", F.col("value").cast("string")) for f in (heads, tails)]
    in_order = F.sort_array(F.collect_list(F.struct("block", "line", "value")))
    stitched = parts[0].unionByName(parts[1]).groupBy("file", "record").agg(
        F.array_join(F.transform(in_order, lambda x: x["value"]), joiner).alias("value")
    )
    whole = pieces.where(F.col("kind") == RECORD).select(
        "file", place(F.col("line")).alias("record"), F.col("value").cast("string").alias("value")
    )
    bare = F.regexp_replace("value", r"\r\z", "")
    return whole.unionByName(stitched).withColumn("value", F.when(F.endswith("value", F.lit("\r")), bare).otherwise(F.col("value")))


def stitch_records(
    spark: SparkSession,
    path: str | list[str],
    quote: str = "`",
    joiner: str = "\n",
) -> DataFrame:
    """``cut_records`` of files."""
    return cut_records(read_lines(spark, path), quote, joiner)


def separated_records(spark: SparkSession, path: str | list[str], quote: str, headers: dict[str, str]) -> DataFrame:
    """Records cut at quote-newline-quote, by Spark's own reader; ``headers`` has the first line of each file.

    Cutting removes the closing and the opening quote, which are put back: the
    opening one everywhere but behind the header, the closing one where the record's
    quote count is odd without it.
    """
    text = lines_of(spark.read.option("lineSep", f"{quote}\n{quote}").text(path))
    value = F.col("value")
    rest = F.concat(F.lit(quote), value)
    for line in sorted(set(headers.values()), key=len):
        # A header that ends with a quote is cut there, like a record.
        begins = (F.col("block") == 0) & (value.startswith(line) | ((value == line[:-1]) & F.lit(line.endswith(quote))))
        rest = F.when(begins, F.substr("value", F.lit(len(line) + 1))).otherwise(rest)
    rest = F.regexp_replace(rest, r"\A[\r\n]+|[\r\n]+\z", "")
    place = F.struct(F.col("block"), (F.monotonically_increasing_id() + 1).alias("line"))
    chunks = text.select("file", place.alias("record"), rest.alias("value")).where("value <> ''")
    odd = unescaped_quotes(F.col("value"), quote) % 2 == 1
    closed = F.when(odd, F.concat("value", F.lit(quote))).otherwise(F.col("value"))
    rows = [(file, (0, 0), line) for file, line in headers.items()]
    named = spark.createDataFrame(rows, "file string, record struct<block: bigint, line: bigint>, value string")
    return named.unionByName(chunks.select("file", "record", closed.alias("value")))
