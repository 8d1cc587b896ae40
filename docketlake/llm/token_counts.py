"""Token counts from the pieces of distinct pre-tokens.

A text's token count is the sum, over its pre-tokens, of how many pieces the
vocabulary's merges leave of each.  Pre-tokens repeat a lot, so every distinct
one is segmented once for the whole corpus; documents keep only how often they
use which pre-token, and no id sequence is ever built.

Documents meet the counts in two ways that give the same sums: the ``head``
most frequent pre-tokens (a bounded table) are added up where the text is read,
the others are joined by a shuffle.  Frequent pre-tokens are exactly those that
would make that join skewed.
"""

from __future__ import annotations

import os
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketlake.llm.common import bound_batches, materialise, once_a_worker

VOCABULARY = "word_bpe_49k.json"
#: Pre-tokens whose counts are broadcast; a bound of some megabytes, independent of the corpus.
HEAD = 1 << 18
#: Distinct pre-tokens a task counts before it hands them on; Spark combines them before the shuffle.
COUNTED = 60_000

# The splitting rule of the vocabulary file for characters below U+0180,
# all of which are their own normal form: letters, numbers, white space.
_LETTERS = "a-zA-ZªµºÀ-ÖØ-öø-ſ"
_NUMBERS = "0-9²³¹¼-¾"
_SPACES = r"\t-\r \x85\xa0"


class PreTokens:
    """Splits texts as the tokenizer file does, without segmenting the parts."""

    def __init__(self, path: str | None = None) -> None:
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path or public_tokenizers.path(VOCABULARY))
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.simple = re.compile(
            rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^{_SPACES}{_LETTERS}{_NUMBERS}]+"
        )
        self.beyond = re.compile("[^\u0000-ſ]")
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in set(plain)]
        self.byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}

    def _parts(self, text: str) -> list[str]:
        if not self.beyond.search(text):
            return self.simple.findall(text.lower())
        normal = self.tokenizer.normalizer.normalize_str(text)
        split = self.tokenizer.pre_tokenizer.pre_tokenize_str(normal)
        return [bytes(self.byte_of[c] for c in part).decode("utf-8", "replace") for part, _ in split]

    def split(self, text: str) -> tuple[list[str], int]:
        """The pre-tokens, and how many special strings stand between them (one token each)."""
        if self.special is None or "<|" not in text:
            return self._parts(text), 0
        pieces = self.special.split(text)
        return [part for piece in pieces for part in self._parts(piece)], len(pieces) - 1

    def count_pieces(self, parts: Iterable[str]) -> list[int]:
        self.tokenizer.encode_special_tokens = True
        return [len(e) for e in self.tokenizer.encode_batch(list(parts), add_special_tokens=False)]


def splitter_of(path: str | None) -> PreTokens:
    """One splitter for all tasks of a worker; a task has one core, so the library starts no threads."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return once_a_worker(f"pre-tokens of {path}", lambda: PreTokens(path))


def _frequencies(path: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter, counts = splitter_of(path), Counter()

        def flush() -> pa.RecordBatch:
            out = [pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())]
            counts.clear()
            return pa.RecordBatch.from_arrays(out, ["part", "uses"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    counts.update(splitter.split(text)[0])
                if len(counts) > COUNTED:
                    yield flush()
        yield flush()

    return run


def _pieces(path: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = splitter_of(path)
        for batch in batches:
            pieces = pa.array(splitter.count_pieces(batch.column(0).to_pylist()), pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, pieces], ["part", "uses", "pieces"])

    return run


def piece_table(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Every distinct pre-token of ``docs.text`` with its number of uses and of pieces."""
    uses = docs.select("text").mapInArrow(_frequencies(path), "part string, uses long")
    distinct = uses.groupBy("part").agg(F.sum("uses").alias("uses"))
    return distinct.mapInArrow(_pieces(path), "part string, uses long, pieces int")


def _count_documents(path: str | None, head):
    @F.pandas_udf("struct<n_head: long, parts: array<string>, uses: array<int>>")
    def count(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        splitter, known = splitter_of(path), head.value
        for series in texts:
            sums, parts, uses = [], [], []
            for text in series:
                found, total = splitter.split(text) if text else ([], 0)
                rest: dict[str, int] = {}
                for part, n in Counter(found).items():
                    pieces = known.get(part)
                    if pieces is None:
                        rest[part] = n
                    else:
                        total += n * pieces
                sums.append(total)
                parts.append(list(rest))
                uses.append(list(rest.values()))
            yield pd.DataFrame({"n_head": sums, "parts": parts, "uses": uses})

    return count


def token_counts(docs: DataFrame, path: str | None = None, head: int = HEAD) -> DataFrame:
    """The columns of ``docs`` but ``text``, and ``n_bytes`` and ``n_tokens`` of that text.

    Counts are those of the tokenizer file's library without added begin or end
    tokens; special strings in a text count as one token each.  Null and empty
    texts have 0 bytes and 0 tokens, repeated rows stay, an empty table gives an
    empty table.  Columns named ``n_bytes`` or ``n_tokens`` are replaced.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    texts = docs.drop("n_bytes", "n_tokens")
    table = materialise(piece_table(texts, path))
    top = table.orderBy(F.desc("uses"), "part").limit(head).select("part", "pieces")
    known = spark.sparkContext.broadcast({r.part: r.pieces for r in top.toLocalIterator()})

    others = [F.col(f"`{c}`") for c in texts.columns if c != "text"]
    sizes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")
    counted = texts.select(*others, sizes, _count_documents(path, known)("text").alias("_counts"))
    counted = materialise(counted.withColumn("_row", F.monotonically_increasing_id()))
    rest = counted.select("_row", F.explode(F.arrays_zip("_counts.parts", "_counts.uses")).alias("_part"))
    rest = rest.select("_row", F.col("_part.parts").alias("part"), "_part.uses").join(table.drop("uses"), "part")
    added = rest.groupBy("_row").agg(F.sum(F.col("uses") * F.col("pieces").cast("long")).alias("_added"))
    total = F.col("_counts.n_head") + F.coalesce("_added", F.lit(0).cast("long"))
    return counted.join(added, "_row", "left").withColumn("n_tokens", total).drop("_row", "_counts", "_added")
