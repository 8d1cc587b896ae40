"""Which tokens of one tokenizer stand for which of another, counted over a corpus by inverted pair bitmaps.

Byte offsets where tokens of both tokenizers end cut a text into groups; every
token of one side is linked with every token of the other in its group.  An
inverted index keeps, per pair of ids and chunk of documents, which documents hold
the pair linked and how often, as planes of bitmaps: a document is in plane k if bit
k of its number of links is set.  The union of the planes is the pair's document
bitmap; its population gives the document count, the planes' populations the link
count.  Counts are summed per pair over all chunks, and the postings take them back
to the documents of their chunk.

Neither tokenizer has a token with a space, a line feed or most other white space
behind another character.  Such white space therefore always starts a new token and a
new group on both sides, and a text is aligned by its stretches of white space and
word, each distinct one once a worker.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Callable, Iterator
from hashlib import sha256
from itertools import count
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketlake.llm.common import bound_batches, materialise, once_a_worker
from docketlake.llm.packing import TokenIds

LEFT = "byte_bpe_50k"
RIGHT = "piece_bpe_32k.model"
#: Stretches whose alignment a worker remembers, and the longest of them.
REMEMBERED = 400_000
LONGEST = 64
#: A chunk ends with so many documents (places have 16 bits) or postings, which bounds what a task holds.
CHUNK_DOCUMENTS = 1 << 15
CHUNK_POSTINGS = 1 << 20

# Characters with the Unicode property White_Space.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


class Aligned(NamedTuple):
    """A stretch of text in both tokenizers: counts, groups as text, and each linked pair with its number of links."""

    n_left: int
    n_right: int
    n_groups: int
    n_links: int
    groups: str
    pairs: array
    times: array


class Aligner:
    """Aligns texts of a byte-level BPE (``.json`` and ``.tiktoken`` of one name) and a sentencepiece model."""

    def __init__(self, left: str | None = None, right: str | None = None) -> None:
        import public_tokenizers
        import sentencepiece
        from tokenizers import Tokenizer

        left = left or public_tokenizers.path(f"{LEFT}.json").removesuffix(".json")
        tokenizer = Tokenizer.from_file(f"{left}.json")
        self.left = TokenIds(f"{left}.tiktoken")
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in set(plain)]
        byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}
        names = [tokenizer.id_to_token(i) or "" for i in range(tokenizer.get_vocab_size())]
        self.left_bytes = [bytes(byte_of.get(c, 63) for c in name) for name in names]

        self.right = sentencepiece.SentencePieceProcessor(model_file=right or public_tokenizers.path(RIGHT))
        ids = range(self.right.get_piece_size())
        pieces = [self.right.id_to_piece(i) for i in ids]
        self.right_bytes = [
            bytes([int(p[3:5], 16)]) if self.right.is_byte(i) else p.replace("▁", " ").encode()
            for i, p in zip(ids, pieces, strict=True)
        ]
        names = [p.replace("▁", " ") for p in pieces] + [b.decode("utf-8", "ignore") for b in self.left_bytes]
        joined = "".join(sorted({c for name in names for c in re.findall(f"[^{_SPACE}]([{_SPACE}])", name)}))
        if " " in joined:
            raise ValueError("A tokenizer has tokens with a space behind other characters")
        # A stretch goes on behind white space that some token holds behind another character.
        further = f"(?:[{re.escape(joined)}][{_SPACE}]*+)?+" if joined else ""
        self.stretches = re.compile(f"[{_SPACE}]*+(?:[^{_SPACE}]++{further}){'*+' if joined else '?+'}").findall
        self.size = len(pieces)
        self.left_sizes, self.right_sizes = [len(x) for x in self.left_bytes], [len(x) for x in self.right_bytes]
        # A line feed is a token of its own; behind it, a stretch is encoded without a space put before it.
        self.lead = len(self.right.encode("\n"))
        self.known: dict[str, Aligned] = {}

    def _align(self, text: str, right: list[int]) -> Aligned | None:
        left = array("I", self.left.plain(text)).tolist()
        data, spelt = text.encode(), self.right_bytes
        if b"".join([spelt[i] for i in right]) != data or sum([self.left_sizes[i] for i in left]) != len(data):
            return None
        size = self.size
        if len(left) == 1 or len(right) == 1:
            groups = f"{','.join(map(str, left))}|{','.join(map(str, right))}"
            pairs = [a * size + b for a in left for b in right]
            links = dict.fromkeys(pairs, 1) if len(set(pairs)) == len(pairs) else Counter(pairs)
            return Aligned(len(left), len(right), 1, len(pairs), groups, array("q", links), array("q", links.values()))
        sizes, others = self.left_sizes, self.right_sizes
        names, links, n_links, low, first, j, left_end, right_end = [], {}, 0, 0, 0, 0, 0, 0
        for i, token in enumerate(left):
            left_end += sizes[token]
            while right_end < left_end:
                right_end += others[right[j]]
                j += 1
            if left_end != right_end:
                continue
            if i == low and j == first + 1:
                pair = token * size + right[first]
                names.append(f"{token}|{right[first]}")
                links[pair] = links.get(pair, 0) + 1
                n_links += 1
            else:
                ours, theirs = left[low : i + 1], right[first:j]
                names.append(f"{','.join(map(str, ours))}|{','.join(map(str, theirs))}")
                counted = Counter(theirs).items()
                for a, m in Counter(ours).items():
                    for b, n in counted:
                        links[a * size + b] = links.get(a * size + b, 0) + m * n
                n_links += len(ours) * len(theirs)
            low, first = i + 1, j
        groups = ";".join(names)
        return Aligned(len(left), len(right), len(names), n_links, groups, array("q", links), array("q", links.values()))

    def text(self, text: str | None) -> tuple[list[str], dict[str, int], dict[str, Aligned]]:
        """The stretches of a text, how often each occurs, and their alignments; nothing for a text without tokens."""
        if not text:
            return [], {}, {}
        parts = self.stretches(" " + text)
        parts.pop()  # the empty match at the end
        uses, known = Counter(parts), self.known
        found = {part: known.get(part) for part in uses}
        new = [part for part, one in found.items() if one is None]
        for part, ids in zip(new, self.right.encode(["\n" + part for part in new], num_threads=1), strict=True):
            found[part] = one = self._align(part, ids[self.lead :])
            if one is None:
                return [], {}, {}
            if len(known) < REMEMBERED and len(part) <= LONGEST:
                known[part] = one
        return parts, uses, found


def aligner_of(left: str | None, right: str | None) -> Aligner:
    return once_a_worker(f"alignment of {left} and {right}", lambda: Aligner(left, right))


def containers(places: np.ndarray, sizes: np.ndarray, documents: int) -> pa.Array:
    """Sets of 16-bit places, ``sizes`` of them in a row, as bytes.

    A set is its sorted places, an even number of bytes, or where that is longer a
    bitmap of all ``documents`` with an odd number of bytes.
    """
    width = -(-documents // 8) | 1
    ends = np.cumsum(sizes)
    dense = 2 * sizes > width
    if len(sizes) == 0 or not dense.any():
        offsets = np.concatenate([[0], 2 * ends]).astype(np.int32)
        buffers = [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(places.astype("<u2").tobytes())]
        return pa.Array.from_buffers(pa.binary(), len(sizes), buffers)
    lists = containers(places[np.repeat(~dense, sizes)], sizes[~dense], 1 << 20)
    maps = []
    for low, high in zip((ends - sizes)[dense], ends[dense], strict=True):
        bits = np.zeros(8 * width, np.uint8)
        bits[places[low:high]] = 1
        maps.append(np.packbits(bits).tobytes())
    order = np.empty(len(sizes), np.int64)
    order[~dense], order[dense] = np.arange((~dense).sum()), (~dense).sum() + np.arange(dense.sum())
    return pa.concat_arrays([lists, pa.array(maps, pa.binary())]).take(pa.array(order))


_INDEX = pa.schema(
    [("pair", pa.int64()), ("docs", pa.int64()), ("links", pa.int64()), ("planes", pa.list_(pa.binary()))]
)


def inverted(pairs: np.ndarray, places: np.ndarray, links: np.ndarray, documents: int) -> pa.RecordBatch:
    """Planes of bitmaps per pair from links of a pair and place, in the order of places; equal entries add up."""
    order = np.argsort(pairs, kind="stable")
    pairs, places, links = pairs[order], places[order], links[order]
    new = np.ones(len(pairs), bool)
    new[1:] = (pairs[1:] != pairs[:-1]) | (places[1:] != places[:-1])
    at = np.flatnonzero(new)
    links = np.add.reduceat(links, at) if len(at) else links
    pairs, places = pairs[at], places[at]
    names, first, docs = np.unique(pairs, return_index=True, return_counts=True)
    most = np.maximum.reduceat(links, first) if len(first) else links
    depth = np.zeros(len(names), np.int64)
    while (most >> depth).any():
        depth += (most >> depth) > 0
    starts = np.cumsum(depth) - depth
    row = np.repeat(np.arange(len(names)), docs)
    entries, members = [np.zeros(0, np.int64)], [np.zeros(0, places.dtype)]
    for k in range(int(depth.max(initial=0))):
        held = np.flatnonzero(links >> k & 1)
        entries.append(starts[row[held]] + k)
        members.append(places[held])
    entry, member = np.concatenate(entries), np.concatenate(members)
    order = np.argsort(entry, kind="stable")
    sizes = np.bincount(entry, minlength=int(depth.sum()))
    sets = containers(member[order], sizes, documents)
    offsets = pa.array(np.concatenate([starts, [len(sizes)]]), pa.int32())
    total = np.add.reduceat(links, first) if len(first) else links
    columns = [pa.array(names), pa.array(docs), pa.array(total), pa.ListArray.from_arrays(offsets, sets)]
    return pa.RecordBatch.from_arrays(columns, schema=_INDEX)


def _tokens(left: str | None, right: str | None, most_documents: int, most_postings: int):
    """Rows of documents (``pair`` null) and rows of their chunk's index (other columns null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, part = aligner_of(left, right), TaskContext.get().partitionId() << 32
        pairs, links, sizes = array("q"), array("q"), array("q")
        chunks = count(part)
        chunk = next(chunks)

        def index(kinds: pa.Schema) -> pa.RecordBatch:
            places = np.repeat(np.arange(len(sizes)), np.array(sizes))
            made = inverted(np.array(pairs), places, np.array(links), len(sizes))
            columns = [pa.nulls(made.num_rows, f.type) for f in kinds]
            columns[kinds.get_field_index("_chunk")] = pa.array(np.full(made.num_rows, chunk), pa.int64())
            for held in (pairs, links, sizes):
                del held[:]
            return pa.RecordBatch.from_arrays([*columns, *made.columns], schema=pa.schema([*kinds, *_INDEX]))

        kinds = None
        for batch in batches:
            rows, low = [], 0
            kinds = pa.schema([*list(batch.schema)[:-1], *_DOCUMENT])
            texts = batch.column(batch.num_columns - 1).to_pylist()
            for at, text in enumerate(texts):
                parts, uses, found = aligner.text(text)
                digest = sha256(";".join([found[p].groups for p in parts]).encode()).hexdigest() if parts else ""
                n_left = n_right = n_groups = n_links = 0
                before = len(pairs)
                for p, n in uses.items():
                    ours, theirs, groups, linked, _, held, times = found[p]
                    n_left += n * ours
                    n_right += n * theirs
                    n_groups += n * groups
                    n_links += n * linked
                    pairs.extend(held)
                    links.extend(times if n == 1 else array("q", [n * m for m in times]))
                rows.append((chunk, len(sizes), n_left, n_right, n_groups, n_links, digest))
                sizes.append(len(pairs) - before)
                if len(sizes) >= most_documents or len(pairs) >= most_postings or at == len(texts) - 1:
                    made = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _DOCUMENT, strict=True)]
                    others = [c.slice(low, len(rows)) for c in batch.columns[:-1]]
                    empty = [pa.nulls(len(rows), f.type) for f in _INDEX]
                    yield pa.RecordBatch.from_arrays([*others, *made, *empty], schema=pa.schema([*kinds, *_INDEX]))
                    rows, low = [], at + 1
                if len(sizes) >= most_documents or len(pairs) >= most_postings:
                    yield index(kinds)
                    chunk = next(chunks)
        if pairs:
            yield index(kinds)

    return run


_DOCUMENT = pa.schema(
    [("_chunk", pa.int64()), ("_place", pa.int32()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64())]
    + [("n_links", pa.int64()), ("groups_sha256", pa.string())]
)
_MADE = (
    "_chunk long, _place int, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
    "pair long, docs long, links long, planes array<binary>"
)


def aligned_documents(
    docs: DataFrame,
    left: str | None = None,
    right: str | None = None,
    most_documents: int = CHUNK_DOCUMENTS,
    most_postings: int = CHUNK_POSTINGS,
) -> tuple[DataFrame, DataFrame]:
    """The documents without ``text`` with their own numbers, and the inverted index; both written once."""
    bound_batches(docs.sparkSession)
    made = [part.split()[0] for part in _MADE.split(", ")]
    rest = docs.drop(*made)
    others = [F.col(f"`{c}`") for c in rest.columns if c != "text"]
    rest = rest.select(*others, F.col("text").cast("string"))
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema.fields[:-1]]
    run = _tokens(left, right, most_documents, most_postings)
    table = materialise(rest.mapInArrow(run, ", ".join([*kinds, _MADE])))
    index = table.where("pair is not null").select("_chunk", "pair", "docs", "links", "planes")
    return table.where("pair is null").drop("pair", "docs", "links", "planes"), index


def pair_counts(index: DataFrame, size: int) -> DataFrame:
    """``pair, a, b, n_docs, n_links, best``: document and link counts per pair of ids, over all chunks.

    ``best`` says that no pair with the same ``a`` occurs in more documents.  ``size``
    is the number of ids of the second tokenizer.
    """
    counts = index.groupBy("pair").agg(F.sum("docs").alias("n_docs"), F.sum("links").alias("n_links"))
    ids: list[Column] = [F.expr(f"pair div {size}").alias("a"), F.expr(f"pair % {size}").alias("b")]
    counts = counts.select("pair", *ids, "n_docs", "n_links")
    return counts.withColumn("best", F.col("n_docs") == F.max("n_docs").over(Window.partitionBy("a")))


def _collect() -> Callable[[pa.Table], pa.Table]:
    def run(group: pa.Table) -> pa.Table:
        planes = group["planes"].combine_chunks()
        depth = planes.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        sets = planes.flatten()
        row = np.repeat(np.arange(len(depth)), depth)
        plane = np.arange(len(row)) - np.repeat(np.cumsum(depth) - depth, depth)
        times = np.left_shift(np.int64(1), plane)
        counts, best = group["n_docs"].to_numpy()[row] * times, group["best"].to_numpy(zero_copy_only=False)[row] * times
        bytes_of = pc.binary_length(sets).to_numpy(zero_copy_only=False)
        lists = bytes_of % 2 == 0
        data = b"".join(sets.filter(pa.array(lists)).to_pylist())
        places = np.frombuffer(data, "<u2").astype(np.int64)
        each = bytes_of[lists] // 2
        total, top = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        np.add.at(total, places, np.repeat(counts[lists], each))
        np.add.at(top, places, np.repeat(best[lists], each))
        for at in np.flatnonzero(~lists):
            held = np.flatnonzero(np.unpackbits(np.frombuffer(sets[int(at)].as_py(), np.uint8)))
            total[held] += counts[at]
            top[held] += best[at]
        held = np.flatnonzero(total)
        chunk = np.full(len(held), group["_chunk"][0].as_py())
        return pa.table(
            {"_chunk": chunk, "_place": held.astype(np.int32), "count_sum": total[held], "n_best": top[held]}
        )

    return run


def align_tokenizers(
    docs: DataFrame,
    left: str | None = None,
    right: str | None = None,
    most_documents: int = CHUNK_DOCUMENTS,
    most_postings: int = CHUNK_POSTINGS,
) -> tuple[DataFrame, DataFrame]:
    """Documents with their alignment, and the corpus-wide pair counts of ``pair_counts``.

    Documents get ``n_a, n_b`` (tokens of either side), ``n_groups, n_links``,
    ``n_best`` (links to the right id that the left id is linked with in most
    documents, ties included), ``count_sum`` (document counts over all links) and
    ``groups_sha256`` of ``a1,a2|b1;a3|b2,b3``; ``text`` goes, other columns stay.

    Texts are encoded without special tokens, a space before them on either side.
    A null or empty text, and one that the tokens of a side do not spell, has no
    tokens: zeros and an empty hash.  Repeated rows are documents of their own.  An
    empty table gives no rows.  Columns named like the new ones are replaced.
    """
    import public_tokenizers
    import sentencepiece

    size = sentencepiece.SentencePieceProcessor(model_file=right or public_tokenizers.path(RIGHT)).get_piece_size()
    docs = docs.drop("n_best", "count_sum")
    rows, index = aligned_documents(docs, left, right, most_documents, most_postings)
    counts = materialise(pair_counts(index, size))
    met = index.select("_chunk", "pair", "planes").join(counts.select("pair", "n_docs", "best"), "pair")
    schema = "_chunk long, _place int, count_sum long, n_best long"
    sums = met.groupBy("_chunk").applyInArrow(_collect(), schema)
    zero = F.lit(0).cast("long")
    out = rows.join(sums, ["_chunk", "_place"], "left")
    out = out.withColumns({"n_best": F.coalesce("n_best", zero), "count_sum": F.coalesce("count_sum", zero)})
    return out.drop("_chunk", "_place"), counts.drop("pair")
