"""Removal of long substrings that occur earlier in the corpus, through run-length indexes.

Every ``WINDOW``-byte string belongs to the group of its smallest 32-byte gram,
so all its copies meet in one group wherever they are.  Documents are parsed
into segments, runs of window starts of one group.  Segments are collapsed
first: of those with the same bytes, all but the earliest are repeats as a
whole.  What is left are groups whose gram occurs in different surroundings;
their contexts are indexed, in buckets of bounded size, by a run-compressed
Burrows-Wheeler transform with sampled run ends, and matching statistics
streamed from it mark the windows that occur earlier.

A document is an ``id``, its place in the order, and a ``doc``, which tells apart
the texts of one id and is 0 where an id has one text only.

A group with more than ``MOST_CONTEXTS`` surroundings, such as the edge of a
very common passage, is resolved by hashes of its windows, with combined minima.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketlake.llm.common import bound_batches, id_cell, materialise, shuffle_partitions, stored_cells, with_ids, without_ids
from docketlake.llm.repeat_index import GRAM, earlier_windows, gram_hashes, parse

WINDOW = 100
MOST_CONTEXTS = 5_000
#: Bytes of text parsed at once, segments collapsed at once, and text bytes behind a bucket of segments.
CHUNK = 1 << 19
FLUSH = 300_000
BUCKET_BYTES = 1 << 23
BUCKET_CONTEXTS = 4_000

_SEGMENT = np.dtype([("key", "<u8"), ("content", "<u8"), ("id", "<i8"), ("doc", "<i8"), ("start", "<i8"), ("count", "<i2"), ("again", "?")])
_MARK = "id long, doc long, start long, count int, key long, kind int"
#: Kinds of marks: windows to remove, contexts to index, contexts of groups that are resolved by hashes.
REMOVE, INDEX, HASH = 0, 1, 2


def _chunks(texts: list[str | None], window: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Document bytes in chunks of about ``CHUNK``; long documents are cut so that every window is in one piece.

    Each chunk names the rows of ``texts`` and the places its pieces are from.
    """
    parts: list[tuple[int, int, bytes]] = []
    size = 0
    for doc, text in enumerate(texts):
        data = text.encode("utf-8", "surrogatepass") if text else b""
        for low in range(0, max(0, len(data) - window + 1), CHUNK):
            part = data[low : low + CHUNK + window - 1]
            parts.append((doc, low, part))
            size += len(part)
            if size >= CHUNK:
                yield _joined(parts, window)
                parts, size = [], 0
    if parts:
        yield _joined(parts, window)


def _joined(parts: list[tuple[int, int, bytes]], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    data = np.frombuffer(b"".join(p for _, _, p in parts), np.uint8)
    ends = np.cumsum([len(p) for _, _, p in parts])
    valid = np.ones(len(data), bool)
    for end in ends:
        valid[end - window + 1 : end] = False
    return data, valid, ends, np.array([(d, low) for d, low, _ in parts], np.int64)


def _later(id_: np.ndarray, doc: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Rows with an equal one at a smaller id, or before them in their document.

    Equal rows start where ``first`` is set and are in the order of their ids, those of a document in the order of its text.
    """
    if not len(first):
        return first
    again = ~first
    again[1:] &= (id_[1:] == id_[:-1]) & (doc[1:] == doc[:-1])
    return again | (id_ > id_[first][np.cumsum(first) - 1])


def _segments(window: int, buckets: int):
    def collapse(found: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        rows = np.concatenate(found)
        # The sort is stable, and a document's segments are together in the order of its text.
        rows = rows[np.lexsort((rows["id"], rows["count"], rows["content"], rows["key"]))]
        first = np.ones(len(rows), bool)
        for field in ("key", "content", "count"):
            first[1:] &= rows[field][1:] == rows[field][:-1]
        first[1:] = ~first[1:]
        rows["again"] = _later(rows["id"], rows["doc"], first)
        # Repeats within the batch are known already; they only pass through, so any bucket will do.
        place = np.where(rows["again"], rows["id"].astype(np.uint64) + rows["start"].astype(np.uint64), rows["key"]) * np.uint64(0x9E3779B97F4A7C15)
        bucket = (place >> np.uint64(20)) % np.uint64(buckets)
        order = np.argsort(bucket, kind="stable")
        rows, bucket = rows[order], bucket[order]
        starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        packed = [rows[a:b].tobytes() for a, b in zip(starts, np.r_[starts[1:], len(rows)], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(bucket[starts].astype(np.int32)), pa.array(packed, pa.binary())], ["bucket", "rows"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, size = [], 0
        for batch in batches:
            ids, docs = (batch.column(c).to_numpy() for c in ("id", "doc"))
            for data, valid, ends, origin in _chunks(batch.column("text").to_pylist(), window):
                key, content, start, count = parse(data, valid, window)
                part = np.searchsorted(ends, start, side="right")
                rows = np.zeros(len(key), _SEGMENT)
                rows["key"], rows["content"], rows["count"] = key, content, count
                rows["id"], rows["doc"] = ids[origin[part, 0]], docs[origin[part, 0]]
                rows["start"] = start - np.r_[0, ends[:-1]][part] + origin[part, 1]
                found.append(rows)
                size += len(rows)
            if size >= FLUSH:
                yield from collapse(found)
                found, size = [], 0
        if size:
            yield from collapse(found)

    return run


def _resolve(most_contexts: int):
    def run(group: pa.Table) -> pa.Table:
        rows = np.frombuffer(b"".join(group["rows"].to_pylist()), _SEGMENT)
        known, rows = rows[rows["again"]], rows[~rows["again"]]
        # Stable again: all segments of a document come from one batch.
        rows = rows[np.lexsort((rows["id"], rows["count"], rows["content"], rows["key"]))]
        new_key = np.r_[True, rows["key"][1:] != rows["key"][:-1]] if len(rows) else np.zeros(0, bool)
        other = new_key.copy()
        other[1:] |= (rows["content"][1:] != rows["content"][:-1]) | (rows["count"][1:] != rows["count"][:-1])
        group_of = np.cumsum(new_key) - 1
        later = _later(rows["id"], rows["doc"], other)
        contents, contexts = (np.bincount(group_of, weights=w, minlength=1)[group_of] if len(rows) else np.zeros(0) for w in (other, ~later))
        kind = np.where(later, REMOVE, np.where(contents < 2, -1, np.where(contexts <= most_contexts, INDEX, HASH)))
        out = np.concatenate([known, rows[kind >= 0]])
        kinds = np.r_[np.full(len(known), REMOVE), kind[kind >= 0]].astype(np.int32)
        return pa.table({"id": out["id"], "doc": out["doc"], "start": out["start"], "count": out["count"].astype(np.int32), "key": out["key"].view(np.int64), "kind": kinds})

    return run


def _contexts(window: int):
    """Bytes of the wanted segments of a document."""
    kinds = {"id": pa.int64(), "doc": pa.int64(), "start": pa.int64(), "count": pa.int32(), "key": pa.int64(), "kind": pa.int32(), "context": pa.binary()}
    schema = pa.schema(list(kinds.items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for id_, doc, text, wanted in zip(*(batch.column(n).to_pylist() for n in ("id", "doc", "text", "wanted")), strict=True):
                data = text.encode("utf-8", "surrogatepass")
                for w in wanted:
                    context = data[w["start"] : w["start"] + w["count"] + window - 1]
                    rows.append({**w, "id": id_, "doc": doc, "context": context})
                if len(rows) > 20_000:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows = []
            yield pa.RecordBatch.from_pylist(rows, schema)

    return run


def _runs(ids: np.ndarray, docs: np.ndarray, starts: np.ndarray, masks: list[np.ndarray]) -> pa.Table:
    id_, doc, start, count = [], [], [], []
    for i, d, s, mask in zip(ids, docs, starts, masks, strict=True):
        edge = np.flatnonzero(np.diff(np.r_[False, mask, False].astype(np.int8)))
        for low, high in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            id_.append(i)
            doc.append(d)
            start.append(s + low)
            count.append(high - low)
    return pa.table({"id": pa.array(id_, pa.int64()), "doc": pa.array(doc, pa.int64()), "start": pa.array(start, pa.int64()), "count": pa.array(count, pa.int32())})


def _index(window: int):
    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([(c, "ascending") for c in ("id", "doc", "start")])
        ids, docs, starts = (group[c].to_numpy() for c in ("id", "doc", "start"))
        counts = group["count"].to_numpy().astype(np.int64)
        masks = earlier_windows(group["context"].to_pylist(), counts, window, ids, docs)
        return _runs(ids, docs, starts, masks)

    return run


def _window_hashes(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [], [], [], [], []
            for id_, doc, start, count, context in zip(*(batch.column(n).to_pylist() for n in ("id", "doc", "start", "count", "context")), strict=True):
                data = np.frombuffer(context, np.uint8)
                h32, h64 = gram_hashes(data)
                tail = np.arange(count) + window - 64
                out[0].append(h64[:count].view(np.int64))
                out[1].append((h64[tail] ^ (h32[tail - GRAM] * np.uint64(0x165667B19E3779F9))).view(np.int64))
                out[2].append(np.full(count, id_))
                out[3].append(np.full(count, doc))
                out[4].append(start + np.arange(count))
            arrays = [pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64()) for x in out]
            yield pa.RecordBatch.from_arrays(arrays, ["a", "b", "id", "doc", "start"])

    return run


def _keyed(docs: DataFrame, id_: str, doc: str) -> DataFrame:
    """``docs`` with a ``doc``: a hash of the text where its ``id_`` may be that of several rows, else 0."""
    again = materialise(docs.groupBy(id_).count().where("count > 1").select(id_))
    cells = stored_cells(again, id_).withColumn("_several", F.lit(True))
    marked = docs.withColumn("_cell", id_cell(id_)).join(F.broadcast(cells), "_cell", "left")
    return marked.withColumn(doc, F.when(F.col("_several"), F.xxhash64("text")).otherwise(F.lit(0))).drop("_cell", "_several")


def repeated_windows(docs: DataFrame, window: int = WINDOW, most_contexts: int = MOST_CONTEXTS) -> DataFrame:
    """Runs ``id, doc, start, count`` of window starts whose window occurs earlier; ``docs`` has ``id, doc, text``."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    buckets = max(shuffle_partitions(spark), -(-size // BUCKET_BYTES))
    docs = docs.where(F.octet_length("text") >= window).select("id", "doc", "text")
    # Repeated rows are one document.
    docs = docs.where("doc = 0").unionByName(docs.where("doc <> 0").dropDuplicates(["id", "doc"]))
    parsed = docs.mapInArrow(_segments(window, buckets), "bucket int, rows binary")
    marks = materialise(parsed.groupBy("bucket").applyInArrow(_resolve(most_contexts), _MARK))

    open_ = marks.where(F.col("kind") != REMOVE)
    wanted = open_.groupBy("id", "doc").agg(F.collect_list(F.struct("start", "count", "key", "kind")).alias("wanted"))
    cells = stored_cells(open_, "id")
    texts = with_ids(docs, "id", cells)
    shape = "id long, doc long, start long, count int, key long, kind int, context binary"
    contexts = materialise(texts.join(wanted, ["id", "doc"]).select("id", "doc", "text", "wanted").mapInArrow(_contexts(window), shape))

    sizes = {r.kind: r.n for r in contexts.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    groups = max(shuffle_partitions(spark), -(-sizes.get(INDEX, 0) // BUCKET_CONTEXTS))
    shared = contexts.where(F.col("kind") == INDEX).withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(groups)))
    runs = "id long, doc long, start long, count int"
    indexed = shared.groupBy("bucket").applyInArrow(_index(window), runs)
    found = marks.where(F.col("kind") == REMOVE).select("id", "doc", "start", "count").unionByName(indexed)
    if sizes.get(HASH):
        windows = contexts.where(F.col("kind") == HASH).mapInArrow(_window_hashes(window), "a long, b long, id long, doc long, start long")
        windows = materialise(windows)
        place = F.struct("id", "doc", "start")
        first = windows.groupBy("a", "b").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1")
        later = windows.join(first, ["a", "b"]).where(place > F.col("first"))
        level = (F.col("id") == F.col("first.id")) & (F.col("doc") != F.col("first.doc"))
        found = found.unionByName(later.where(~level).select("id", "doc", "start", F.lit(1).alias("count")))
        # Another text of the first one's id loses nothing to it, only what it says twice itself.
        level = materialise(later.where(level).select("a", "b", "id", "doc", "start"))
        own = level.groupBy("a", "b", "id", "doc").agg(F.min("start").alias("low"), F.count("*").alias("n")).where("n > 1")
        twice = level.join(own, ["a", "b", "id", "doc"]).where("start > low")
        found = found.unionByName(twice.select("id", "doc", "start", F.lit(1).alias("count")))
    return found


def _kept(window: int, as_text: bool):
    @F.pandas_udf(f"struct<n_removed: long, n_spans: long, kept: {'string' if as_text else 'binary'}>")
    def apply(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
        out = []
        for text, own in zip(texts, spans, strict=True):
            data = (text or "").encode("utf-8", "surrogatepass")
            if own is None or not len(own):
                out.append((0, 0, (text or "") if as_text else data))
                continue
            edge = np.zeros(len(data) + 1, np.int32)
            for s in own:
                edge[s["start"]] += 1
                edge[s["start"] + s["count"] + window - 1] -= 1
            gone = np.cumsum(edge)[:-1] > 0
            n_spans = int(np.count_nonzero(np.diff(np.r_[False, gone].astype(np.int8)) == 1))
            kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
            out.append((int(gone.sum()), n_spans, kept.decode("utf-8", "ignore") if as_text else kept))
        return pd.DataFrame(out, columns=["n_removed", "n_spans", "kept"])

    return apply


def remove_repeats(docs: DataFrame, window: int = WINDOW, most_contexts: int = MOST_CONTEXTS, as_text: bool = False) -> DataFrame:
    """``docs`` (any columns, among them ``doc_id, text``) with ``n_bytes, n_removed, n_spans`` and the ``kept`` bytes.

    With ``as_text``, ``kept`` is a string without the bytes of characters that were cut apart.

    A byte goes if a ``window``-byte string over it also starts earlier: at a
    smaller ``doc_id``, or earlier in the same document.  Matches never cross
    documents and are judged on the texts as they came in.  A null text is
    empty; a null ``doc_id`` is smaller than all others.  Rows that share a
    ``doc_id`` are taken for copies of one document: each loses the same bytes,
    none to the other; texts that differ under one id are cut only where they
    repeat other ids.  Columns named like new ones are replaced.
    """
    bound_batches(docs.sparkSession)
    docs = docs.drop("n_bytes", "n_removed", "n_spans", "kept").withColumn("_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))))
    docs = _keyed(docs, "_id", "_doc")
    found = repeated_windows(docs.select(F.col("_id").alias("id"), F.col("_doc").alias("doc"), "text"), window, most_contexts)
    spans = found.groupBy(F.col("id").alias("_id"), F.col("doc").alias("_doc")).agg(F.collect_list(F.struct("start", "count")).alias("_spans"))
    spans = materialise(spans)
    cells = stored_cells(spans, "_id")
    whole = without_ids(docs, "_id", cells).withColumn("_spans", F.lit(None).cast(spans.schema["_spans"].dataType))
    cut = with_ids(docs, "_id", cells).join(spans, ["_id", "_doc"], "left").select(whole.columns)
    out = whole.unionByName(cut).withColumn("_kept", _kept(window, as_text)("text", "_spans"))
    return out.withColumns(
        {
            "n_bytes": F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"),
            **{c: F.col(f"_kept.{c}") for c in ("n_removed", "n_spans", "kept")},
        }
    ).drop("_id", "_doc", "_spans", "_kept")


