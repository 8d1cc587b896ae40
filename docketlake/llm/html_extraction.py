"""Main text of web pages: page structure first, repeated host boilerplate second.

What stands outside article elements is told apart by repetition.  The token
streams of a host's pages are concatenated and sorted as a suffix array;
substrings of at least ``MIN_TOKENS`` tokens that occur on enough pages (see
``enough``) are boilerplate, and pages without an article element keep the runs
in between.  Copies and near copies of a page without an article element, by the
exact Jaccard join, count as one page.

Two pages may carry the same article, so what articles repeat of each other is
no boilerplate.  A block of an article goes as a whole if boilerplate of its
host, as menus, notices and footers outside articles have it, covers all its
tokens; other blocks are kept as they are.

A host of up to ``HOST_TOKENS`` tokens is one suffix array in one task.  Larger
hosts, however large, get the same result from their suffixes' first
``MIN_TOKENS`` tokens, grouped by hash and counted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketlake.llm.common import bound_batches, materialise, stored_cells, with_ids, without_ids
from docketlake.llm.html_blocks import read_page
from docketlake.llm.jaccard_join import jaccard_groups

MIN_TOKENS = 8
HOST_TOKENS = 2_000_000

# Types, not strings: strings are parsed by a session, which an import does not have.
_STRINGS = T.ArrayType(T.StringType())
_READ = T.StructType().add("text", T.StringType()).add("blocks", _STRINGS).add("has_article", T.BooleanType())
_STREAM = T.StructType().add("tokens", _STRINGS).add("open", T.BooleanType()).add("heads", T.ArrayType(_STRINGS))


def suffix_order(symbols: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in the order of their first ``length`` symbols, and each suffix's rank in it (equal where those agree)."""
    n = len(symbols)
    rank = np.unique(symbols, return_inverse=True)[1].astype(np.int64) + 1
    reach = 1
    while reach < length:
        step = min(reach, length - reach)
        nxt = np.zeros(n, np.int64)
        nxt[: n - step] = rank[step:] if step < n else nxt[:0]
        rank = np.unique(rank * (n + 2) + nxt, return_inverse=True)[1].astype(np.int64) + 1
        reach += step
    return np.argsort(rank, kind="stable"), rank


def enough(n):
    """Of ``n`` different pages of a host, how many have to share boilerplate: a tenth, at least three, two if there are but two or three.

    ``n`` is a number or a column's name.
    """
    if isinstance(n, str):
        return F.when(F.col(n) < 4, 2).otherwise(F.greatest(F.lit(3), F.ceil(F.col(n) / 10)))
    return 2 if n < 4 else max(3, -(-n // 10))


def repeated_starts(symbols: np.ndarray, pages: np.ndarray, classes: np.ndarray, length: int = MIN_TOKENS) -> tuple[np.ndarray, np.ndarray]:
    """Where substrings of ``length`` tokens start that occur on enough different pages, and one place of each.

    ``symbols`` are the concatenated streams, ``pages`` the page of each token,
    ``classes`` what copies of a page have in common.
    """
    none = np.zeros(0, np.int64)
    if len(symbols) < length:
        return none, none
    order, rank = suffix_order(symbols, length)
    inside = order + length <= len(symbols)
    order = order[inside]
    order = order[pages[order] == pages[order + length - 1]]
    group = rank[order]
    if not len(order):
        return none, none
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    number = np.cumsum(np.r_[True, group[1:] != group[:-1]]) - 1
    held = np.unique(np.stack([number, classes[order]]), axis=1)[0]
    several = np.bincount(held, minlength=len(starts)) >= enough(len(np.unique(classes)))
    return order[np.repeat(several, np.diff(np.r_[starts, len(order)]))], order[starts[several]]


def _covered(n: int, starts: np.ndarray, length: int) -> np.ndarray:
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + length, -1)
    return np.cumsum(edge)[:-1] > 0


def _reader(whole: bool):
    """Blocks of pages; unless ``whole``, those of an article as one text, which nothing is taken from."""

    @F.pandas_udf(_READ)
    def _read(pages: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for series in pages:
            rows = [read_page(x or "") for x in series]
            yield pd.DataFrame(
                {
                    "text": ["\n\n".join(p.article) if p.has_article and not whole else None for p in rows],
                    "blocks": [p.rest if not p.has_article else p.article if whole else [] for p in rows],
                    "has_article": [p.has_article for p in rows],
                }
            )

    return _read


def _stream(length: int):
    """Tokens outside articles, and the first ones of every block of an article that is long enough to be boilerplate."""

    @F.pandas_udf(_STREAM)
    def run(pages: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for series in pages:
            rows = [read_page(x or "") for x in series]
            tokens = [[t for b in (p.furniture if p.has_article else p.rest + p.furniture) for t in b.split()] for p in rows]
            # A split bounded in number reads no more of a block than its beginning.
            heads = [[h[:length] for b in p.article if len(h := b.split(None, length)) >= length] if p.has_article else [] for p in rows]
            yield pd.DataFrame({"tokens": tokens, "open": [not p.has_article for p in rows], "heads": heads})

    return run


def _spans(mask: np.ndarray) -> tuple[list[int], list[int]]:
    edge = np.flatnonzero(np.diff(np.r_[False, mask, False].astype(np.int8)))
    return edge[::2].tolist(), edge[1::2].tolist()


def _host_array(length: int):
    def run(group: pa.Table) -> pa.Table:
        lists = group["symbols"].combine_chunks()
        size = np.diff(lists.offsets.to_numpy())
        symbols = lists.flatten().to_numpy()
        classes = np.unique(group["cls"].to_numpy(), return_inverse=True)[1]
        hits, one_each = repeated_starts(symbols, np.repeat(np.arange(len(size)), size), np.repeat(classes, size), length)
        mask = _covered(len(symbols), hits, length)
        host, keys, shown, ends = group["host"][0].as_py(), group["key"].to_pylist(), group["open"].to_pylist(), np.r_[0, np.cumsum(size)]
        out = [(host, k, *_spans(mask[ends[i] : ends[i + 1]]), None) for i, k in enumerate(keys) if shown[i]]
        out += [(host, None, None, None, symbols[at : at + length].tolist()) for at in one_each.tolist()]
        return pa.table({n: [r[c] for r in out] for c, (n, _) in enumerate(_FOUND)}, pa.schema(_FOUND))

    return run


#: Spans of an open page, or the tokens of a run that is boilerplate.
_FOUND = [("host", pa.string()), ("key", pa.int64()), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32())), ("run", pa.list_(pa.int64()))]


def _keep(blocks: list[str], starts: list[int], ends: list[int]) -> str:
    mask = np.zeros(sum(len(b.split()) for b in blocks), bool)
    for s, e in zip(starts, ends, strict=True):
        mask[s:e] = True
    out, at = [], 0
    for block in blocks:
        tokens = block.split()
        kept = [t for t, gone in zip(tokens, mask[at : at + len(tokens)], strict=True) if not gone]
        at += len(tokens)
        if kept:
            out.append(" ".join(kept))
    return "\n\n".join(out)


@F.pandas_udf(T.StringType())
def _unique_runs(blocks: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.Series:
    none = lambda x: [] if x is None else list(x)
    return pd.Series([_keep(none(b), none(s), none(e)) for b, s, e in zip(blocks, starts, ends, strict=True)], dtype=object)


def boilerplate(pages: DataFrame, length: int = MIN_TOKENS, host_tokens: int = HOST_TOKENS) -> DataFrame:
    """Token spans ``key, starts, ends`` to take from pages (``key, url, html``): of the blocks of the article, or of all without one."""
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[a-zA-Z][\w+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1)), F.lit(""))
    hashes = lambda tokens: F.transform(tokens, lambda t: F.xxhash64(t))
    read = pages.select("key", host.alias("host"), _stream(length)("html").alias("s"))
    heads = F.transform("s.heads", lambda h: F.xxhash64(hashes(h)))
    read = read.select("key", "host", F.col("s.open").alias("open"), hashes("s.tokens").alias("symbols"), heads.alias("heads"))
    read = materialise(read.where("size(symbols) > 0 or size(heads) > 0").dropDuplicates(["key"]))
    streams = read.where(F.size("symbols") > 0).drop("heads")
    # Copies and near copies of an open page are one page.
    texts = pages.select(F.col("key").alias("doc_id"), _stream(length)("html").alias("s")).where("s.open")
    texts = materialise(texts.select("doc_id", F.concat_ws(" ", "s.tokens").alias("text")).where("text <> ''").dropDuplicates(["doc_id"]))
    if not texts.isEmpty():
        groups = jaccard_groups(texts).select(F.col("doc_id").alias("key"), F.col("component_id").alias("cls"))
        streams = materialise(streams.join(groups, "key", "left").withColumn("cls", F.coalesce("cls", "key")))
    else:
        streams = streams.withColumn("cls", F.col("key"))
    hosts = streams.groupBy("host").agg(F.sum(F.size("symbols")).alias("n"))
    small = streams.join(hosts.where(F.col("n") <= host_tokens).select("host"), "host")
    shape = "host string, key long, starts array<int>, ends array<int>, run array<long>"
    found = materialise(small.groupBy("host").applyInArrow(_host_array(length), shape))

    large = streams.join(hosts.where(F.col("n") > host_tokens).select("host"), "host", "left_semi")
    windows = _windows(large, length, "host", "key", "cls", "open")
    number = large.select("host", "cls").distinct().groupBy("host").agg(F.count("*").alias("of"))
    shared = windows.select("host", "w", "cls").distinct().groupBy("host", "w").agg(F.count("*").alias("on")).where("on > 1")
    repeated = shared.join(number, "host").where(F.col("on") >= enough("of")).select("host", "w")
    repeated = materialise(repeated.unionByName(found.where("run is not null").select("host", F.xxhash64("run").alias("w"))))
    hits = windows.where("open").join(repeated, ["host", "w"], "left_semi")
    hits = hits.groupBy("key").agg(F.array_sort(F.collect_list("at")).alias("starts"))
    spans = found.where("key is not null").select("key", "starts", "ends")
    spans = spans.unionByName(hits.withColumn("ends", F.transform("starts", lambda s: s + length)))

    # Of articles, only blocks that begin like boilerplate of their host are looked at whole.
    begin = read.select("key", "host", F.explode("heads").alias("w")).join(repeated, ["host", "w"], "left_semi")
    begin = materialise(begin.select("key").distinct())
    held = with_ids(pages, "key", stored_cells(begin, "key")).join(begin, "key", "left_semi").dropDuplicates(["key"])
    held = held.select("key", host.alias("host"), _reader(True)("html")["blocks"].alias("blocks"))
    # White space in a block is single spaces already.
    tokens = F.transform("blocks", lambda b: hashes(F.split(b, " ")))
    before = lambda i: F.aggregate(F.slice("tokens", 1, i), F.lit(0), lambda n, b: n + F.size(b))
    blocks = held.select("key", "host", tokens.alias("tokens")).select("key", "host", F.explode(F.transform("tokens", lambda b, i: F.struct(before(i).alias("start"), b.alias("symbols")))).alias("b"))
    blocks = _windows(blocks.select("key", "host", "b.*"), length, "key", "host", "start", F.size("symbols").alias("n"))
    covered = blocks.join(repeated, ["host", "w"], "left_semi").groupBy("key", "start", "n").agg(F.array_sort(F.collect_list("at")).alias("places"))
    gaps = F.forall(F.sequence(F.lit(1), F.size("places")), lambda i: F.coalesce(F.get("places", i), F.col("n")) - F.get("places", i - 1) <= length)
    whole = covered.where((F.get("places", F.lit(0)) == 0) & gaps).groupBy("key").agg(
        F.collect_list("start").alias("starts"), F.collect_list(F.col("start") + F.col("n")).alias("ends")
    )
    return spans.unionByName(whole)


def _windows(streams: DataFrame, length: int, *columns: str | Column) -> DataFrame:
    """``columns`` with a row for each run of ``length`` tokens in ``symbols``: where it starts and its hash."""
    last = F.size("symbols") - length + 1
    places = F.transform(F.sequence(F.lit(1), last), lambda i: F.struct((i - 1).alias("at"), F.xxhash64(F.slice("symbols", i, length)).alias("w")))
    rows = streams.where(last > 0).select(*columns, F.explode(places).alias("_p"))
    return rows.select(*[c for c in rows.columns if c != "_p"], "_p.at", "_p.w")


def extract_text(pages: DataFrame, length: int = MIN_TOKENS, host_tokens: int = HOST_TOKENS) -> DataFrame:
    """``page_id, url, text, n_chars`` for every row of ``pages`` (``page_id, url, html``).

    Blocks are joined by an empty line in page order; white space in a block is
    one space.  A null or empty page, or one without text, has the text ``""``.
    A url without a host, or null, counts as one host.  Repeated rows of a page
    are one page, and each of them is returned; other columns are left out.
    """
    bound_batches(pages.sparkSession)
    pages = pages.select("page_id", "url", "html", F.xxhash64("page_id", "url", "html").alias("key"))
    spans = materialise(boilerplate(pages, length, host_tokens))
    cells = stored_cells(spans, "key")
    shape = ["page_id", "url", F.col("r.text").alias("text"), F.col("r.blocks").alias("blocks"), "key"]
    plain = without_ids(pages, "key", cells).select("page_id", "url", "key", _reader(False)("html").alias("r")).select(*shape)
    plain = plain.withColumns({c: F.lit(None).cast("array<int>") for c in ("starts", "ends")})
    marked = with_ids(pages, "key", cells).select("page_id", "url", "key", _reader(True)("html").alias("r")).select(*shape)
    marked = marked.join(spans, "key", "left").select(plain.columns)
    both = plain.unionByName(marked)
    text = F.coalesce("text", _unique_runs("blocks", "starts", "ends"))
    return both.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
