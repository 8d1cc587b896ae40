"""Exact Jaccard join of word shingle sets by a universe partition.

Documents with equal sets are one class; only classes are joined.  A class
files itself under segment subsets of its set, chosen by cost (see
``signatures``), and two classes that share one are candidates.

Candidates are not expanded into all pairs of a list.  Every class of a list is
paired with one of them.  Of these pairs, each class's most promising one is
verified first, then those that are still in different components, and last all
pairs of a list across components.  That loses no link that could join two
components.  These last pairs are never rows: a list is cut into blocks, a task
compares two blocks of it as matrices of sizes and bitmaps, which bound what two
sets can share, and returns the pairs that both allow: first the most promising one
of every two components, then, of components that this did not join, all, in the
lists that had such pairs.  Whole sets are only sent for those, and built once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketlake.llm.common import bound_batches, materialise, shuffle_partitions, stored_cells, unused, with_ids, without_ids
from docketlake.llm.components import components
from docketlake.llm.shingle_sets import mix, most_common, set_hash, shingle_sets, signatures, sketch

PERCENT = 75
#: Frequent shingles that steer the choice of segments; broadcast, whatever the corpus size.
HOT = 1 << 18
#: Shingles counted at once for that, and uses among them from which one is reported.
COUNTED = 1_000_000
REPORTED = 3
BUCKET_BYTES = 1 << 23
#: Classes of a list that a task compares with as many others, and words of bitmaps it compares at a time.
BLOCK = 2048
WORDS_AT_ONCE = 1 << 21
#: Classes of a list whose pairs are listed in memory, so many pairs at a time, and not compared as a matrix.
SHORT = 64
PAIRS_AT_ONCE = 1 << 18
#: What rounding may take from a bound in percent.
SLACK = 1e-9
#: Set sizes are filed by their logarithm to this base; from so many steps on, the smaller has less than 3/4 of the larger.
SIZE_BASE, FAR = 1.05, 7
_FILED = np.dtype([("sig", "<u8"), ("cls", "<i8")])


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Set size and class of every document (kind 0), and shingles that are frequent where they were counted (kind 1)."""
    kept, size = [], 0

    def rows(kind: int, row, cls, n, bits=None) -> pa.RecordBatch:
        columns = [np.full(len(cls), kind, np.int32), row, np.asarray(cls, np.int64), np.asarray(n, np.int64)]
        bits = pa.nulls(len(cls), pa.binary()) if bits is None else pa.array(bits, pa.binary())
        return pa.RecordBatch.from_arrays([*map(pa.array, columns), bits], ["kind", "row", "cls", "n", "bits"])

    def frequent() -> pa.RecordBatch:
        value, uses = np.unique(np.concatenate(kept), return_counts=True)
        at = uses >= REPORTED
        return rows(1, np.zeros(int(at.sum()), np.int64), value[at].view(np.int64), uses[at])

    for batch in batches:
        cls, n, bits = [], [], []
        for shingles in shingle_sets(batch.column(1).to_pylist()):
            cls.append(set_hash(shingles))
            n.append(len(shingles))
            bits.append(sketch(shingles))
            kept.append(shingles)
            size += len(shingles)
        yield rows(0, batch.column(0).to_numpy(), cls, n, bits)
        if size >= COUNTED:
            yield frequent()
            kept, size = [], 0
    if kept:
        yield frequent()


def _file(hot, buckets: int):
    def packed(filed: list[np.ndarray]) -> pa.RecordBatch:
        rows = np.concatenate(filed)
        bucket = (rows["sig"] >> np.uint64(13)) % np.uint64(buckets)
        order = np.argsort(bucket, kind="stable")
        rows, bucket = rows[order], bucket[order]
        starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        parts = [rows[a:b].tobytes() for a, b in zip(starts, np.r_[starts[1:], len(rows)], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(bucket[starts].astype(np.int32)), pa.array(parts, pa.binary())], ["bucket", "rows"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filed, size, seen = [], 0, set()
        value, uses = hot.value
        for batch in batches:
            for shingles in shingle_sets(batch.column(0).to_pylist()):
                cls = set_hash(shingles)
                if cls in seen:  # copies file once
                    continue
                seen.add(cls)
                sig = signatures(shingles, value, uses)
                rows = np.zeros(len(sig), _FILED)
                step = min(255, int(np.log(max(1, len(shingles))) / np.log(SIZE_BASE)))
                rows["sig"], rows["cls"] = sig & ~np.uint64(255) | np.uint64(step), cls
                filed.append(rows)
                size += len(rows)
            if size >= COUNTED:
                yield packed(filed)
                filed, size, seen = [], 0, set()
        if size:
            yield packed(filed)

    return run


_LISTED = "list long, u long, v long, n long"


def _lists(group: pa.Table) -> pa.Table:
    """Star pairs of the lists of classes (``list`` null) with the number of lists, and the members of lists of three or more.

    A list's classes are in the order of their sizes, and it is cut where they are too far apart to link.
    The class that all others are paired with is not among the members: the star pairs are all it has there.
    """
    rows = np.unique(np.frombuffer(b"".join(group["rows"].to_pylist()), _FILED))
    place, step = rows["sig"] >> np.uint64(8), (rows["sig"] & np.uint64(255)).astype(np.int64)
    fresh = np.r_[True, (place[1:] != place[:-1]) | (step[1:] - step[:-1] >= FAR)]
    starts = np.flatnonzero(fresh)
    sizes = np.diff(np.r_[starts, len(rows)])
    several = np.repeat(sizes > 1, sizes)
    cls, step, number = rows["cls"][several], step[several], np.repeat(np.arange(len(sizes)), sizes)[several]
    if not len(cls):
        return pa.table({n: pa.array([], pa.int64()) for n in ("list", "u", "v", "n")})
    begin = np.flatnonzero(np.r_[True, number[1:] != number[:-1]])
    size = np.diff(np.r_[begin, len(cls)])
    # Lists with the same members are one list.
    name = mix(np.add.reduceat(mix(cls.view(np.uint64)), begin) + size.astype(np.uint64)).view(np.int64)
    _, first = np.unique(name, return_index=True)
    chosen = np.zeros(len(begin), bool)
    chosen[first] = True
    at = np.repeat(chosen, size)
    pivot = np.repeat(cls[begin], size)
    near = (pivot != cls) & (step - np.repeat(step[begin], size) < FAR)
    pairs, shared = np.unique(np.stack([pivot, cls], axis=1)[near], axis=0, return_counts=True)
    longer = at & np.repeat(size > 2, size) & (pivot != cls)
    lists = np.repeat(name, size)[longer]
    none = pa.nulls(len(pairs), pa.int64())
    return pa.table(
        {
            "list": pa.concat_arrays([none, pa.array(lists)]),
            "u": np.r_[pairs[:, 0], cls[longer]],
            "v": np.r_[pairs[:, 1], cls[longer]],
            "n": np.r_[shared, np.zeros(len(lists), np.int64)],
        }
    )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = list(shingle_sets(batch.column("text").to_pylist()))
        cls = np.array([set_hash(s) for s in found], np.int64)
        blobs = pa.array([s.tobytes() for s in found], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(cls), blobs], ["cls", "shingles"])


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column("a"), batch.column("b"), strict=True):
                a, b = (np.frombuffer(x.as_buffer(), np.uint64) for x in (a, b))
                both = np.sort(np.concatenate([a, b]), kind="stable")
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                keep.append(100 * common >= percent * (len(a) + len(b) - common))
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return run


def _may_link(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("a", "na", "b", "nb"))
            keep = []
            for a, na, b, nb in zip(*columns, strict=True):
                common = most_common(a, na, b, nb)
                keep.append(100 * common >= percent * (na + nb - common))
            yield batch.select(["u", "v", "n"]).filter(pa.array(keep, pa.bool_()))

    return run


def _most(n: np.ndarray, other: np.ndarray, ones: np.ndarray, other_ones: np.ndarray, both: np.ndarray) -> np.ndarray:
    """Upper bound in percent of the similarity of sets of sizes ``n`` and ``other``, by the set bits of their bitmaps."""
    # A bit that only one has stands for a shingle it does not share.
    common = np.minimum(n - (ones - both), other - (other_ones - both))
    return 100 * common / (n + other - common)


class _Bitmaps:
    """Bitmaps of a task's classes, as one matrix of words for each length."""

    def __init__(self, bits: list[bytes]) -> None:
        self.width = np.array([len(b) for b in bits], np.int64)
        self.row = np.zeros(len(bits), np.int64)
        self.rows: dict[int, np.ndarray] = {}
        for width in np.unique(self.width).tolist():
            at = np.flatnonzero(self.width == width)
            self.row[at] = np.arange(len(at))
            self.rows[width] = np.frombuffer(b"".join([bits[i] for i in at]), np.uint8).reshape(-1, width)

    def folded(self, at: np.ndarray, width: int, size: int) -> np.ndarray:
        """Bitmaps of classes of one ``width``, brought to ``size`` bytes, as 64-bit words where that divides it."""
        rows = self.rows[width][self.row[at]]
        if width != size:
            rows = np.bitwise_or.reduce(rows.reshape(len(rows), -1, size), axis=1)
        return np.ascontiguousarray(rows).view(np.uint64) if size % 8 == 0 else rows


def _compare(percent: int, best: bool):
    def ones(rows: np.ndarray) -> np.ndarray:
        return np.bitwise_count(rows).sum(-1, dtype=np.int64)

    def of_blocks(group, n, maps: _Bitmaps, left: np.ndarray, right: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """Pairs of places, one of ``left`` and one of ``right``, of different groups that the bounds allow, and the bounds."""
        for size in np.unique(maps.width[left]).tolist():
            mine = left[maps.width[left] == size]
            # Sets of similar sizes have bitmaps of equal length or one of half or twice the length.
            for other in (size // 2, size, 2 * size):
                theirs = right[maps.width[right] == other]
                if not len(theirs):
                    continue
                a, b = (maps.folded(at, w, min(size, other)) for at, w in ((mine, size), (theirs, other)))
                ones_a, ones_b = ones(a), ones(b)
                step = max(1, WORDS_AT_ONCE // b.size)
                for low in range(0, len(mine), step):
                    at, part = mine[low : low + step], slice(low, low + step)
                    both = ones(a[part, None, :] & b[None, :, :])
                    most = _most(n[at][:, None], n[theirs][None, :], ones_a[part, None], ones_b[None, :], both)
                    i, j = np.nonzero((most >= percent - SLACK) & (group[at][:, None] != group[theirs][None, :]))
                    yield at[i], theirs[j], most[i, j]

    def of_short_lists(group, n, maps: _Bitmaps, starts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """The same of all pairs inside each of many short lists, some lists at a time."""
        pairs = np.cumsum(sizes * (sizes - 1) // 2)
        for some in np.split(np.arange(len(sizes)), np.flatnonzero(np.diff(pairs // PAIRS_AT_ONCE)) + 1):
            place = np.concatenate([np.arange(s, s + m) for s, m in zip(starts[some], sizes[some], strict=True)])
            behind = np.concatenate([np.arange(m - 1, -1, -1) for m in sizes[some]])
            i = np.repeat(place, behind)
            j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(behind) - behind, behind)
            near = 100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])
            at = np.flatnonzero(near & (group[i] != group[j]))
            i, j = i[at], j[at]
            kinds, kind = np.unique(np.stack([maps.width[i], maps.width[j]], axis=1), axis=0, return_inverse=True)
            for k, (w, v) in enumerate(kinds.tolist()):
                of = np.flatnonzero(kind.ravel() == k)
                for low in range(0, len(of), step := max(1, 8 * WORDS_AT_ONCE // max(w, v))):
                    x, y = i[of[low : low + step]], j[of[low : low + step]]
                    a, b = maps.folded(x, w, min(w, v)), maps.folded(y, v, min(w, v))
                    most = _most(n[x], n[y], ones(a), ones(b), ones(a & b))
                    may = most >= percent - SLACK
                    yield x[may], y[may], most[may]

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("list", "ascending"), ("own", "ascending"), ("cls", "ascending")])
        cls, group, n = (table[c].to_numpy() for c in ("cls", "component", "n"))
        lists, own, maps = table["list"].to_numpy(), table["own"].to_numpy(), _Bitmaps(table["bits"].to_pylist())
        edges = np.flatnonzero(np.r_[True, lists[1:] != lists[:-1]])
        sizes = np.diff(np.r_[edges, len(lists)])
        short = (sizes <= SHORT) & (table["blocks"][0].as_py() == 1)
        found = list(of_short_lists(group, n, maps, edges[short], sizes[short])) if short.any() else []
        for low, size in zip(edges[~short], sizes[~short], strict=True):
            here = np.arange(low, low + size)
            first = here[own[here] == own[low]]
            rest = here[len(first) :]
            found += of_blocks(group, n, maps, first, rest if len(rest) else first)
        i, j, most = (np.concatenate([np.zeros(0, kind), *(pair[k] for pair in found)]) for k, kind in enumerate((np.int64, np.int64, float)))
        pairs = np.stack([np.minimum(cls[i], cls[j]), np.maximum(cls[i], cls[j])], axis=1)
        groups = np.stack([np.minimum(group[i], group[j]), np.maximum(group[i], group[j])], axis=1)
        if best:
            order = np.lexsort((pairs[:, 1], pairs[:, 0], -most, groups[:, 1], groups[:, 0]))
            _, at = np.unique(groups[order], axis=0, return_index=True)
            at = order[at]
        else:
            _, at = np.unique(pairs, axis=0, return_index=True)
        columns = {"u": pairs[at, 0], "v": pairs[at, 1], "cu": groups[at, 0], "cv": groups[at, 1], "most": most[at]}
        rows = pa.table(columns).append_column("list", pa.nulls(len(at), pa.int64()))
        if not best:
            return rows
        hits = np.unique(lists[i])
        none = {name: pa.nulls(len(hits), rows.schema.field(name).type) for name in columns}
        return pa.concat_tables([rows, pa.table({**none, "list": hits})])

    return run


def _across(members: DataFrame, sizes: DataFrame, buckets: int, percent: int, block: int, best: bool = False) -> tuple[DataFrame, DataFrame]:
    """Pairs ``u, v`` of classes that share a list, lie in different components, and may reach the similarity.

    ``members`` has ``list, cls, component``, ``sizes`` has ``cls, n, bits``.  Short lists
    are compared whole, many to a task; a longer one is dealt into blocks, every two of
    which meet in a task.  With ``best`` only the most promising pair of every two
    components is returned, and beside the pairs each ``list`` that has any.  Bitmaps join
    what is left of the lists, and are shuffled once.
    """
    mixed = members.groupBy("list").agg(F.count("*").alias("all"), F.min("component").alias("a"), F.max("component").alias("b"))
    blocks = F.ceil(F.col("all") / block).cast("int").alias("blocks")
    members = members.join(mixed.where("a < b").select("list", blocks), "list")
    members = members.withColumn("own", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    short = members.where("blocks = 1").select("*", F.pmod("list", F.lit(buckets)).alias("task"), F.lit(0).alias("a"), F.lit(0).alias("b"))
    other = members.where("blocks > 1").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    long = other.select("*", F.col("list").alias("task"), F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"))
    met = short.unionByName(long.drop("other")).join(sizes.select("cls", "n", "bits"), "cls")
    met = met.select("task", "a", "b", "blocks", "list", "own", "cls", "component", "n", "bits")
    shape = "u long, v long, cu long, cv long, most double, list long"
    found = materialise(met.groupBy("task", "a", "b", "blocks").applyInArrow(_compare(percent, best), shape))
    pairs, hits = found.where("list is null"), found.where("list is not null").select("list").distinct()
    if best:
        pairs = pairs.groupBy("cu", "cv").agg(F.max(F.struct("most", "u", "v")).alias("best")).select("best.u", "best.v")
    return pairs.select("u", "v").distinct(), hits


class _Classes:
    """Set sizes and bitmaps of classes, and their shingles for the candidates."""

    def __init__(self, docs: DataFrame, described: DataFrame, percent: int) -> None:
        self.docs, self.percent, self.sets = docs, percent, None
        self.sizes = materialise(described.groupBy("cls").agg(F.min("n").alias("n"), F.min("id").alias("id"), F.min("bits").alias("bits")))

    def possible(self, pairs: DataFrame) -> DataFrame:
        """Pairs ``u, v, n`` whose sizes and bitmaps allow the similarity."""
        a = self.sizes.select(F.col("cls").alias("u"), F.col("n").alias("na"), F.col("bits").alias("a"))
        b = self.sizes.select(F.col("cls").alias("v"), F.col("n").alias("nb"), F.col("bits").alias("b"))
        fits = 100 * F.least("na", "nb") >= self.percent * F.greatest("na", "nb")
        both = pairs.join(a, "u").join(b, "v").where(fits)
        return materialise(both.mapInArrow(_may_link(self.percent), "u long, v long, n long"))

    def _shingles(self, used: DataFrame, most: int) -> DataFrame:
        """Shingles of the ``used`` classes and maybe others; those of a class are read from its text once."""
        wanted = self.sizes.join(used, "cls").select("cls", "id")
        if self.sets is not None:
            wanted = wanted.join(self.sets.select("cls"), "cls", "left_anti")
        wanted = materialise(wanted, most_rows=most)
        if wanted.isEmpty():
            return with_ids(self.sets, "cls", stored_cells(used, "cls"))
        texts = with_ids(self.docs, "id", stored_cells(wanted, "id"))
        texts = texts.join(wanted.select("id").distinct(), "id", "left_semi").select("text")
        sets = texts.mapInArrow(_sets, "cls long, shingles binary").dropDuplicates(["cls"])
        sets = materialise(sets.join(wanted.select("cls"), "cls", "left_semi"))
        if self.sets is None:
            self.sets = sets
            return sets
        self.sets = self.sets.unionByName(sets)
        return with_ids(self.sets, "cls", stored_cells(used, "cls"))

    def linked(self, pairs: DataFrame, most: int | None) -> DataFrame:
        """The pairs that reach the similarity, by their whole sets; ``pairs`` has at most ``most`` rows."""
        pairs = materialise(pairs.select("u", "v"), most_rows=most)
        if not (n := pairs.count()):
            return pairs
        sets = self._shingles(pairs.select(F.col("u").alias("cls")).union(pairs.select("v")).distinct(), 2 * n)
        a = sets.select(F.col("cls").alias("u"), F.col("shingles").alias("a"))
        b = sets.select(F.col("cls").alias("v"), F.col("shingles").alias("b"))
        return materialise(pairs.join(a, "u").join(b, "v").mapInArrow(_verify(self.percent), "u long, v long"))


def _hot_shingles(described: DataFrame, bound: int) -> tuple[np.ndarray, np.ndarray]:
    uses = described.where("kind = 1").groupBy("cls").agg(F.sum("n").alias("n"))
    rows = uses.orderBy(F.desc("n"), "cls").limit(bound).collect()
    value = np.array([r.cls for r in rows], np.int64).view(np.uint64)
    order = np.argsort(value)
    return value[order], np.array([r.n for r in rows], np.int64)[order]


def _joined(links: DataFrame) -> DataFrame:
    number = links.count()
    return materialise(components(links, number), most_rows=2 * number)


def _grouped(docs: DataFrame, percent: int, hot: int) -> DataFrame:
    """The columns of ``docs`` but ``text``, with a row key ``id`` (of ``doc_id`` and text), set size ``n`` and ``component``."""
    if percent < PERCENT:
        raise ValueError(f"signatures are complete from {PERCENT} percent")
    spark = docs.sparkSession
    bound_batches(spark)
    others = [c for c in docs.columns if c != "text"]
    # A row's identity outlives this job: rows with equal ids and equal texts are interchangeable.
    keyed = docs.withColumn("_id", F.xxhash64("doc_id", "text"))
    plain = keyed.select(F.col("_id").alias("id"), "text")
    described = plain.mapInArrow(_describe, "kind int, row long, cls long, n long, bits binary")
    described = materialise(described)
    own = described.where("kind = 0").select(F.col("row").alias("id"), "cls", "n", "bits")

    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    buckets = max(shuffle_partitions(spark), -(-size // BUCKET_BYTES))
    frequent = spark.sparkContext.broadcast(_hot_shingles(described, hot))
    filed = plain.select("text").mapInArrow(_file(frequent, buckets), "bucket int, rows binary")
    listed = materialise(filed.groupBy("bucket").applyInArrow(_lists, _LISTED))

    classes = _Classes(plain, own, percent)
    stars = classes.possible(listed.where("list is null").groupBy("u", "v").agg(F.sum("n").alias("n")))
    number = stars.count()
    best = stars.groupBy("v").agg(F.max(F.struct("n", "u")).alias("best")).select("best.u", "v")
    links = classes.linked(best, number)
    joined = _joined(links)
    # Pairs inside a component cannot join anything.
    rest = stars.select("u", "v")
    for end in ("u", "v"):
        group = joined.select(F.col("id").alias(end), F.col("component").alias(f"c{end}"))
        rest = rest.join(group, end, "left").withColumn(f"c{end}", F.coalesce(f"c{end}", end))
    links = links.unionByName(classes.linked(rest.where("cu <> cv"), number))
    joined = _joined(links)

    members = listed.where("list is not null").select("list", F.col("u").alias("cls"))
    size = members.count()
    members = materialise(members.distinct(), most_rows=size)

    def placed(members: DataFrame) -> DataFrame:
        rows = members.join(joined.withColumnRenamed("id", "cls"), "cls", "left")
        return materialise(rows.select("list", "cls", F.coalesce("component", "cls").alias("component")), most_rows=size)

    # One pair of every two components first: where it links, their other pairs need no look.
    pairs, hits = _across(placed(members), classes.sizes, buckets, percent, BLOCK, best=True)
    links = links.unionByName(classes.linked(pairs, size))
    # Components have only grown, so that other lists have no such pairs now either.
    members = materialise(members.join(hits, "list", "left_semi"), most_rows=size)
    if not members.isEmpty():
        joined = _joined(links)
        pairs, _ = _across(placed(members), classes.sizes, buckets, percent, BLOCK)
        links = links.unionByName(classes.linked(pairs.join(stars.select("u", "v"), ["u", "v"], "left_anti"), None))
    joined = components(links, links.count()).withColumnRenamed("id", "cls")

    rows = keyed.select(*[f"`{c}`" for c in others], F.col("_id").alias("id")).join(own.drop("bits").dropDuplicates(["id"]), "id")
    return materialise(rows.join(joined, "cls", "left").withColumn("component", F.coalesce("component", "cls")))


def jaccard_groups(docs: DataFrame, percent: int = PERCENT, hot: int = HOT) -> DataFrame:
    """The columns of ``docs`` but ``text``, with ``n_shingles`` and ``component_id``.

    Words are maximal runs of bytes other than white space, with A-Z in lower
    case; a set holds the distinct shingles of five of them, or all words as one
    shingle if there are fewer.  Documents link from a Jaccard similarity of
    ``percent`` (at least 75).  ``component_id`` is the smallest ``doc_id``
    reachable.  Null and empty texts have empty sets, which link with nothing.
    Repeated rows link with each other; a null ``doc_id`` never names a
    component that holds another id.  Columns of the new names are replaced.
    """
    docs = docs.drop("n_shingles", "component_id", "_cls")
    others = [c for c in docs.columns if c != "text"]
    rows = _grouped(docs, percent, hot)
    names = rows.where("n > 0").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = rows.join(names, "component", "left")
    component = F.when(F.col("n") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id"))
    return named.select(*[f"`{c}`" for c in others], F.col("n").alias("n_shingles"), component.alias("component_id"))


def drop_near_copies(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One document of each component, that of the smallest ``doc_id``, and each repeated row once.

    Rows are told apart by ``doc_id`` and text.  A null ``doc_id`` is larger
    than all others here; of several texts of the smallest one, a hash decides.
    Null and empty texts are in no component.  Only documents that go, or may
    go, are shuffled.
    """
    rows = _grouped(docs.select("doc_id", "text"), percent, HOT)
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "id")
    first = rows.where("n > 0").groupBy("component").agg(F.min(place).alias("first"), F.count("*").alias("size")).where("size > 1")
    row = unused(docs, "_row")
    gone = rows.where("n > 0").join(first, "component").where(F.col("id") != F.col("first.id")).select(F.col("id").alias(row)).distinct()
    again = rows.groupBy(F.col("id").alias(row)).count().where("count > 1").select(row)
    gone = materialise(gone, most_rows=rows.count())
    cells = stored_cells(gone.union(again), row)
    keyed = docs.withColumn(row, F.xxhash64("doc_id", "text"))
    checked = with_ids(keyed, row, cells).join(gone, row, "left_anti").dropDuplicates([row])
    return without_ids(keyed, row, cells).unionByName(checked).drop(row)
