"""Sets of ids per key, dealt and united by numpy in Arrow batches; the distances of a network are built of them.

A row of lists holds a key and up to ``ROW`` ids as 64-bit differences.  To deal them out
is to send the ids of a row to each of its keys: a hash of the key names a tile, and per
piece of about ``PIECE`` ids a tile gets one row, in which a list that several of its keys
share is written once.  Behind the shuffle a task unites one tile after the other by one
sort of whole numbers.  No row is made per id before ``distances`` returns them.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketlake.session import stored

# Workers need not be able to import this package: what they run is sent by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROW = 2048  # ids of a row of lists
PIECE = 4_000_000  # ids that a task deals out at once
TILE = 2_000_000  # ids of a tile, as far as its keys allow
HELD = 8_000_000  # ids that a task keeps of a tile before it unites them
CHUNK = 100_000  # ids that are sorted at once
LINK_TILES, MOST_TILES = 1024, 65_536
_PLANES = ((0, 2), (2, 1), (3, 1), (4, 4))  # first byte and width: most numbers are small, and empty planes are left out
_DEALT = [("tile", pa.int32()), ("depth", pa.int32()), ("heads", pa.binary()), ("sizes", pa.binary())]
_DEALT = pa.schema([*_DEALT, *((f"{x}{i}", pa.binary()) for x in "kv" for i in range(len(_PLANES)))])
_DEALT_KINDS = ", ".join(f"{f.name} {'binary' if f.type == pa.binary() else 'int'}" for f in _DEALT)

Batches = Iterator[pa.RecordBatch]
Part = tuple[np.ndarray, ...]  # keys, where the ids of each begin, how many they are and their depth; and all ids
Parts = Iterator[Part]


def _hashed(a: np.ndarray, n: int, salt: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    return ((a.view(np.uint64) * np.uint64(salt)) >> np.uint64(32)).astype(np.int64) % n


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before; the first one does."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


def _starts(sizes: np.ndarray) -> np.ndarray:
    return np.cumsum(sizes) - sizes


def _gathered(a: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    at = np.repeat(starts - _starts(sizes), sizes)
    at += np.arange(len(at))
    return a[at]


def _differences(a: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """What is added to the id before it; the first id of a list stands for itself."""
    out = np.diff(a, prepend=a[:1])
    out[starts] = a[starts]
    return out


def _summed(a: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The ids of lists, none of them empty, from their differences."""
    total, starts = np.cumsum(a), _starts(sizes)
    return total - np.repeat(total[starts] - a[starts], sizes)


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary column, and how many each row has."""
    at = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4).astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, np.diff(at)


def _binary(a: np.ndarray, edges: np.ndarray) -> pa.Array:
    """Rows ``a[edges[i]:edges[i + 1]]`` as bytes."""
    at = (edges * a.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(a))])


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Differences of all lists and the sizes of the lists; a number is a list of one."""
    if pa.types.is_integer(column.type):
        a = column.to_numpy(zero_copy_only=False).astype(np.int64)
        return a, np.ones(len(a), np.int64)
    data, sizes = _bytes(column)
    return data.view(np.int64), sizes // 8


def _to_planes(a: np.ndarray, edges: np.ndarray) -> list[pa.Array]:
    bits = int(np.bitwise_or.reduce(a.view(np.uint64))).bit_length()
    none = (np.zeros(0, np.uint8), edges * 0)
    planes = [((a >> (8 * low) if low else a).astype(f"<u{width}"), edges) if bits > 8 * low else none for low, width in _PLANES]
    return [_binary(*plane) for plane in planes]


def _of_planes(columns: list[pa.Array], sizes: np.ndarray) -> np.ndarray:
    out = np.zeros(int(sizes.sum()), np.int64)
    for column, (low, width) in zip(columns, _PLANES, strict=True):
        data, n = _bytes(column)
        if len(data):
            part = data.view(f"<u{width}").astype(np.int64) << (8 * low)
            out[slice(None) if len(part) == len(out) else np.repeat(n > 0, sizes)] |= part
    return out


def _piece(keys: np.ndarray, n_keys: np.ndarray, ids: np.ndarray, n_ids: np.ndarray, tiles: tuple[int, int], depth: int):
    """One batch with a row per tile."""
    parts, sides = tiles
    if sides > 1:  # the ids of a list are told apart by a hash as well
        ids = _summed(ids, n_ids)
        side = np.repeat(np.arange(len(n_ids)) * sides, n_ids) + _hashed(ids, sides, 0xD6E8FEB86659FD93)
        order = np.argsort(side, kind="stable")
        side, ids = side[order], ids[order]
        starts = np.flatnonzero(_changes(side))
        ids, n_ids, side = _differences(ids, starts), np.diff(starts, append=len(ids)), side[starts]
        keys, n_keys = _gathered(keys, _starts(n_keys)[side // sides], n_keys[side // sides]), n_keys[side // sides]
        tile = _hashed(keys, parts) * sides + np.repeat(side % sides, n_keys)
    else:
        tile = _hashed(keys, parts)
    row = np.repeat(np.arange(len(n_keys)), n_keys)
    order = np.argsort(tile.astype(np.uint16) if parts * sides <= 65536 else tile, kind="stable")
    tile, row, keys = tile[order], row[order], keys[order]
    heads = _changes(tile, row)
    sent = row[heads]
    sizes = n_ids[sent]
    ids = _gathered(ids, _starts(n_ids)[sent], sizes)
    firsts = np.flatnonzero(_changes(tile))
    per_key = np.append(firsts, len(tile))
    per_list = np.append(np.cumsum(heads)[firsts] - 1, len(sent))
    per_id = np.append(0, np.cumsum(sizes))[per_list]
    columns = [pa.array(tile[firsts], pa.int32()), pa.array(np.full(len(firsts), depth), pa.int32())]
    columns += [_binary(heads.view(np.uint8), per_key), _binary(sizes.astype(np.int32), per_list)]
    return pa.record_batch([*columns, *_to_planes(keys, per_key), *_to_planes(ids, per_id)], schema=_DEALT)


def _deal(tiles: tuple[int, int], depth: int, both_ways: bool = False) -> Callable[[Batches], Batches]:
    """``both_ways`` deals single ids to single keys and the keys to the ids."""
    most = PIECE

    def run(batches: Batches) -> Batches:
        held, cost = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, n_keys = _lists(batch.column(0))
            ids, n_ids = _lists(batch.column(1))
            if both_ways:
                keys, ids = np.append(keys, ids), np.append(ids, keys)
                n_keys = n_ids = np.ones(len(keys), np.int64)
            keys = _summed(keys, n_keys)
            work = np.cumsum(n_keys + np.minimum(n_keys, tiles[0]) * n_ids)
            at = [0, *(1 + np.flatnonzero(np.diff(work // most))).tolist(), len(work)]
            key_at, id_at = np.append(0, np.cumsum(n_keys)), np.append(0, np.cumsum(n_ids))
            for low, high in zip(at, at[1:], strict=False):
                held.append((keys[key_at[low] : key_at[high]], n_keys[low:high], ids[id_at[low] : id_at[high]], n_ids[low:high]))
                cost += int(work[high - 1] - (work[low - 1] if low else 0))
                if cost >= most or len(at) > 2:
                    yield _piece(*map(np.concatenate, zip(*held, strict=True)), tiles, depth)
                    held, cost = [], 0
        if held:
            yield _piece(*map(np.concatenate, zip(*held, strict=True)), tiles, depth)

    return run


def _read(batch: pa.RecordBatch) -> Part:
    """What was dealt; keys may share their ids."""
    heads, n_keys = _bytes(batch.column("heads"))
    sizes, n_lists = _bytes(batch.column("sizes"))
    sizes, n_lists = sizes.view(np.int32).astype(np.int64), n_lists // 4
    n_ids = np.add.reduceat(sizes, _starts(n_lists))
    keys = _of_planes([batch.column(f"k{i}") for i in range(len(_PLANES))], n_keys)
    ids = _summed(_of_planes([batch.column(f"v{i}") for i in range(len(_PLANES))], n_ids), sizes)
    depths = np.repeat(batch.column("depth").to_numpy().astype(np.int64), n_keys)
    which = np.cumsum(heads, dtype=np.int64) - 1
    return keys, _starts(sizes)[which], sizes[which], depths, ids


def _bits(a: np.ndarray) -> int:
    return (int(a.max()) - int(a.min())).bit_length()


def _sorted(keys: np.ndarray, sizes: np.ndarray, depths: np.ndarray, ids: np.ndarray) -> Parts:
    for_depth = int(depths.max()).bit_length()
    key_names = id_names = None
    if _bits(keys) + _bits(ids) + for_depth > 62:
        key_names, keys = np.unique(keys, return_inverse=True)
    if _bits(keys) + _bits(ids) + for_depth > 62:
        id_names, ids = np.unique(ids, return_inverse=True)
    key_low, id_low, for_key, for_id = keys.min(), ids.min(), _bits(keys), _bits(ids)
    # One number holds key, id and depth.
    kind = np.uint32 if for_key + for_id + for_depth <= 32 else np.int64
    heads = ((keys - key_low) << (for_id + for_depth)) | depths
    whole = (ids - id_low).astype(kind)
    if for_depth:
        whole <<= kind(for_depth)
    whole += np.repeat(heads.astype(kind), sizes)
    whole.sort()
    whole = whole[_changes(whole >> kind(for_depth) if for_depth else whole)]
    for depth in range(1 << for_depth):
        pairs = (whole[whole & kind((1 << for_depth) - 1) == depth] >> kind(for_depth)) if for_depth else whole
        if not len(pairs):
            continue
        keys = pairs >> kind(for_id)
        starts = np.flatnonzero(_changes(keys))
        keys = keys[starts].astype(np.int64) + key_low
        pairs = (pairs & kind((1 << for_id) - 1)).astype(np.int64)
        pairs += id_low
        sizes = np.diff(starts, append=len(pairs))
        keys = keys if key_names is None else key_names[keys]
        yield keys, starts, sizes, np.full(len(keys), depth), pairs if id_names is None else id_names[pairs]


def _united(held: list[Part]) -> Parts:
    """The same by depth, the keys in order: every pair once, with its least depth."""
    before = _starts(np.array([len(x[-1]) for x in held]))
    keys, sizes, depths, ids = (np.concatenate([x[i] for x in held]) for i in (0, 2, 3, 4))
    starts = np.concatenate([x[1] + b for x, b in zip(held, before, strict=True)])
    # What the caches hold is sorted faster: the ids of some keys at a time.
    if len(keys) * 4 <= sizes.sum():
        order = np.argsort(keys)
        keys, starts, sizes, depths = keys[order], starts[order], sizes[order], depths[order]
        firsts = np.flatnonzero(_changes(keys))
        chunk = _starts(sizes)[firsts] // CHUNK
        at = np.append(firsts[_changes(chunk)], len(keys))
    else:
        at = np.array([0, len(keys)])
    for low, high in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        some = slice(low, high)
        yield from _sorted(keys[some], sizes[some], depths[some], _gathered(ids, starts[some], sizes[some]))


def _rows(keys: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of rows of up to ``ROW`` ids, where the rows begin, and the end."""
    n = -(-sizes // ROW)
    place = np.arange(n.sum()) - np.repeat(_starts(n), n)
    return np.repeat(keys, n), np.append(np.repeat(_starts(sizes), n) + ROW * place, sizes.sum())


def _as_lists(depth: int) -> Callable[..., Batches]:
    """``node, n, ids`` of one depth."""

    def rows(keys, _, sizes, depths, ids) -> Batches:
        if depths[0] == depth:
            keys, at = _rows(keys, sizes)
            lists = _binary(_differences(ids, at[:-1]), at)
            yield pa.record_batch([pa.array(keys), pa.array(np.diff(at)), lists], names=["node", "n", "ids"])

    return rows


def _as_arrays(keys, _, sizes, depths, ids) -> Batches:
    """``seed_id, depth, nodes``."""
    keys, at = _rows(keys, sizes)
    lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids))
    yield pa.record_batch([pa.array(keys), pa.array(np.full(len(keys), depths[0]), pa.int32()), lists], names=["seed_id", "depth", "nodes"])


def _unite(rows: Callable[..., Batches], in_parts: bool = False) -> Callable[[Batches], Batches]:
    """Tiles, each in rows that follow each other, united; ``in_parts`` lets one that is too large come piecewise, pairs repeated."""
    least = HELD

    def ended(held: list[Part]) -> Batches:
        for of_depth in _united(held):
            yield from rows(*of_depth)

    def run(batches: Batches) -> Batches:
        tile, held, size, most = None, [], 0, least
        for batch in batches:
            tiles = batch.column("tile").to_numpy()
            at = [*np.flatnonzero(_changes(tiles)).tolist(), len(tiles)]
            for low, high in zip(at, at[1:], strict=False):
                if held and tiles[low] != tile:
                    yield from ended(held)
                    held, size, most = [], 0, least
                tile = tiles[low]
                held.append(_read(batch.slice(low, high - low)))
                size += int(held[-1][2].sum())
                if size > most:
                    held = [*_united(held)]
                    size = sum(len(x[-1]) for x in held)
                    if in_parts and size > least // 2:
                        for of_depth in held:
                            yield from rows(*of_depth)
                        held, size = [], 0
                    most = max(least, 2 * size)
        if held:
            yield from ended(held)

    return run


def _dealt(lists: DataFrame, key: str | Column, ids: str | Column, tiles: tuple[int, int], depth: int) -> DataFrame:
    return lists.select(key, ids).mapInArrow(_deal(tiles, depth), _DEALT_KINDS)


def _by_tile(dealt: DataFrame, tasks: int | None = None) -> DataFrame:
    return (dealt.repartition(tasks, "tile") if tasks else dealt.repartition("tile")).sortWithinPartitions("tile")


def _neighbours(citations: DataFrame) -> DataFrame:
    """``node, n, ids``: lists of the neighbours of each node, both ways; those of hubs may overlap."""
    ends = [F.col(c).cast("bigint") for c in ("citing_opinion_id", "cited_opinion_id")]
    links = citations.where(ends[0] != ends[1]).select(*ends)
    dealt = links.mapInArrow(_deal((LINK_TILES, 1), 0, True), _DEALT_KINDS)
    united = _by_tile(dealt).mapInArrow(_unite(_as_lists(0), True), "node long, n long, ids binary")
    return stored(united, "neighbours")


def distances(citations: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """``seed_id, node, depth``: all nodes within ``depth`` undirected hops of each seed, with the least number of hops.

    A level holds lists of the seeds that reach a node.  They are joined with the lists of
    its neighbours and dealt out to these; what a node had before is dealt along, and only
    seeds that are new to it make the next level.  The last hop is dealt to the seeds
    instead, with all levels before it, so the rows of a seed come from few tasks and
    counting them by seed shuffles little.  The number of tiles follows from the number of
    steps over links; where seeds are few or their surroundings large, nodes are dealt to several tiles.
    """
    ids = seeds.select(F.col(seeds.columns[0]).cast("bigint").alias("node")).where("node is not null").distinct()
    level = stored(ids.select("node", F.lit(1).cast("bigint").alias("n"), F.col("node").alias("ids")), "seeds")
    if depth < 1:
        return level.select(F.col("node").alias("seed_id"), "node", F.lit(0).alias("depth"))
    neighbours = _neighbours(citations)
    n_seeds, n_nodes = max(level.count(), 1), neighbours.count()
    levels, known = [level], 0
    while True:
        hop = len(levels)
        counts = neighbours.select("node", F.col("n").alias("_n"))
        made = level.join(counts, "node").agg(F.sum(F.col("n") * F.col("_n"))).head()[0] or 0
        known += level.agg(F.sum("n")).head()[0] or 0
        last = hop == depth or not made
        tiles = min((made + known) // TILE + 1, MOST_TILES)
        sides = (n_nodes if last else n_seeds) // HELD + 1
        sides = max(sides, -(-tiles // n_seeds)) if last else sides
        shape = (max(1, tiles // sides), sides)
        steps = level.join(neighbours.select("node", F.col("ids").alias("next")), "node")
        if last:
            parts = [_dealt(x, "ids", "node", shape, d) for d, x in enumerate(levels)]
            parts += [_dealt(steps, "ids", "next", shape, hop)] if made else []
        else:
            parts = [_dealt(x, "node", "ids", shape, d) for d, x in [*enumerate(levels)][-2:]]
            parts += [_dealt(steps, "next", "ids", shape, hop)]
        dealt = parts[0]
        for p in parts[1:]:
            dealt = dealt.unionByName(p)
        tiles = shape[0] * sides
        dealt = _by_tile(dealt, tiles if tiles < 64 else max(64, tiles // 4))
        if last:
            rows = dealt.mapInArrow(_unite(_as_arrays), "seed_id long, depth int, nodes array<long>")
            return rows.select("seed_id", F.explode("nodes").alias("node"), "depth")
        level = stored(dealt.mapInArrow(_unite(_as_lists(hop)), "node long, n long, ids binary"), "level")
        levels.append(level)
