"""Near-duplicate vectors by quantised tile products with error bounds.

All rows are compared in square tiles.  Each tile product runs on eight-bit
codes of a short vector: the first ``HEAD`` coordinates of the rotated unit
vector and the length of the rest, whose dot product bounds the cosine from
above.  A code's exact error is kept per vector, so the product plus both errors
is still an upper bound; only pairs that may reach the threshold are recomputed
from the full vectors in double precision.

A task holds two tiles and returns link counts and a spanning forest, never
pairs: a group of copies costs rows in proportion to its members.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketlake.llm.common import materialise
from docketlake.llm.components import components

THRESHOLD = 0.95
#: Rows of a tile; two tiles with their codes and vectors stay within some tens of megabytes.
TILE = 8192
HEAD = 16
BLOCK = 1024


def quantise(unit: np.ndarray, head: int = HEAD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Eight-bit codes of unit rows, their scales, and the exact length of what rounding took away."""
    dim = unit.shape[1]
    turn, _ = np.linalg.qr(np.random.default_rng(dim).standard_normal((dim, dim)))
    turned = unit @ turn
    rest = np.sqrt(np.square(turned[:, head:]).sum(1, keepdims=True))
    short = np.concatenate([turned[:, :head], rest], axis=1)
    scale = np.maximum(np.abs(short).max(1), 1e-30) / 127
    codes = np.rint(short / scale[:, None]).astype(np.int8)
    error = np.sqrt(np.square(short - codes * scale[:, None]).sum(1))
    return codes, scale, error


def _linked(a: tuple, b: tuple, low: int, high: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows ``low:high`` of ``a`` and the rows of ``b`` that reach the threshold."""
    unit, codes, scale, error = (x[low:high] for x in a)
    # Sums of eight-bit products below 2**24 are exact in single precision.
    bound = codes.astype(np.float32) @ b[1].astype(np.float32).T
    bound *= scale.astype(np.float32)[:, None]
    bound *= b[2].astype(np.float32)
    bound += (error * (1 + b[3].max(initial=0)) + 1e-5).astype(np.float32)[:, None]
    bound += b[3].astype(np.float32)
    i, j = np.nonzero(bound >= threshold)
    if len(i) > 0.02 * bound.size:
        exact = unit @ b[0].T
        return np.nonzero(exact >= threshold)
    keep = np.concatenate(
        [np.einsum("ij,ij->i", unit[i[k : k + 65536]], b[0][j[k : k + 65536]]) for k in range(0, len(i), 65536)] or [[]]
    )
    return i[keep >= threshold], j[keep >= threshold]


def spanning_labels(n: int, i: np.ndarray, j: np.ndarray, labels: np.ndarray | None = None) -> np.ndarray:
    """The smallest row number each of ``n`` rows reaches over the links ``i``-``j``."""
    labels = np.arange(n) if labels is None else labels
    while True:
        low = np.minimum(labels[i], labels[j])
        before = labels.copy()
        np.minimum.at(labels, before[i], low)
        np.minimum.at(labels, before[j], low)
        while not np.array_equal(labels, labels[labels]):
            labels = labels[labels]
        if np.array_equal(labels, before):
            return labels


def _compare(threshold: float) -> Callable[[pa.Table], pa.Table]:
    def run(group: pa.Table) -> pa.Table:
        keys, tile = group["_row"].to_numpy(), group["tile"].to_numpy()
        rows = np.stack(group["unit"].to_numpy()) if len(keys) else np.zeros((0, 1))
        order = np.lexsort((keys, tile))
        keys, tile, rows = keys[order], tile[order], rows[order]
        first = int((tile == tile[0]).sum())
        tiles = (rows, *quantise(rows, min(HEAD, rows.shape[1])))
        same = first == len(keys)
        left = tuple(x[:first] for x in tiles)
        right, shift = (left, 0) if same else (tuple(x[first:] for x in tiles), first)
        links, labels = np.zeros(len(keys), np.int64), np.arange(len(keys))
        for low in range(0, first, BLOCK):
            i, j = _linked(left, right, low, low + BLOCK, threshold)
            i, j = i + low, j + shift
            if same:
                i, j = i[i < j], j[i < j]
            links += np.bincount(i, minlength=len(keys)) + np.bincount(j, minlength=len(keys))
            labels = spanning_labels(len(keys), i, j, labels)
        at = links > 0
        return pa.table({"u": keys[at], "v": keys[labels[at]], "links": links[at]})

    return run


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vectors`` (``vec_id``, ``embedding``).

    Rows whose cosine is at least ``threshold`` are linked, whatever their other
    columns.  Vectors that are null, of length 0, or hold a null or non-finite
    component link with nothing; vectors of different lengths are not compared.
    Repeated rows are vectors of their own that link with each other; their
    component is named by the smallest id in it.  A null id never names a
    component that holds another id.  An empty table gives no rows.
    """
    unit = F.transform("embedding", lambda x: x.cast("double"))
    size = F.sqrt(F.aggregate("unit", F.lit(0.0), lambda s, x: s + x * x))
    rows = vectors.select("vec_id", unit.alias("unit")).withColumn("norm", size)
    sound = F.coalesce((F.col("norm") > 0) & (F.col("norm") < float("inf")), F.lit(False))
    rows = rows.select("vec_id", F.when(sound, F.transform("unit", lambda x: x / F.col("norm"))).alias("unit"))
    rows = materialise(rows.withColumn("_row", F.monotonically_increasing_id()))

    valid = rows.where("unit is not null").select("_row", "unit", F.size("unit").alias("dim"))
    tiles = max(1, -(-valid.count() // tile))
    placed = valid.withColumn("tile", F.pmod(F.xxhash64("_row"), F.lit(tiles)).cast("int"))
    met = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))))
    met = met.select("_row", "unit", "tile", "dim", F.least("tile", "other").alias("a"), F.greatest("tile", "other").alias("b"))
    found = met.groupBy("dim", "a", "b").applyInArrow(_compare(threshold), "u long, v long, links long")
    found = materialise(found)

    links = found.groupBy(F.col("u").alias("_row")).agg(F.sum("links").alias("n_links"))
    groups = components(found).withColumnRenamed("id", "_row").join(rows.select("_row", "vec_id"), "_row")
    names = groups.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    named = groups.join(names, "component").select("_row", "component_id").join(links, "_row", "left")
    out = rows.select("_row", "vec_id").join(named, "_row", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )
