"""Exact top-k search by inner product, a term at a time over all rows.

Vectors become integers; a coordinate is a term and a candidate's nonzero
integer there a posting.  A task holds one block of queries and one of candidates.
It inverts the candidates into posting lists, and for a few queries at a time
scatters weight times posting into dense arrays with one score per candidate: no
candidate is skipped, also not one that shares no term with a query.  The best of
a block come from a partition of the score array, and the best of all blocks from
a rank that Spark limits before it shuffles.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docketlake.llm.common import materialise

SCALE = 64
BEST = 20
#: Rows of a block; a task holds one of queries and one of candidates, some tens of megabytes.
BLOCK = 16_384
#: Scores a task holds at a time.
SCORES = 1 << 19
MOST = (1 << 63) - 1


def integers(vectors: pa.ChunkedArray, scale: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, term and ``floor(scale * x)`` of all components but zeros; Python integers where 64 bits might not do."""
    flat = vectors.combine_chunks()
    sizes = flat.value_lengths().to_numpy(zero_copy_only=False)
    values = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    terms = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    if np.abs(values).max(initial=0) < 2**53 / scale:
        weights = np.floor(scale * values).astype(np.int64)
    else:
        # From 2**53 on a double is whole, so its product with the scale is taken in integers.
        exact = [int(x) * scale if abs(x) >= 2**53 else int(np.floor(scale * x)) for x in values.tolist()]
        weights = np.array(exact, object)
    at = np.flatnonzero(weights != 0)
    return rows[at], terms[at], weights[at]


def score_type(query: np.ndarray, posting: np.ndarray, terms: int) -> type:
    """The smallest type in which every sum of products is exact."""
    most = int(np.abs(query).max(initial=0)) * int(np.abs(posting).max(initial=0)) * max(terms, 1)
    return np.float32 if most < 2**24 else np.float64 if most < 2**53 else np.int64 if most < 2**63 else object


class Postings:
    """Candidates by term: rows and weights, and for a list of more than half of all rows a weight for each row."""

    def __init__(self, rows: np.ndarray, terms: np.ndarray, weights: np.ndarray, size: int) -> None:
        order = np.argsort(terms, kind="stable")
        rows, terms, weights = rows[order], terms[order], weights[order]
        names, first = np.unique(terms, return_index=True)
        self.size, self.lists = size, {}
        for term, low, high in zip(names.tolist(), first, [*first[1:], len(terms)], strict=True):
            at, values = rows[low:high], weights[low:high]
            if 2 * len(at) > size:
                full = np.zeros(size, weights.dtype)
                full[at] = values
                at, values = None, full
            self.lists[term] = (at, values)

    def scores(self, terms: np.ndarray, weights: np.ndarray, kind: type) -> np.ndarray:
        """A score per candidate (rows) and query (columns); ``weights`` has a row per term."""
        scores = np.zeros((self.size, weights.shape[1]), kind)
        room = np.empty_like(scores)
        for term, weight in zip(terms.tolist(), weights.astype(kind), strict=True):
            if term not in self.lists:
                continue
            at, values = self.lists[term]
            values = values.astype(kind)
            if at is None:
                np.multiply.outer(values, weight, out=room)
                scores += room
            else:
                scores[at] += np.multiply.outer(values, weight)
        return scores


def highest(scores: np.ndarray, best: int, own: int | None) -> np.ndarray:
    """Places of the highest scores but the ``own`` one, equal ones in their order."""
    kept = np.arange(len(scores)) if own is None else np.delete(np.arange(len(scores)), own)
    values = scores[kept]
    if len(kept) > best:
        least = np.partition(values, len(values) - best)[len(values) - best]
        at = np.flatnonzero(values >= least)
        kept, values = kept[at], values[at]
    order = sorted(range(len(kept)), key=values.tolist().__getitem__, reverse=True)
    return kept[order[:best]]


_FOUND = pa.schema([("query", pa.int64()), ("row", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def _search(best: int, scale: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        if not queries.num_rows or not candidates.num_rows:
            return _FOUND.empty_table()
        candidates = candidates.sort_by([("vec_id", "ascending"), ("_row", "ascending")])
        asked, rows = queries["_row"].to_numpy(), candidates["_row"].to_numpy()
        place = {r: i for i, r in enumerate(rows.tolist())}
        q_rows, q_terms, q_weights = integers(queries["embedding"], scale)
        c_rows, c_terms, c_weights = integers(candidates["embedding"], scale)
        names, term = np.unique(q_terms, return_inverse=True)
        kind = score_type(q_weights, c_weights, len(names))
        index = Postings(c_rows, c_terms, c_weights, len(rows))
        step = max(1, SCORES // len(rows))
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        starts = np.searchsorted(q_rows, np.arange(len(asked) + 1))
        for low in range(0, len(asked), step):
            high = min(low + step, len(asked))
            part = slice(starts[low], starts[high])
            used, inverse = np.unique(term[part], return_inverse=True)
            weights = np.zeros((len(used), high - low), q_weights.dtype)
            weights[inverse, q_rows[part] - low] = q_weights[part]
            scores = index.scores(names[used], weights, kind).T
            scores = np.clip(scores, -MOST - 1, MOST).astype(np.int64) if kind is object else scores.copy()
            for k in range(low, high):
                at = highest(scores[k - low], best, place.get(int(asked[k])))
                found.append((np.full(len(at), asked[k]), at, scores[k - low][at].astype(np.int64)))
        at = np.concatenate([x[1] for x in found])
        columns = [
            pa.array(np.concatenate([x[0] for x in found])),
            pa.array(rows[at]),
            candidates["vec_id"].take(pa.array(at)).combine_chunks(),
            pa.array(np.concatenate([x[2] for x in found])),
        ]
        return pa.Table.from_arrays(columns, schema=_FOUND)

    return run


def top_k(vectors: DataFrame, queries, best: int = BEST, scale: int = SCALE, block: int = BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row of ``vectors`` where ``queries`` holds, its best other rows.

    ``vectors`` has ``vec_id`` and ``embedding``; other columns are ignored.  Every
    component x counts as ``floor(scale * x)``, and scores are exact inner products
    of those integers, equal ones ranked by the smaller ``vec_id`` (null last).
    Vectors that are null or hold a null or non-finite component take no part.
    Where one vector is shorter than another, it has no term there; an empty one
    scores 0 with all.  Repeated rows are rows of their own: each asks, and finds
    the others.  A score beyond the range of a long counts as its nearest end.  An
    empty table gives no rows.
    """
    numbers = F.transform("embedding", lambda x: x.cast("double"))
    finite = F.coalesce(F.forall("embedding", lambda x: F.abs(x) < float("inf")), F.lit(False))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), numbers.alias("embedding"))
    rows = materialise(rows.where(finite).withColumn("_row", F.monotonically_increasing_id()))
    asked = rows.where(queries)

    def dealt(df: DataFrame, salt: int) -> tuple[DataFrame, int]:
        count = max(1, -(-df.count() // block))
        return df.withColumn("own", F.pmod(F.xxhash64("_row", F.lit(salt)), F.lit(count)).cast("int")), count

    left, left_blocks = dealt(asked, 1)
    right, right_blocks = dealt(rows, 2)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = left.withColumnRenamed("own", "a").withColumn("b", every(right_blocks))
    right = right.withColumnRenamed("own", "b").withColumn("a", every(left_blocks))
    met = left.groupBy("a", "b").cogroup(right.groupBy("a", "b"))
    schema = "query long, row long, vec_id long, score long"
    found = met.applyInArrow(_search(best, scale), schema)

    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
    names = asked.select(F.col("_row").alias("query"), F.col("vec_id").alias("query_id"))
    return found.join(names, "query").select("query_id", "rank", "vec_id", "score")
