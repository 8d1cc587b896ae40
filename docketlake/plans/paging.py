"""Deterministic sorting and paging.

A page without an offset is Spark's own top-k.  Any other page is found by the key of
its first and last row: the rows' keys are counted in ranges, the range that holds a
position is cut into finer ranges, and so on, until the row at the position is among a
few.  Only keys are sorted for that; rows are read between the two keys and nowhere else.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketlake.session import stored

#: Keys among which a position is looked up at last, and ranges of a round.
FEW = 20_000
RANGES = 200


@dataclass(frozen=True)
class SortKey:
    """A column to sort by; NULLs come first in both directions."""

    name: str
    down: bool = False

    @property
    def column(self) -> Column:
        c = F.col(f"`{self.name}`")
        return c.desc_nulls_first() if self.down else c.asc_nulls_first()

    @property
    def reverse(self) -> Column:
        c = F.col(f"`{self.name}`")
        return c.asc_nulls_last() if self.down else c.desc_nulls_last()

    def behind(self, value: Any, data_type: T.DataType) -> Column:
        """Whether a row's value comes behind ``value`` in this direction."""
        c = F.col(f"`{self.name}`")
        if value is None:
            return c.isNotNull()
        return c < literal(value, data_type) if self.down else c > literal(value, data_type)

    def ahead(self, value: Any, data_type: T.DataType) -> Column:
        """Whether it comes before it."""
        c = F.col(f"`{self.name}`")
        if value is None:
            return F.lit(False)
        return c.isNull() | (c > literal(value, data_type) if self.down else c < literal(value, data_type))

    def same(self, value: Any, data_type: T.DataType) -> Column:
        c = F.col(f"`{self.name}`")
        return c.isNull() if value is None else c == literal(value, data_type)


def literal(value: Any, data_type: T.DataType) -> Column:
    """A collected value as a literal of its column's type; instants come as microseconds."""
    return F.timestamp_micros(F.lit(value)) if isinstance(data_type, T.TimestampType) else F.lit(value).cast(data_type)


def sort_columns(sort: list[tuple[str, str]], tie_break: list[str], reverse_all: bool = False) -> list[SortKey]:
    """Sort keys, with the id as last key.

    ``reverse_all`` turns every key around as soon as one is descending.
    """
    any_desc = any(order == "desc" for _, order in sort)
    keys = [SortKey(name, any_desc if reverse_all else order == "desc") for name, order in sort]
    sorted_names = {name for name, _ in sort}
    return keys + [SortKey(c) for c in tie_break if c not in sorted_names]


def page(df: DataFrame, keys: list[SortKey], limit: int | None = None, offset: int = 0) -> DataFrame:
    """Rows ``offset .. offset + limit`` in key order; limit 0 or None means all.

    Rows that are equal in all keys are interchangeable.
    """
    ordered = df.orderBy(*[k.column for k in keys]) if keys else df
    if not offset:
        return ordered.limit(limit) if limit else ordered
    if not keys:
        return ordered.offset(offset).limit(limit) if limit else ordered.offset(offset)
    first = _row_at(df, keys, offset)
    if first is None:
        return ordered.limit(0)
    types = [df.schema[k.name].dataType for k in keys]
    where = lambda row, test: _compared(keys, types, row, test)
    skip = offset - first.before
    rows = df.where(where(first.row, "same") | where(first.row, "behind"))
    if skip:
        # Of rows that are equal in all keys, it does not matter which ones belong to the page before.
        equal = df.where(where(first.row, "same")).offset(skip)
        rows = equal.unionByName(df.where(where(first.row, "behind")))
    last = _row_at(df, keys, offset + limit - 1) if limit else None
    if last is not None:
        taken = limit - max(0, last.before - offset)
        ends = rows.where(where(last.row, "same")).limit(taken)
        rows = rows.where(where(last.row, "ahead")).unionByName(ends)
    return rows.orderBy(*[k.column for k in keys])


def _compared(keys: list[SortKey], types: list[T.DataType], row: Row, test: str) -> Column:
    """Whether a row's keys, compared one after the other, are the same as, behind or ahead of those of ``row``."""
    parts = [(k.same(v, t), getattr(k, test)(v, t)) for k, v, t in zip(keys, row, types, strict=True)]
    if test == "same":
        return reduce(lambda a, b: a & b, [same for same, _ in parts])
    found, equal = parts[0][1], parts[0][0]
    for same, differs in parts[1:]:
        found, equal = found | (equal & differs), equal & same
    return found


@dataclass(frozen=True)
class _Place:
    row: Row
    before: int  # rows that come before all rows with these keys


def _row_at(df: DataFrame, keys: list[SortKey], position: int) -> _Place | None:
    """The keys of the row at a position, None behind the last row."""
    types = {k.name: df.schema[k.name].dataType for k in keys}
    plain = [
        F.unix_micros(f"`{n}`").alias(n) if isinstance(t, T.TimestampType) else F.col(f"`{n}`") for n, t in types.items()
    ]
    rest, before = df.select(*plain), 0
    order = [k.column for k in keys]
    n = rest.count()
    if position >= n:
        return None
    while n > FEW:
        dealt = stored(rest.repartitionByRange(RANGES, *order).withColumn("_range", F.spark_partition_id()), "keys")
        sizes = sorted((r["_range"], r["n"]) for r in dealt.groupBy("_range").agg(F.count("*").alias("n")).collect())
        passed = before
        for number, size in sizes:
            if position < passed + size:
                break
            passed += size
        if size == n:  # one key for all
            break
        rest, before, n = dealt.where(F.col("_range") == number).drop("_range"), passed, size
    if n > FEW:
        # All keys fell into one range, that is, they are equal.
        return _Place(rest.first(), before)
    # At most ``FEW`` keys.
    rows = rest.orderBy(*order).limit(position - before + 1).collect()
    at = len(rows) - 1
    # By their text, in which NaN equals itself.
    while at and repr(rows[at - 1]) == repr(rows[-1]):
        at -= 1
    return _Place(rows[-1], before + at)
