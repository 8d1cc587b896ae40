"""Trailing windows over keys of any size, with edges carried from range to range.

A window partitioned by a key puts all rows of the key into one task.  Here rows are
dealt out by ranges of (key, order) instead, whatever the key: many small keys share a
range, a large key (or the rows without one) spans several.  A window inside a range
lacks only the rows just before it, so the last n rows of each range are handed to the
next one.  Where a range holds fewer than n, the one before it helps out.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from docketlake.session import stored

ROWS_PER_RANGE = 2_000_000
#: Smaller ranges share a task, so that neither tasks nor files grow with their number.
ROWS_PER_TASK = 200_000
RANGE, CARRIED = "_range", "_carried"


@dataclass(frozen=True)
class Ranges:
    """Rows with the number of their range, which grows with ``(key, order)``; the upper half tells the task that dealt it."""

    rows: DataFrame
    key: list[str]
    order: list[str]

    @property
    def window(self) -> WindowSpec:
        """The rows of a key in a range, in order."""
        return Window.partitionBy(RANGE, *self.key).orderBy(*self.order)

    def holding(self, rows: DataFrame) -> Ranges:
        """The same ranges with other columns."""
        return replace(self, rows=rows)


def into_ranges(df: DataFrame, key: list[str], order: list[str], rows_per_range: int = ROWS_PER_RANGE) -> Ranges:
    """Deal the rows out; they are written once, since a second sampling may find other bounds.

    Rows that are equal in ``key`` and ``order`` share a range.
    """
    by = [F.col(c).asc_nulls_first() for c in [*key, *order]]
    parts = max(1, -(-df.count() // max(rows_per_range, ROWS_PER_TASK)))
    task = F.shiftleft(F.spark_partition_id().cast("bigint"), 32)
    dealt = df.repartitionByRange(parts, *by).withColumn(RANGE, task)
    if rows_per_range < ROWS_PER_TASK:
        place = F.rank().over(Window.partitionBy(RANGE).orderBy(*by)) - 1
        dealt = dealt.withColumn(RANGE, F.col(RANGE) + F.floor(place / rows_per_range))
    return Ranges(stored(dealt, "ranges"), key, order)


def with_carried(ranges: Ranges, n: int, counts: Column | None = None) -> DataFrame:
    """The rows and, marked ``_carried``, the last ``n`` rows before each range; with ``counts`` only such rows.

    All rows that count are numbered through: by their place in the range, the ranges
    before it in the task, and the tasks before that.  One number per task
    reaches the driver, and ``n`` rows per range are copied by a join on the number.
    """
    rows = ranges.rows
    spark = rows.sparkSession
    counted = F.count(F.lit(1)) if counts is None else F.count_if(counts)
    sizes = stored(rows.groupBy(RANGE).agg(counted.alias("_n")).withColumn("_task", F.shiftright(RANGE, 32)), "sizes")
    before, total = [], 0
    for r in sizes.groupBy("_task").agg(F.sum("_n").alias("n")).orderBy("_task").collect():
        before.append((r["_task"], total))
        total += r["n"]
    tasks = spark.createDataFrame(before, "_task bigint, _before bigint")
    earlier = Window.partitionBy("_task").orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    here = F.coalesce(F.sum("_n").over(earlier), F.lit(0))
    sizes = sizes.withColumn("_here", here).join(tasks, "_task")
    sizes = sizes.select(RANGE, "_n", (F.col("_before") + F.col("_here")).alias("_before"))

    down = [F.col(c).desc_nulls_last() for c in [*ranges.key, *ranges.order]]
    rank = F.row_number().over(Window.partitionBy(RANGE).orderBy(*down))
    candidates = rows if counts is None else rows.where(counts)
    tails = candidates.withColumn("_rank", rank).where(F.col("_rank") <= n)
    tails = tails.join(sizes, RANGE).withColumn("_at", F.col("_before") + F.col("_n") - F.col("_rank") + 1)
    numbers = F.sequence(F.greatest(F.col("_before") - (n - 1), F.lit(1)), F.col("_before"))
    wanted = sizes.where("_before > 0").select(F.col(RANGE).alias("_target"), F.explode(numbers).alias("_at"))
    carried = tails.join(wanted, "_at").withColumn(RANGE, F.col("_target"))
    marked = carried.select(*rows.columns, F.lit(True).alias(CARRIED))
    return rows.withColumn(CARRIED, F.lit(False)).unionByName(marked)
