"""Import progress: speed, weighted average speed, time left and totals.

An import log has ``data_type, ts, processed, imported, errors, estimated_total,
status`` with one row per update; the first row of a type is its start.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketlake.functions.text import micros
from docketlake.operators.ranges import CARRIED, RANGE, ROWS_PER_RANGE, Ranges, into_ranges, with_carried
from docketlake.session import stored

SAMPLES = 20  # fixed value: how many speeds enter the average


def _instant(log: DataFrame, rows_per_range: int, tie: list[str]) -> Ranges:
    """Speed since the previous update of the type; NULL where no time passed."""
    timed = log.withColumn("_us", micros(F.col("ts")))
    ranges = into_ranges(timed, ["data_type"], ["_us", *tie], rows_per_range)
    seconds = (F.col("_us") - F.lag("_us").over(ranges.window)) / 1e6
    done = F.col("processed") - F.lag("processed").over(ranges.window)
    speeds = with_carried(ranges, 1).withColumn("speed", F.when(seconds > 0, done / seconds))
    return ranges.holding(stored(speeds.where(~F.col(CARRIED)).drop(CARRIED), "speeds"))


def instant_speed(log: DataFrame, tie: list[str] | None = None, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Adds ``speed`` in records per second; ``tie`` orders updates of equal time."""
    return _instant(log, rows_per_range, tie or ["processed"]).rows.drop("_us", RANGE)


def average_speed(log: DataFrame, tie: list[str] | None = None, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Adds ``avg_speed``, the last 20 speeds weighted 1..n, newest most; 0 without any."""
    speeds = _instant(log, rows_per_range, tie or ["processed"])
    # A whole window of samples: an update without a speed of its own has none of them in its range.
    rows = with_carried(speeds, SAMPLES, F.col("speed").isNotNull())
    running = speeds.window.rowsBetween(Window.unboundedPreceding, 0)
    # Updates without a speed share the number of the sample before them.
    rows = rows.withColumn("_sample", F.count("speed").over(running))
    last = Window.partitionBy(RANGE, *speeds.key).orderBy("_sample").rangeBetween(1 - SAMPLES, 0)
    rows = rows.withColumn("_speeds", F.collect_list("speed").over(last))
    n = F.size("_speeds")
    weighted = F.aggregate(
        F.transform("_speeds", lambda v, i: v * (i + 1)), F.lit(0.0), lambda total, v: total + v
    )
    average = F.when(n > 0, weighted / (n * (n + 1) / 2)).otherwise(F.lit(0.0))
    return rows.where(~F.col(CARRIED)).withColumn("avg_speed", average).drop("_us", "_sample", "_speeds", RANGE, CARRIED)


def eta_seconds(estimate: Column, processed: Column, speed: Column) -> Column:
    """Whole seconds left: NULL without speed or estimate, 0 when done."""
    known = (speed > 0) & (F.coalesce(estimate, F.lit(0)) != 0)
    left = estimate - processed
    return F.when(known, F.when(left <= 0, F.lit(0)).otherwise(F.floor(left / speed))).cast("bigint")


def with_eta(log: DataFrame) -> DataFrame:
    return log.withColumn(
        "eta_seconds", eta_seconds(F.col("estimated_total"), F.col("processed"), F.col("avg_speed"))
    )


def latest_state(log: DataFrame, tie: list[str] | None = None) -> DataFrame:
    """The last update of each type, combined per task before the shuffle."""
    order = F.struct("ts", *(tie or ["processed"]))
    return log.groupBy("data_type").agg(F.max_by(F.struct("*"), order).alias("s")).select("s.*")


def overall_progress(log: DataFrame, tie: list[str] | None = None, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """One row over all types: totals, percent of the estimates, speed and time left."""
    state = latest_state(average_speed(log, tie, rows_per_range), tie).transform(with_eta)
    active = F.col("status") == "processing"
    estimated = F.coalesce(F.sum("estimated_total"), F.lit(0))
    return state.agg(
        F.sum("processed").alias("total_processed"),
        F.sum("imported").alias("total_imported"),
        F.sum("errors").alias("total_errors"),
        F.when(estimated > 0, F.sum("processed") * 100.0 / estimated).otherwise(F.lit(0.0)).alias("overall_percent"),
        F.sum("avg_speed").alias("overall_speed"),
        F.coalesce(F.sum(F.when(active, F.col("eta_seconds"))), F.lit(0)).alias("overall_eta_seconds"),
    )
