"""What the operators share: scratch tables, stable row keys, bounded semi-joins."""

from __future__ import annotations

import sys
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Cells of the id filter of ``with_ids``; what is broadcast never exceeds this many rows.
ID_CELLS = 1 << 18
#: Rows of an Arrow batch where the session has Spark's default.
BATCH_ROWS = 1_000
#: Rows that a task writes of a table whose number of rows is bounded.
ROWS_A_FILE = 20_000


def scratch_folder(spark: SparkSession) -> str:
    """A fresh path in the folder all executors share, ``spark.checkpoint.dir``.

    Only a local master, whose executors are the driver, may leave it unset; scratch
    tables then lie below the warehouse.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base and not spark.sparkContext.master.startswith(("local[", "local ")) and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    base = base or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    return f"{base.rstrip('/')}/llm-{uuid.uuid4().hex}"


def materialise(df: DataFrame, compression: str | None = None, most_rows: int | None = None) -> DataFrame:
    """Write ``df`` once and read it back: later stages neither repeat its work nor depend on one executor.

    A table of at most ``most_rows`` narrow rows is written by as many tasks as these need, however
    many partitions its last shuffle has.
    """
    if most_rows is not None:
        df = df.coalesce(max(1, -(-most_rows // ROWS_A_FILE)))
    path = scratch_folder(df.sparkSession)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bound_batches(spark: SparkSession) -> None:
    """Smaller Arrow batches than Spark's default, unless the session sets a size: texts may be long."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(BATCH_ROWS))


def once_a_worker(name: str, make: Callable[[], Any]) -> Any:
    """What ``make`` returns, made once for all tasks of a Python worker.

    It is kept at a module every worker has, so that functions using it are sent by
    value: workers need not be able to import this package.
    """
    kept = sys.__dict__.setdefault("_llm_kept", {})
    if name not in kept:
        kept[name] = make()
    return kept[name]


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def id_cell(column: str | Column) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(ID_CELLS)).cast("int")


def id_cells(ids: DataFrame, column: str) -> DataFrame:
    """The cells that hold at least one id: at most ``ID_CELLS`` integers, whatever the input."""
    return ids.select(id_cell(column).alias("_cell")).distinct()


def stored_cells(ids: DataFrame, column: str) -> DataFrame:
    """The cells of ``id_cells``, written once."""
    return materialise(id_cells(ids, column), most_rows=ID_CELLS)


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` has it."""
    while name in df.columns:
        name += "_"
    return name


def _by_cell(df: DataFrame, column: str, cells: DataFrame, how: str) -> DataFrame:
    cell = unused(df, "_cell")
    marked = cells.select(F.col("_cell").alias(cell))
    return df.withColumn(cell, id_cell(column)).join(F.broadcast(marked), cell, how).drop(cell)


def with_ids(df: DataFrame, column: str, cells: DataFrame) -> DataFrame:
    """Rows whose id may be among those behind ``cells``; an exact join has to follow.

    It spares that join the shuffle of rows which cannot match.  The broadcast
    side is bounded by ``ID_CELLS`` rows.
    """
    return _by_cell(df, column, cells, "left_semi")


def without_ids(df: DataFrame, column: str, cells: DataFrame) -> DataFrame:
    """The rest: rows whose id is certainly not among those behind ``cells``."""
    return _by_cell(df, column, cells, "left_anti")
