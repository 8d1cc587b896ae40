"""Incremental ingest with Structured Streaming.

The checkpoint remembers which files were read, so a restart goes on where the
last run stopped and reads no file twice.  Every output of a micro-batch is
keyed by its number: a batch that is repeated after a failure replaces its own
earlier output.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from docketlake.operators.entities import fixed_columns, good, project, rejected
from docketlake.operators.tables import latest_rows, merge, read_table, upsert
from docketlake.schemas import entity
from docketlake.sources.bulk import DIALECTS, Dialect, drop_blank_keys, parse_records
from docketlake.sources.records import cut_records, lines_of

STATE_SCHEMA = "data_type string, batch_id bigint, processed bigint, imported bigint, errors bigint, last_id string"


def stream_bulk(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    """Lines of the dumps that arrive in a folder, with their places; large plain and .bz2 files are split.

    Records are put together per micro-batch, by ``batch_records``.
    """
    reader = spark.readStream.option("lineSep", "\n")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return lines_of(reader.text(folder))


def batch_records(
    batch: DataFrame,
    data_type: str,
    dialect: str | Dialect = "backtick",
    columns: list[str] | None = None,
    required: list[str] | None = None,
) -> DataFrame:
    """Raw rows of one micro-batch of ``stream_bulk``, with ``_file`` and ``_record``, their place.

    A micro-batch holds whole files, so what ``read_bulk`` says about headers, splits and
    stray quotes holds here as well.
    """
    d = DIALECTS[dialect] if isinstance(dialect, str) else dialect
    return parse_records(cut_records(batch, d.quote), d, entity(data_type), columns, required)


@dataclass(frozen=True)
class IngestPaths:
    """Where an ingest keeps its table, changes, rejects, state and stream checkpoint."""

    root: str

    def table(self, data_type: str) -> str:
        return f"{self.root}/tables/{data_type}"

    def changes(self, data_type: str) -> str:
        return f"{self.root}/changes/{data_type}"

    def folded(self, data_type: str) -> str:
        return f"{self.root}/folded/{data_type}"

    def rejects(self, data_type: str) -> str:
        return f"{self.root}/rejects/{data_type}"

    @property
    def state(self) -> str:
        return f"{self.root}/state"

    def checkpoint(self, data_type: str) -> str:
        return f"{self.root}/checkpoints/{data_type}"


def batch_writer(
    paths: IngestPaths,
    data_type: str,
    dialect: str,
    columns: list[str] | None = None,
    required: list[str] | None = None,
) -> Callable[[DataFrame, int], None]:
    """Good rows as changes, rejected ones and the counts beside them.

    Of several rows with a key the last one counts: files follow each other by name,
    rows by their place in the file.
    """
    e = entity(data_type)
    key = list(e.key)

    def write(batch: DataFrame, batch_id: int) -> None:
        raw = batch_records(batch, data_type, dialect, columns, required)
        typed = project(drop_blank_keys(raw, e), data_type, dialect)
        # Columns that the files lack hold one value each; they are neither kept nor shuffled, only written.
        fixed = fixed_columns(e, raw.columns, dialect)
        names = typed.columns
        typed = typed.withColumn("_seq", F.struct("_file", "_record")).drop("_file", "_record", *fixed)
        typed.persist()

        def whole(rows: DataFrame) -> DataFrame:
            return rows.select(*[fixed.get(c, F.col(c)) for c in names if c in fixed or c in rows.columns])

        try:
            fresh = latest_rows(good(typed), key, [F.col("_seq").desc()]).drop("_seq")
            whole(fresh).write.mode("overwrite").parquet(f"{paths.changes(data_type)}/batch_id={batch_id}")
            whole(rejected(typed).drop("_seq")).write.mode("overwrite").parquet(
                f"{paths.rejects(data_type)}/batch_id={batch_id}"
            )
            bad = F.size("errors") > 0
            typed.agg(
                F.lit(data_type).alias("data_type"),
                F.lit(batch_id).cast("bigint").alias("batch_id"),
                F.count(F.lit(1)).alias("processed"),
                F.count_if(~bad).alias("imported"),
                F.count_if(bad).alias("errors"),
                F.max_by(F.concat_ws("_", *key), "_seq").alias("last_id"),
            ).write.mode("overwrite").parquet(f"{paths.state}/data_type={data_type}/batch={batch_id}")
        finally:
            typed.unpersist()

    return write


def ingest(
    spark: SparkSession,
    folder: str,
    data_type: str,
    root: str,
    dialect: str = "backtick",
    files_per_batch: int | None = None,
    columns: list[str] | None = None,
    required: list[str] | None = None,
) -> StreamingQuery:
    """Ingest what is new in a folder, then stop; run it again to resume.

    Files are read by their own headers, ``columns`` names the columns of files without
    one, and files that lack a ``required`` column go to the rejects.
    """
    paths = IngestPaths(root)
    query = (
        stream_bulk(spark, folder, files_per_batch)
        .writeStream.foreachBatch(batch_writer(paths, data_type, dialect, columns, required))
        .option("checkpointLocation", paths.checkpoint(data_type))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def _folded_upto(spark: SparkSession, paths: IngestPaths, data_type: str) -> int:
    """Last batch that the table already holds, -1 before the first compaction."""
    table = read_table(spark, paths.folded(data_type))
    return -1 if table is None else table.head()["upto"]


def _open_changes(spark: SparkSession, paths: IngestPaths, data_type: str) -> DataFrame:
    """Changes that are not in the table yet; folders of other batches are not read."""
    changes = spark.read.parquet(paths.changes(data_type))
    return changes.where(F.col("batch_id") > _folded_upto(spark, paths, data_type))


def ingested(spark: SparkSession, root: str, data_type: str) -> DataFrame:
    """The current records: the table with the newer changes put in their place."""
    paths = IngestPaths(root)
    key, newest = list(entity(data_type).key), [F.col("batch_id").desc()]
    changes = _open_changes(spark, paths, data_type)
    return merge(read_table(spark, paths.table(data_type)), changes, key, newest).drop("batch_id")


def compact(spark: SparkSession, root: str, data_type: str) -> DataFrame:
    """Fold the changes into the table.

    The mark of what is folded is written last.  Should the job die in between,
    the same changes are folded again, which leaves the same newest rows.
    """
    paths = IngestPaths(root)
    changes = _open_changes(spark, paths, data_type)
    last = changes.agg(F.max("batch_id").alias("upto")).head()["upto"]
    if last is None:
        return read_table(spark, paths.table(data_type))
    key, newest = list(entity(data_type).key), [F.col("batch_id").desc()]
    # Batches that arrive meanwhile wait for the next compaction.
    table = upsert(
        paths.table(data_type), changes.where(F.col("batch_id") <= last), key, newest, drop=("batch_id",)
    )
    mark = spark.createDataFrame([(0, int(last))], "id int, upto bigint")
    upsert(paths.folded(data_type), mark, ["id"], [F.col("upto").desc()], buckets=1)
    return table


def ingest_state(spark: SparkSession, root: str) -> DataFrame:
    """All recorded batches of all entities."""
    reader = spark.read.schema(STATE_SCHEMA).option("recursiveFileLookup", "true")
    return reader.parquet(IngestPaths(root).state)


def ingest_positions(state: DataFrame) -> DataFrame:
    """Per entity: last batch, its last id, and running totals."""
    return state.groupBy("data_type").agg(
        F.max("batch_id").alias("last_batch"),
        F.max_by("last_id", "batch_id").alias("last_id"),
        F.sum("processed").alias("processed"),
        F.sum("imported").alias("imported"),
        F.sum("errors").alias("errors"),
    )


COUNTERS = "batch_id bigint, processed bigint, success bigint, failed bigint"


def run_counted(stream: DataFrame, ok: Column, sink: str, counted: str, checkpoint: str) -> StreamingQuery:
    """Write a stream's rows, and beside them a row of counters per micro-batch, until nothing is left to read.

    Counters are taken while the rows are written.  A repeated batch replaces its rows
    and its counters, so that their sum is right however long the stream runs.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        seen = Observation()
        counts = [F.count(F.lit(1)).alias("processed"), F.count_if(ok).alias("success"), F.count_if(~ok).alias("failed")]
        batch.observe(seen, *counts).write.mode("overwrite").parquet(f"{sink}/batch_id={batch_id}")
        row = [(batch_id, seen.get["processed"], seen.get["success"], seen.get["failed"])]
        numbers = batch.sparkSession.createDataFrame(row, COUNTERS).coalesce(1)
        numbers.write.mode("overwrite").parquet(f"{counted}/batch={batch_id}")

    return _run(stream.writeStream.foreachBatch(write), checkpoint)


def counters(spark: SparkSession, counted: str) -> DataFrame:
    """Counters of all micro-batches."""
    return spark.read.schema(COUNTERS).option("recursiveFileLookup", "true").parquet(counted)


def throughput(rows: DataFrame, ts: str, key: str, width: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Records per key and time window; works on batches and on streams."""
    w = F.window(ts, width)
    return (
        rows.withColumn(ts, F.col(ts).cast("timestamp"))  # watermarks need an instant
        .withWatermark(ts, delay)
        .groupBy(w.alias("window"), key)
        .agg(F.count(F.lit(1)).alias("records"))
        .select(F.col("window.start").alias("window_start"), key, "records")
    )


def _run(writer: DataStreamWriter, checkpoint: str) -> StreamingQuery:
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def run_available(stream: DataFrame, sink: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Run a stream over what is there into a Parquet folder, then stop."""
    return _run(stream.writeStream.outputMode(mode).format("parquet").option("path", sink), checkpoint)


def run_keyed(stream: DataFrame, sink: str, checkpoint: str) -> StreamingQuery:
    """Run an aggregation over what is there, into a folder of changes that ``read_keyed`` reads.

    Every micro-batch writes the groups it changed, also those whose window is still
    open, so nothing waits for a watermark to pass.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/batch_id={batch_id}")

    return _run(stream.writeStream.outputMode("update").foreachBatch(write), checkpoint)


def read_keyed(spark: SparkSession, sink: str, key: list[str]) -> DataFrame:
    """The newest state of every group."""
    return latest_rows(spark.read.parquet(sink), key, [F.col("batch_id").desc()]).drop("batch_id")
