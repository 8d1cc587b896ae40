"""Audit events derived from what validation, cleaning and queries found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketlake.functions.text import CleaningRule
from docketlake.operators.court_records import matches_record
from docketlake.operators.predicates import RecordQuery

# Names of the event types.
DOWNLOAD_REQUESTED = "DataDownloadRequested"
PARSING_COMPLETED = "DataParsingCompleted"
QUERY_EXECUTED = "QueryExecuted"
VALIDATION_FAILED = "DataValidationFailed"
COLUMNS_CLEANED = "ColumnCleaningApplied"
RECORD_INVALID = "RecordValidationFailed"


def _event(event_type: str, aggregate_id: str, payload: dict[str, Column], at: Column) -> list[Column]:
    items = [x for name, value in payload.items() for x in (F.lit(name), value.cast("string"))]
    return [
        F.lit(event_type).alias("event_type"),
        F.col(aggregate_id).alias("aggregate_id"),
        at.alias("occurred_at"),
        F.create_map(*items).alias("payload"),
    ]


def record_events(records: DataFrame, at: Column, rule: CleaningRule = CleaningRule()) -> DataFrame:
    """Events of validated records: invalid ones, and ones whose columns were cleaned."""
    invalid = records.where(F.size("validation_errors") > 0).select(
        *_event(RECORD_INVALID, "record_id", {"validation_errors": F.to_json("validation_errors")}, at)
    )
    cleaned = records.where("cleaned_count > 0").select(
        *_event(
            COLUMNS_CLEANED,
            "record_id",
            {"column_range": F.lit(rule.label), "cleaned_count": F.lit(rule.size)},
            at,
        )
    )
    return invalid.unionByName(cleaned)


def query_events(records: DataFrame, query: RecordQuery, at: Column) -> DataFrame:
    """One event per record a query was run against."""
    matches = F.initcap(matches_record(query, records.columns).cast("string"))
    payload = {"query_field": F.lit(query.field), "query_value": F.lit(query.value), "matches": matches}
    return records.select(*_event(QUERY_EXECUTED, "record_id", payload, at))


def dataset_events(checks: DataFrame, at: Column) -> DataFrame:
    """Events of checked data sets: not ready, or parsing completed."""
    failed = checks.where("not_ready_reason is not null and not parsing_complete").select(
        *_event(VALIDATION_FAILED, "dataset_id", {"reason": F.col("not_ready_reason")}, at)
    )
    parsed = checks.where("parsing_complete").select(
        *_event(PARSING_COMPLETED, "dataset_id", {"parsed_files": F.col("files")}, at)
    )
    return failed.unionByName(parsed)


def download_events(requests: DataFrame, at: Column) -> DataFrame:
    """Events of requested downloads (``dataset_id, download_url``)."""
    return requests.select(*_event(DOWNLOAD_REQUESTED, "dataset_id", {"download_url": F.col("download_url")}, at))


def append_events(events: DataFrame, path: str, batch_id: int | None = None) -> None:
    """Add events to a log; those of a batch replace what an earlier attempt at the same batch wrote."""
    if batch_id is None:
        events.write.mode("append").partitionBy("event_type").parquet(path)
    else:
        events.write.mode("overwrite").partitionBy("event_type").parquet(f"{path}/batch={batch_id}")


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """All events of a log, of batches or not."""
    log = spark.read.option("recursiveFileLookup", "true").parquet(path)
    kind = F.regexp_extract(F.col("_metadata.file_path"), "/event_type=([^/]*)/", 1)
    return log.withColumn("event_type", kind)
