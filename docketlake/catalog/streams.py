"""Streams over events and over dumps rendered from orders."""

from pyspark.sql import functions as F

from docketlake.catalog.ingest import write_dump
from docketlake.catalog.records import RECORDS, records
from docketlake.catalog.registry import MANIFEST, day, manifest, query, table, text
from docketlake.operators.court_records import validate_and_enrich
from docketlake.operators.entities import good, project, rejected
from docketlake.operators.predicates import RecordQuery
from docketlake.operators.quality import dataset_checks
from docketlake.session import scratch_path
from docketlake.streaming import audit, ingest as S


def event_stream(spark, folder):
    schema = table(spark, folder, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder)


def _clusters(spark, folder, name="case_name"):
    pending = F.col("o_orderstatus") == "P"
    return table(spark, folder, "orders").select(
        F.when(pending, "none").otherwise((F.col("o_orderkey") + 1).cast("string")).alias("id"),
        (F.col("o_custkey") + 1).cast("string").alias("docket_id"),
        day("o_orderdate").alias("date_filed"),
        F.concat(F.lit(f"{name}\n"), "o_orderpriority").alias("case_name"),
    )


def _ingested(spark, folder):
    """Two runs over a folder that got more files in between; returns the root."""
    inbox, root = scratch_path(spark, "inbox"), scratch_path(spark, "lake")
    write_dump(_clusters(spark, folder, "first"), f"{inbox}/a", "bzip2")
    S.ingest(spark, f"{inbox}/*", "opinion_clusters", root)
    S.compact(spark, root, "opinion_clusters")
    write_dump(_clusters(spark, folder, "second").where("docket_id < '5'"), f"{inbox}/b")
    S.ingest(spark, f"{inbox}/*", "opinion_clusters", root)
    return root


@query(
    "l1_resumable_ingest",
    """SELECT o_orderkey + 1 AS id, o_custkey + 1 AS docket_id,
         CASE WHEN CAST(o_custkey + 1 AS VARCHAR) < '5' THEN 'second' ELSE 'first' END || chr(10) || o_orderpriority AS case_name
       FROM orders WHERE o_orderstatus <> 'P'""",
)
def resumable_ingest(spark, folder):
    root = _ingested(spark, folder)
    return S.ingested(spark, root, "opinion_clusters").select("id", "docket_id", "case_name")


@query(
    "l2_ingest_state",
    """WITH runs AS (SELECT o_orderstatus FROM orders UNION ALL SELECT o_orderstatus FROM orders WHERE CAST(o_custkey + 1 AS VARCHAR) < '5')
       SELECT 'opinion_clusters' AS data_type, CAST(1 AS BIGINT) AS last_batch, count(*) AS processed,
         count(*) FILTER (WHERE o_orderstatus <> 'P') AS imported, count(*) FILTER (WHERE o_orderstatus = 'P') AS errors FROM runs""",
)
def ingest_state(spark, folder):
    positions = S.ingest_positions(S.ingest_state(spark, _ingested(spark, folder)))
    return positions.select("data_type", "last_batch", "processed", "imported", "errors")


@query(
    "l3_live_counters",
    """SELECT count(*) AS processed, count(*) FILTER (WHERE event_type <> 'error') AS success, count(*) FILTER (WHERE event_type = 'error') AS failed FROM events""",
)
def live_counters(spark, folder):
    sink, counted = scratch_path(spark, "events"), scratch_path(spark, "counters")
    S.run_counted(event_stream(spark, folder), F.col("event_type") != "error", sink, counted, scratch_path(spark, "checkpoint"))
    return S.counters(spark, counted).agg(*[F.sum(c).alias(c) for c in ("processed", "success", "failed")])


@query(
    "l4_throughput",
    """SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS window_start, event_type, count(*) AS records FROM events GROUP BY ALL""",
)
def throughput(spark, folder):
    rows = S.throughput(table(spark, folder, "events"), "ts", "event_type")
    return rows.select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "event_type", "records")


@query(
    "l4_throughput_stream",
    """SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS window_start, event_type, count(*) AS records FROM events GROUP BY ALL""",
)
def throughput_stream(spark, folder):
    """All windows, closed or not, from the changes that the micro-batches wrote."""
    sink = scratch_path(spark, "throughput")
    S.run_keyed(S.throughput(event_stream(spark, folder), "ts", "event_type"), sink, scratch_path(spark, "checkpoint"))
    return S.read_keyed(spark, sink, ["window_start", "event_type"]).select(
        F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "event_type", "records"
    )


@query(
    "l5_streaming_parse",
    """SELECT CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderkey + 1 END AS id, o_custkey + 1 AS docket_id,
         CASE WHEN o_orderstatus = 'P' THEN 'Opinion Cluster ID is required' END AS error FROM orders""",
)
def streaming_parse(spark, folder):
    inbox, out = scratch_path(spark, "inbox"), scratch_path(spark, "parsed")
    write_dump(_clusters(spark, folder), inbox)

    def split(batch, batch_id):
        typed = project(S.batch_records(batch, "opinion_clusters"), "opinion_clusters")
        good(typed).select("id", "docket_id", F.lit(None).cast("string").alias("error")).write.mode("overwrite").parquet(
            f"{out}/good/batch_id={batch_id}"
        )
        bad = rejected(typed).select("id", "docket_id", F.get("errors", F.lit(0)).alias("error"))
        bad.write.mode("overwrite").parquet(f"{out}/bad/batch_id={batch_id}")

    stream = S.stream_bulk(spark, inbox)
    run = (
        stream.writeStream.foreachBatch(split)
        .option("checkpointLocation", scratch_path(spark, "checkpoint"))
        .trigger(availableNow=True)
        .start()
    )
    run.awaitTermination()
    read = lambda part: spark.read.parquet(f"{out}/{part}").drop("batch_id")
    return read("good").unionByName(read("bad"))


AT = "2024-01-31 00:00:00"


@query(
    "l6_audit_events",
    f"""WITH {RECORDS}, {MANIFEST}, ready AS (SELECT dataset_id, bool_or(status = 'error') AS bad, bool_and(status = 'parsed') AS parsed, bool_and(status = 'downloaded') AS downloaded, count(*) AS n FROM manifest GROUP BY dataset_id)
        SELECT 'RecordValidationFailed' AS event_type, record_id AS aggregate_id,
          '[' || CASE WHEN jurisdiction = '' THEN '"Court jurisdiction cannot be empty"' ELSE '' END ||
                 CASE WHEN jurisdiction = '' AND case_number = '' THEN ',' ELSE '' END ||
                 CASE WHEN case_number = '' THEN '"Case number cannot be empty"' ELSE '' END || ']' AS detail
        FROM records WHERE jurisdiction = '' OR case_number = ''
        UNION ALL SELECT 'QueryExecuted', record_id, CASE WHEN contains(lower(jurisdiction), 'asia') THEN 'True' ELSE 'False' END FROM records
        UNION ALL SELECT 'DataValidationFailed', dataset_id, CASE WHEN bad THEN 'Dataset contains files with errors' ELSE 'Not all files have been downloaded' END
        FROM ready WHERE NOT parsed AND NOT downloaded
        UNION ALL SELECT 'DataParsingCompleted', dataset_id, CAST(n AS VARCHAR) FROM ready WHERE parsed
        UNION ALL SELECT 'DataDownloadRequested', source, 'https://example.org/' || source FROM (SELECT DISTINCT source FROM documents)""",
)
def audit_events(spark, folder):
    at = F.lit(AT).cast("timestamp_ntz")
    rows = records(spark, folder)
    requests = table(spark, folder, "documents").select("source").distinct().select(
        F.col("source").alias("dataset_id"), F.concat(F.lit("https://example.org/"), "source").alias("download_url")
    )
    events = (
        audit.record_events(validate_and_enrich(rows), at)
        .unionByName(audit.query_events(rows, RecordQuery("jurisdiction", "asia"), at))
        .unionByName(audit.dataset_events(dataset_checks(manifest(spark, folder)), at))
        .unionByName(audit.download_events(requests, at))
    )
    path = scratch_path(spark, "audit")
    audit.append_events(events, path)
    names = ["validation_errors", "matches", "reason", "parsed_files", "download_url"]
    detail = F.coalesce(*[F.try_element_at("payload", F.lit(n)) for n in names])
    return spark.read.parquet(path).select(text("event_type").alias("event_type"), "aggregate_id", detail.alias("detail"))


@query(
    "l6_cleaning_events",
    f"""WITH {RECORDS} SELECT 'ColumnCleaningApplied' AS event_type, record_id AS aggregate_id, '12-18' AS column_range, '7' AS cleaned_count FROM records""",
)
def cleaning_events(spark, folder):
    dirty = F.transform("column_data", lambda v, i: F.when(i == 17, F.concat(v, F.lit(" "))).otherwise(v))
    rows = records(spark, folder).withColumn("column_data", dirty).drop("cleaned_data")
    events = audit.record_events(validate_and_enrich(rows), F.lit(AT).cast("timestamp_ntz"))
    return events.where("event_type = 'ColumnCleaningApplied'").select(
        "event_type", "aggregate_id", "payload.column_range", "payload.cleaned_count"
    )
