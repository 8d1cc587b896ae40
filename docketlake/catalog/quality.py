"""Validation, statistics of parsing, and error reports."""

from pyspark.sql import functions as F

from docketlake.catalog.records import RECORDS, lines, records
from docketlake.catalog.registry import MANIFEST, RECORD_LOG, flag, manifest, query, record_log, table, text
from docketlake.operators import quality as Q
from docketlake.operators.court_records import column_errors, record_errors, to_records, validate_and_enrich
from docketlake.operators.entities import project
from docketlake.schemas import PRECEDENTIAL_STATUS


def raw_dockets(spark, folder):
    """Orders as raw dockets: no name when open, no id for key 0, bad ids when pending."""
    status = F.col("o_orderstatus")
    return table(spark, folder, "orders").select(
        F.when(status == "P", F.concat(F.lit("n"), text("o_orderkey"))).otherwise(text("o_orderkey")).alias("id"),
        text("o_custkey").alias("court_id"),
        F.when(status == "O", "").otherwise(F.col("o_orderpriority")).alias("case_name"),
        F.lit("7").alias("docket_number"),
        F.col("o_orderstatus").alias("date_filed"),
        F.col("o_orderkey").alias("_row"),
    )


STRICT_ERRORS = """strict AS (SELECT o_orderkey AS row_no,
    CASE WHEN o_orderstatus = 'P' THEN 'Error parsing required field id: Unable to parse integer: n' || CAST(o_orderkey AS VARCHAR)
         WHEN o_orderkey = 0 THEN 'Docket ID is required'
         WHEN o_orderstatus = 'O' THEN 'Case name is required' END AS error FROM orders)"""
LENIENT_ERRORS = """lenient AS (SELECT o_orderkey AS row_no,
    CASE WHEN o_orderstatus = 'P' OR o_orderkey = 0 THEN 'Docket ID is required'
         WHEN o_orderstatus = 'O' THEN 'Case name is required' END AS error FROM orders)"""


@query("g1_required_fields", f"WITH {LENIENT_ERRORS} SELECT row_no, error FROM lenient")
def required_fields(spark, folder):
    rows = project(raw_dockets(spark, folder), "dockets")
    return rows.select(F.col("_row").alias("row_no"), F.get("errors", F.lit(0)).alias("error"))


@query(
    "g2_conversion_failure",
    f"WITH {STRICT_ERRORS} SELECT row_no, error, CAST(NULL AS VARCHAR) AS date_filed FROM strict",
)
def conversion_failure(spark, folder):
    rows = project(raw_dockets(spark, folder), "dockets", "postgres")
    return rows.select(
        F.col("_row").alias("row_no"), F.get("errors", F.lit(0)).alias("error"), text("date_filed").alias("date_filed")
    )


@query(
    "g3_header_check",
    """SELECT source, CAST(source = 'src0' AS INTEGER) AS valid, CASE source WHEN 'src0' THEN '' ELSE 'notes' END AS missing,
         CASE source WHEN 'src0' THEN '' ELSE source END AS extra FROM documents""",
)
def header_check(spark, folder):
    names = "id full_name short_name jurisdiction position citation_string start_date end_date".split()
    expected = F.array(*[F.lit(n) for n in [*names, "notes"]])
    last = F.when(F.col("source") == "src0", "notes").otherwise(F.col("source"))
    headers = F.array(*[F.lit(n) for n in names], last)
    rows = table(spark, folder, "documents").select("source", expected.alias("expected"), headers.alias("headers"))
    return Q.compare_headers(rows).select(
        "source",
        flag(F.col("valid")).alias("valid"),
        F.array_join("missing_fields", "|").alias("missing"),
        F.array_join("extra_fields", "|").alias("extra"),
    )


@query(
    "g4_record_validation",
    f"""WITH {RECORDS} SELECT record_id, concat_ws('|', CASE WHEN jurisdiction = '' THEN 'Court jurisdiction cannot be empty' END,
          CASE WHEN case_number = '' THEN 'Case number cannot be empty' END) AS errors FROM records""",
)
def record_validation(spark, folder):
    return records(spark, folder).select("record_id", F.array_join(record_errors(), "|").alias("errors"))


@query(
    "g5_column_checks",
    """SELECT doc_id, concat_ws('|', CASE WHEN lang = 'de' THEN 'Column 0 is None' END,
         CASE WHEN lang = 'fr' THEN 'Column 1 contains null bytes' END,
         CASE WHEN lang = 'fr' AND 1 > length(source || 'x') * 0.1 THEN 'Column 1 contains excessive control characters' END,
         CASE WHEN 1 > (length(text) + 1) * 0.1 THEN 'Column 2 contains excessive control characters' END) AS errors
       FROM documents""",
)
def column_checks(spark, folder):
    columns = F.array(
        F.when(F.col("lang") != "de", F.col("lang")),
        F.concat("source", F.when(F.col("lang") == "fr", F.lit("\x00")).otherwise(F.lit("\r"))),
        F.concat("text", F.lit("\x07")),
    )
    return table(spark, folder, "documents").select("doc_id", F.array_join(column_errors(columns), "|").alias("errors"))


@query(
    "g6_dataset_checks",
    f"""WITH {MANIFEST} SELECT dataset_id, count(*) AS files, CAST(sum(size) AS BIGINT) AS total_size,
          count(*) FILTER (WHERE status = 'error') + count(*) FILTER (WHERE size = 0) AS file_problems, '' AS dataset_errors,
          CASE WHEN bool_or(status = 'error') THEN 'Dataset contains files with errors'
               WHEN NOT bool_and(status = 'downloaded') THEN 'Not all files have been downloaded' END AS reason
        FROM manifest GROUP BY dataset_id""",
)
def dataset_checks(spark, folder):
    return Q.dataset_checks(manifest(spark, folder)).select(
        "dataset_id",
        "files",
        "total_size",
        "file_problems",
        F.array_join("dataset_errors", "|").alias("dataset_errors"),
        F.col("not_ready_reason").alias("reason"),
    )


@query(
    "g6_file_errors",
    f"""WITH {MANIFEST} SELECT path, 'File error: ' || error_message AS error FROM manifest WHERE status = 'error'
        UNION ALL SELECT path, 'Data file is empty' FROM manifest WHERE size = 0""",
)
def file_errors(spark, folder):
    return Q.file_error_rows(manifest(spark, folder)).select("path", "error")


@query(
    "g7_validate_and_enrich",
    f"""WITH {RECORDS} SELECT record_id, CAST(jurisdiction = '' AS INTEGER) + CAST(case_number = '' AS INTEGER) AS n_errors,
          5 AS cleaned_count, 21 AS column_count, md5(search_text) AS text_md5 FROM records""",
)
def validate_enrich(spark, folder):
    # Lines split without cleaning: the pipeline itself has to clean them.
    split = F.explode(F.array(F.split(F.btrim("value", F.lit(" \r")), "\t")))
    raw = lines(spark, folder).select("o_orderkey", split.alias("columns"))
    rows = validate_and_enrich(to_records(raw).withColumn("case_metadata", _clean_parties(spark)))
    real = F.filter("validation_errors", lambda m: m.contains("cannot be empty"))
    return rows.select(
        "record_id",
        F.size(real).alias("n_errors"),
        "cleaned_count",
        "column_count",
        F.md5(F.col("searchable_text").cast("binary")).alias("text_md5"),
    )


def _clean_parties(spark):
    """Case data with parties from the cleaned columns."""
    from docketlake.functions.text import clean_text, parties

    at = lambda i: clean_text(F.get("column_data", F.lit(i)))
    return F.col("case_metadata").withField("parties", parties(at(12), at(13)))


@query(
    "g8_parse_stats",
    f"""WITH {LENIENT_ERRORS} SELECT count(*) AS total_rows, count(*) FILTER (WHERE error IS NULL) AS parsed_rows,
          count(*) FILTER (WHERE error IS NOT NULL) AS error_rows, 0 AS skipped_rows,
          round(count(*) FILTER (WHERE error IS NULL) * 100.0 / count(*), 6) AS success_rate FROM lenient""",
)
def parse_stats(spark, folder):
    stats = Q.parse_stats(project(raw_dockets(spark, folder), "dockets"))
    return stats.withColumn("success_rate", F.round("success_rate", 6))


@query(
    "g9_stop_on_errors",
    f"""WITH {LENIENT_ERRORS} SELECT 'stopped' AS outcome, 10 AS max_errors, CAST(NULL AS BIGINT) AS n
        UNION ALL SELECT 'passed', 1000000000, count(*) FROM lenient""",
)
def stop_on_errors(spark, folder):
    rows = project(raw_dockets(spark, folder), "dockets")

    def outcome(max_errors):
        named = lambda o, n: [F.lit(o).alias("outcome"), F.lit(max_errors).cast("bigint").alias("max_errors"), n.alias("n")]
        try:
            return Q.stop_on_errors(rows, max_errors).agg(*named("passed", F.count("*")))
        except Q.TooManyErrors:
            return spark.range(1).select(*named("stopped", F.lit(None).cast("bigint")))

    return outcome(10).unionByName(outcome(10**9))


@query(
    "g10_error_summary",
    f"WITH {STRICT_ERRORS} SELECT error, count(*) AS occurrences FROM strict WHERE error IS NOT NULL GROUP BY error",
)
def error_summary(spark, folder):
    return Q.error_summary(project(raw_dockets(spark, folder), "dockets", "postgres"))


@query(
    "g11_error_categories",
    f"""WITH {RECORD_LOG}, kinds AS (SELECT CASE WHEN contains(error, 'ID is required') THEN 'missing_id'
            WHEN contains(error, 'name is required') THEN 'missing_name' ELSE 'other' END AS category, count(*) AS occurrences
          FROM record_log WHERE error IS NOT NULL GROUP BY 1), n AS (SELECT count(*) AS total FROM record_log)
        SELECT category, occurrences, total, round(occurrences * 100.0 / total, 6) AS percent,
          round(least(occurrences * 100.0 / total, 20), 6) AS bar_percent FROM kinds, n""",
)
def error_categories(spark, folder):
    rows = Q.error_categories(record_log(spark, folder))
    return rows.withColumns({c: F.round(c, 6) for c in ("percent", "bar_percent")})


SAMPLES = f"""WITH {RECORD_LOG}, ranked AS (SELECT event_type, event_id, error,
    row_number() OVER (PARTITION BY event_type ORDER BY event_id %s) AS sample_no FROM record_log WHERE error IS NOT NULL)
  SELECT event_type, event_id, error, sample_no FROM ranked WHERE sample_no <= %s"""


@query("g12_first_errors", SAMPLES % ("ASC", 5))
def first_errors(spark, folder):
    log = record_log(spark, folder).where("error is not null").select("event_type", "event_id", "error")
    return Q.error_samples(log, "event_type", "event_id", 5)


@query("g12_last_errors", SAMPLES % ("DESC", 100))
def last_errors(spark, folder):
    log = record_log(spark, folder).where("error is not null").select("event_type", "event_id", "error")
    return Q.error_samples(log, "event_type", "event_id", 100, last=True)


@query(
    "g13_unknown_codes",
    "SELECT o_orderkey, 'Unknown enum value: ' || o_orderpriority AS error FROM orders WHERE o_orderstatus <> 'F'",
)
def unknown_codes(spark, folder):
    rows = table(spark, folder, "orders").withColumn(
        "status", F.when(F.col("o_orderstatus") == "F", "Published").otherwise(F.col("o_orderpriority"))
    )
    return Q.reject_unknown_codes(rows, "status", list(PRECEDENTIAL_STATUS.values())).select("o_orderkey", "error")
