"""Sources: dumps, lines and JSON files rendered from the driver tables and read back."""

from pyspark.sql import functions as F

from docketlake.catalog.records import LINES, lines
from docketlake.catalog.registry import COURTS, courts, day, md5, query, table, text
from docketlake.operators.entities import good, project
from docketlake.operators.quality import check_headers
from docketlake.operators.tables import read_table, write_json, write_table
from docketlake.schemas import entity
from docketlake.session import scratch_path
from docketlake.sources import file_manifest, read_bulk, read_court_lines, read_json_records
from docketlake.sources.bulk import CORRUPT, drop_blank_keys


def write_dump(df, path, compression="none", quote="`"):
    """Write a dump in the published form: all values quoted, backslash escapes, a header per file."""
    df.write.options(
        header=True,
        quote=quote,
        escape="\\",
        quoteAll=True,
        emptyValue="",
        nullValue="\\N",
        ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False,
        compression=compression,
    ).csv(path)


def opinion_dump(spark, folder):
    """Documents as raw opinion rows with multi-line texts."""
    return table(spark, folder, "documents").select(
        text("doc_id").alias("id"),
        F.lit("2020-03-02 21:38:43.821906+00").alias("date_created"),
        F.lit("020lead").alias("type"),
        F.col("source").alias("sha1"),
        "lang",
        F.col("text").alias("plain_text"),
        (F.col("doc_id") + 1).cast("string").alias("cluster_id"),
    )


OPINION_CHECK = "SELECT doc_id AS id, md5(text) AS text_md5, source AS sha1, doc_id + 1 AS cluster_id FROM documents WHERE doc_id <> 0"


def _read_opinions(spark, folder, compression, method, **kwargs):
    path = scratch_path(spark, f"opinions-{method}")
    write_dump(opinion_dump(spark, folder), path, compression)
    rows = good(project(read_bulk(spark, path, "opinions", method=method, **kwargs), "opinions"))
    return rows.select("id", md5("plain_text").alias("text_md5"), "sha1", "cluster_id")


@query(
    "a1_read_bulk",
    """SELECT o_orderkey + 1 AS id, o_custkey + 1 AS docket_id, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS date_filed,
         o_orderpriority AS case_name FROM orders""",
)
def read_typed_bulk(spark, folder):
    raw = table(spark, folder, "orders").select(
        (F.col("o_orderkey") + 1).cast("string").alias("id"),
        (F.col("o_custkey") + 1).cast("string").alias("docket_id"),
        day("o_orderdate").alias("date_filed"),
        F.col("o_orderpriority").alias("case_name"),
    )
    path = scratch_path(spark, "clusters")
    write_dump(raw, path, quote='"')
    rows = good(project(read_bulk(spark, path, "opinion_clusters", "postgres", "multiline"), "opinion_clusters", "postgres"))
    return rows.select("id", "docket_id", day("date_filed").alias("date_filed"), "case_name")


@query("a2_read_bzip2", OPINION_CHECK)
def read_bzip2(spark, folder):
    return _read_opinions(spark, folder, "bzip2", "parity")


@query("a2_read_gzip", OPINION_CHECK)
def read_gzip(spark, folder):
    return _read_opinions(spark, folder, "gzip", "auto", partitions=16)


@query("a3_multiline_records", OPINION_CHECK)
def multiline_records(spark, folder):
    return _read_opinions(spark, folder, "none", "parity")


@query("a3_separator_records", OPINION_CHECK)
def separator_records(spark, folder):
    return _read_opinions(spark, folder, "none", "separator")


def _parts(spark, folder):
    """Dumps of orders whose files differ in their columns: all, in another order, fewer, and none that identifies a row."""
    raw = table(spark, folder, "orders").select(
        "o_orderstatus",
        (F.col("o_orderkey") + 1).cast("string").alias("id"),
        (F.col("o_custkey") + 1).cast("string").alias("docket_id"),
        day("o_orderdate").alias("date_filed"),
        F.concat(F.lit("In re\n"), "o_orderpriority").alias("case_name"),
    )
    path = scratch_path(spark, "headers")
    names = {"O": ["id", "docket_id", "date_filed", "case_name"], "F": ["case_name", "date_filed", "id", "docket_id"]}
    write_dump(raw.where("o_orderstatus = 'O'").select(names["O"]), f"{path}/whole")
    write_dump(raw.where("o_orderstatus = 'F'").select(names["F"]), f"{path}/turned", "bzip2")
    write_dump(raw.where("o_orderstatus = 'P' AND docket_id >= '5'").select("docket_id", "id"), f"{path}/fewer")
    write_dump(raw.where("o_orderstatus = 'P' AND docket_id < '5'").select("case_name", "docket_id"), f"{path}/without")
    return f"{path}/*"


HEADERS = """SELECT CASE WHEN lost THEN NULL ELSE o_orderkey + 1 END AS id, CASE WHEN lost THEN NULL ELSE o_custkey + 1 END AS docket_id,
         CASE WHEN o_orderstatus <> 'P' THEN strftime(o_orderdate, '%Y-%m-%d') END AS date_filed,
         CASE WHEN o_orderstatus <> 'P' THEN 'In re' || chr(10) || o_orderpriority WHEN lost THEN NULL ELSE '' END AS case_name,
         CASE WHEN lost THEN 'Malformed record' END AS error
       FROM (SELECT *, o_orderstatus = 'P' AND CAST(o_custkey + 1 AS VARCHAR) < '5' AS lost FROM orders)"""


def _by_header(spark, folder, method):
    rows = read_bulk(spark, _parts(spark, folder), "opinion_clusters", method=method, required=["id", "docket_id"])
    typed = project(rows, "opinion_clusters")
    lost = F.get("errors", F.lit(0))
    read = lambda c: F.when(lost.isNull(), F.col(c))
    return typed.select(
        read("id").alias("id"), read("docket_id").alias("docket_id"), day(read("date_filed")).alias("date_filed"),
        read("case_name").alias("case_name"), lost.alias("error"),
    )


@query("a1_files_by_header", HEADERS)
def files_by_header(spark, folder):
    return _by_header(spark, folder, "parity")


@query("a1_files_by_header_multiline", HEADERS)
def files_by_header_multiline(spark, folder):
    return _by_header(spark, folder, "multiline")


@query(
    "g3_header_check_of_files",
    """SELECT part, CAST(part <> 'without' AS INTEGER) AS keyed, n_missing FROM
         (VALUES ('whole', 0), ('turned', 0), ('fewer', 2), ('without', 2)) AS parts(part, n_missing)
       WHERE EXISTS (SELECT 1 FROM orders)""",
)
def header_check_of_files(spark, folder):
    expected = F.array(*[F.lit(n) for n in ("id", "docket_id", "date_filed", "case_name")])
    checked = check_headers(spark, _parts(spark, folder), "opinion_clusters").where(F.size("headers") > 0)
    part = F.element_at(F.split("file", "/"), -2)
    keyed = F.array_contains("headers", "id").cast("int")
    return checked.select(
        part.alias("part"), keyed.alias("keyed"), F.size(F.array_except(expected, "headers")).cast("bigint").alias("n_missing")
    ).distinct()


FILE_ROWS = 10_000  # documents of a written dump


def _stray_dump(spark, folder, compression):
    """A dump of opinions, each on one line, of which every hundredth has a stray quote in its text; a header leads each file."""
    tick, doc = F.lit("`"), F.col("doc_id")
    words = F.regexp_replace("text", r"[`\\\\\s]+", " ")
    stray = F.when(doc % 100 == 7, F.concat(F.lit("x`y"), words)).otherwise(words)
    line = F.concat(tick, text("doc_id"), F.lit("`,`020lead`,`"), stray, F.lit("`,`"), text("source"), F.lit("`,`1`"))
    docs = table(spark, folder, "documents")
    files = max(1, -(-docs.count() // FILE_ROWS))
    header = spark.range(files).select(
        F.col("id").cast("int").alias("part"), F.lit(0).alias("place"), F.lit(None).cast("bigint").alias("doc_id"),
        F.lit("id,type,plain_text,sha1,cluster_id").alias("value"),
    )
    part = F.pmod(F.xxhash64("doc_id"), F.lit(files)).cast("int")
    rows = header.unionByName(docs.select(part.alias("part"), F.lit(1).alias("place"), "doc_id", line.alias("value")))
    rows = rows.repartitionById(files, "part").sortWithinPartitions("part", "place", "doc_id")
    path = scratch_path(spark, "stray")
    rows.select("part", "value").write.partitionBy("part").option("compression", compression).text(path)
    return f"{path}/*"


STRAY = "SELECT doc_id AS id, source AS sha1 FROM documents WHERE doc_id <> 0 AND doc_id % 100 <> 7"


def _behind_stray_quotes(spark, folder, compression):
    """What is read besides the damaged records."""
    rows = good(project(read_bulk(spark, _stray_dump(spark, folder, compression), "opinions"), "opinions"))
    return rows.where("id % 100 <> 7").select("id", "sha1")


@query("a3_stray_quotes", STRAY)
def stray_quotes(spark, folder):
    return _behind_stray_quotes(spark, folder, "none")


@query("a3_stray_quotes_bzip2", STRAY)
def stray_quotes_bzip2(spark, folder):
    return _behind_stray_quotes(spark, folder, "bzip2")


@query(
    "a4_column_count",
    "SELECT CAST(count(*) FILTER (WHERE n_chars % 2 = 0) AS BIGINT) AS good_rows, count(*) FILTER (WHERE n_chars % 2 = 1) AS bad_rows FROM documents",
)
def column_count(spark, folder):
    # Odd documents lose their last column, separator and all.
    docs = table(spark, folder, "documents")
    tick = F.lit("`")
    escaped = F.regexp_replace(F.regexp_replace("text", r"\\", r"\\\\"), "`", r"\\`")
    row = F.concat(tick, text("doc_id"), F.lit("`,`"), escaped, tick)
    full = F.when(F.col("n_chars") % 2 == 0, F.concat(row, F.lit(",`1`"))).otherwise(row)
    path = scratch_path(spark, "short-rows")
    docs.select(full.alias("value")).write.text(path)
    rows = read_bulk(spark, path, "opinions", columns=["id", "plain_text", "cluster_id"])
    bad = F.col(CORRUPT).isNotNull()
    return rows.agg(F.count_if(~bad).alias("good_rows"), F.count_if(bad).alias("bad_rows"))


@query(
    "a5_skip_blank_ids",
    "SELECT CAST(event_id AS VARCHAR) AS id FROM events WHERE event_type <> 'view' AND event_type <> 'click'",
)
def skip_blank_ids(spark, folder):
    kind = F.col("event_type")
    rows = table(spark, folder, "events").select(
        F.when(kind == "view", "  ").when(kind != "click", text("event_id")).alias("id")
    )
    return drop_blank_keys(rows, entity("dockets"))


@query(
    "a6_read_court_lines",
    f"WITH {LINES} SELECT record_id, 21 AS n, plaintiff, defendant, 'no te' AS notes FROM lines",
)
def read_lines(spark, folder):
    path = scratch_path(spark, "lines")
    lines(spark, folder).select("value").write.option("lineSep", "\n").text(path)
    rows = read_court_lines(spark, path)
    at = lambda i: F.get("columns", F.lit(i))
    return rows.select(
        at(0).alias("record_id"),
        F.size("columns").alias("n"),
        at(12).alias("plaintiff"),
        at(13).alias("defendant"),
        at(17).alias("notes"),
    )


@query("a7_read_stored_table", f"WITH {COURTS} SELECT id, full_name, jurisdiction, position FROM courts")
def read_stored(spark, folder):
    path = scratch_path(spark, "courts")
    write_table(courts(spark, folder), path, cluster_by=["id"])
    return read_table(spark, path).select("id", "full_name", "jurisdiction", "position")


@query(
    "a8_read_json_records",
    "SELECT l_suppkey + 1 AS citing_opinion_id, 10000000 + l_partkey AS cited_opinion_id, l_linenumber AS depth, 0 AS quoted FROM lineitem",
)
def read_json(spark, folder):
    rows = table(spark, folder, "lineitem").select(
        (F.col("l_suppkey") + 1).alias("citing_opinion_id"),
        (F.col("l_partkey") + 10_000_000).alias("cited_opinion_id"),
        F.col("l_linenumber").alias("depth"),
    )
    path = scratch_path(spark, "citations-json")
    write_json(rows, path)
    stored = spark.read.schema(entity("citations").schema()).json(path)
    from docketlake.sources.files import fill_defaults

    return fill_defaults(stored, entity("citations")).select(
        "citing_opinion_id", "cited_opinion_id", "depth", F.col("quoted").cast("int").alias("quoted")
    )


@query("a8_record_per_file", "SELECT n_nationkey + 1 AS id, 0 AS has_photo, n_name AS name_last FROM nation")
def record_per_file(spark, folder):
    path = scratch_path(spark, "people-json")
    people = table(spark, folder, "nation").select(
        (F.col("n_nationkey") + 1).cast("bigint").alias("id"), F.col("n_name").alias("name_last")
    )
    people.withColumn("file", F.col("id")).write.partitionBy("file").option("compression", "gzip").json(path)
    rows = read_json_records(spark, f"{path}/*", "people")
    return rows.select("id", F.col("has_photo").cast("int").alias("has_photo"), "name_last")


@query("a9_file_manifest")
def manifest_of_tables(spark, folder):
    return file_manifest(spark, folder, "tables").select(
        F.element_at(F.split("path", "/"), -1).alias("file"), "size", "status", "data_type"
    )


@query(
    "a9_manifest_of_written_files",
    """SELECT source AS dataset_id, lang, CAST(sum(octet_length(encode(text)) + 1) AS BIGINT) AS size, 'pending' AS status
       FROM documents GROUP BY ALL""",
)
def manifest_of_written_files(spark, folder):
    """Sizes of files written from all texts, a folder for each source and language."""
    path = scratch_path(spark, "files")
    docs = table(spark, folder, "documents").select("source", "lang", "text")
    docs.write.partitionBy("source", "lang").text(path)
    part = lambda name: F.regexp_extract("path", f"/{name}=([^/]*)/", 1)
    files = file_manifest(spark, path, "texts").select(part("source").alias("dataset_id"), part("lang").alias("lang"), "size", "status")
    return files.groupBy("dataset_id", "lang", "status").agg(F.sum("size").alias("size"))
