"""Projections: raw rows to typed entities, and positional columns to records."""

from pyspark.sql import functions as F

from docketlake.catalog.records import RECORDS, lines, records
from docketlake.catalog.registry import day, flag, md5, query, table, text
from docketlake.operators.court_records import enrich_records, mapped_values, to_records
from docketlake.operators.entities import good, project, rejected
from docketlake.schemas import CUSTOM_MAPPING, MINIMAL_MAPPING
from docketlake.sources.lines import split_court_lines


def tick(c):
    return F.concat(F.lit("`"), c, F.lit("`"))


@query(
    "c1_court_rows",
    """SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS full_name, '' AS jurisdiction,
         CASE WHEN c_nationkey % 2 = 0 THEN CAST(c_nationkey AS DOUBLE) ELSE 0 END AS position,
         CAST(NULL AS VARCHAR) AS start_date, '1990-01-02' AS end_date FROM customer""",
)
def court_rows(spark, folder):
    raw = table(spark, folder, "customer").select(
        tick(text("c_custkey")).alias("id"),
        tick(F.col("c_name")).alias("full_name"),
        F.lit(None).cast("string").alias("jurisdiction"),
        F.when(F.col("c_nationkey") % 2 == 0, tick(text("c_nationkey"))).otherwise("`none`").alias("position"),
        F.lit("`1990-02-30`").alias("start_date"),
        F.lit("`1990-1-2`").alias("end_date"),
    )
    return good(project(raw, "courts", "wrapped")).select(
        "id", "full_name", "jurisdiction", "position", day("start_date").alias("start_date"), day("end_date").alias("end_date")
    )


@query(
    "c2_docket_rows",
    """SELECT o_orderkey AS id, CAST(o_custkey AS VARCHAR) AS court_id, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS date_filed,
         CAST(CAST(o_orderdate AS DATE) AS VARCHAR) || ' 06:20:24.011839' AS date_created, CAST(NULL AS VARCHAR) AS date_modified,
         CAST(o_orderstatus = 'F' AS INTEGER) AS approximate, '' AS slug FROM orders WHERE o_orderkey <> 0""",
)
def docket_rows(spark, folder):
    raw = table(spark, folder, "orders").select(
        tick(text("o_orderkey")).alias("id"),
        tick(text("o_custkey")).alias("court_id"),
        tick(F.col("o_orderpriority")).alias("case_name"),
        tick(text("o_orderkey")).alias("docket_number"),
        tick(F.concat(day("o_orderdate"), F.lit(" 06:20:24.011839+00"))).alias("date_created"),
        tick(F.concat(day("o_orderdate"), F.lit(" 06:20:24-05"))).alias("date_modified"),
        tick(day("o_orderdate")).alias("date_filed"),
        F.when(F.col("o_orderstatus") == "F", "`T`").otherwise("`f`").alias("date_filed_is_approximate"),
    )
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return good(project(raw, "dockets", "wrapped")).select(
        "id",
        "court_id",
        day("date_filed").alias("date_filed"),
        stamp("date_created").alias("date_created"),
        stamp("date_modified").alias("date_modified"),
        flag(F.col("date_filed_is_approximate")).alias("approximate"),
        "slug",
    )


@query(
    "c3_cluster_rows",
    """SELECT o_orderkey AS id, o_custkey AS docket_id, CASE o_orderstatus WHEN 'F' THEN 'Published' WHEN 'O' THEN 'In-chambers' END AS precedential_status,
         0 AS citation_count, 3 AS votes, 2 AS sub_opinions, 34 AS columns FROM orders WHERE o_orderkey <> 0 AND o_custkey <> 0""",
)
def cluster_rows(spark, folder):
    status = F.col("o_orderstatus")
    raw = table(spark, folder, "orders").select(
        text("o_orderkey").alias("id"),
        text("o_custkey").alias("docket_id"),
        F.when(status == "F", "Published").when(status == "O", "in_chambers").otherwise("other").alias("precedential_status"),
        F.lit("`3`").alias("scdb_votes_majority"),
        F.concat(F.lit("`1, x,,"), text("o_custkey"), F.lit("`")).alias("sub_opinions"),
    )
    rows = good(project(raw, "opinion_clusters", "wrapped"))
    return rows.select(
        "id",
        "docket_id",
        "precedential_status",
        "citation_count",
        F.col("scdb_votes_majority").alias("votes"),
        F.size("sub_opinions").alias("sub_opinions"),
        F.lit(len(rows.columns) + 1).alias("columns"),
    )


@query(
    "c4_opinion_rows",
    """SELECT doc_id AS id, CASE WHEN lang = 'en' THEN '020lead' ELSE '999unknown' END AS type, md5(text) AS text_md5,
         CASE WHEN doc_id = 0 THEN 'Opinion ID is required' WHEN n_chars % 2 = 0 THEN 'Cluster ID is required' END AS error
       FROM documents""",
)
def opinion_rows(spark, folder):
    lang = F.col("lang")
    raw = table(spark, folder, "documents").select(
        tick(text("doc_id")).alias("id"),
        F.when(lang == "en", "`020lead`").when(lang == "fr", "` `").when(lang == "de", "`7`").alias("type"),
        F.when(F.col("n_chars") % 2 == 0, "`zz`").otherwise("`12`").alias("cluster_id"),
        tick(F.col("text")).alias("plain_text"),
    )
    return project(raw, "opinions", "wrapped").select(
        "id", "type", md5("plain_text").alias("text_md5"), F.get("errors", F.lit(0)).alias("error")
    )


@query(
    "c5_citation_rows",
    """SELECT l_partkey AS cited_opinion_id, l_suppkey AS citing_opinion_id, l_linenumber AS depth,
         CAST(l_returnflag = 'R' AS INTEGER) AS quoted FROM lineitem WHERE l_partkey <> 0 AND l_suppkey <> 0""",
)
def citation_rows(spark, folder):
    raw = table(spark, folder, "lineitem").select(
        tick(text("l_partkey")).alias("cited_opinion_id"),
        tick(text("l_suppkey")).alias("citing_opinion_id"),
        F.concat(F.lit("` "), text("l_linenumber"), F.lit("`")).alias("depth"),
        F.when(F.col("l_returnflag") == "R", "`yes`").otherwise("`no`").alias("quoted"),
    )
    return good(project(raw, "citations", "wrapped")).select(
        "cited_opinion_id", "citing_opinion_id", "depth", flag(F.col("quoted")).alias("quoted")
    )


@query(
    "c6_person_rows",
    """SELECT s_suppkey AS id, s_name AS name_last, s_acctbal AS ftm_total_received,
         CASE WHEN s_nationkey % 2 = 0 THEN CAST(s_nationkey AS BIGINT) END AS is_alias_of, CAST(NULL AS VARCHAR) AS date_dob
       FROM supplier WHERE s_suppkey <> 0""",
)
def person_rows(spark, folder):
    even = F.col("s_nationkey") % 2 == 0
    raw = table(spark, folder, "supplier").select(
        text("s_suppkey").alias("id"),
        tick(F.col("s_name")).alias("name_last"),
        text("s_acctbal").alias("ftm_total_received"),
        F.when(even, text("s_nationkey")).otherwise("\\N").alias("is_alias_of_id"),
        F.lit("\\N").alias("date_dob"),
        F.lit("ignored").alias("fjc_id"),
    )
    return good(project(raw, "people", "wrapped")).select(
        "id", "name_last", "ftm_total_received", "is_alias_of", day("date_dob").alias("date_dob")
    )


@query(
    "c7_court_records",
    f"""WITH {RECORDS} SELECT record_id, jurisdiction, court_name, court_code, case_number, filing_date, parties, case_type, status,
          CAST(jurisdiction = '' AS INTEGER) + CAST(case_number = '' AS INTEGER) AS n_errors FROM records""",
)
def court_records(spark, folder):
    rows = records(spark, folder)
    return rows.select(
        "record_id", "court_identifier.*", "case_metadata.*", F.size("errors").alias("n_errors")
    )


@query(
    "c7_short_records",
    """SELECT CAST(o_orderkey AS VARCHAR) AS record_id, 'Unknown' AS jurisdiction, 'Unknown Court' AS court_name,
         CASE WHEN o_orderstatus = 'F' THEN 'N1' ELSE 'Unknown' END AS case_number, CAST(NULL AS VARCHAR) AS parties FROM orders""",
)
def short_records(spark, folder):
    k = text("o_orderkey")
    long = F.array(k, F.lit(""), F.lit(""), F.lit(""), F.lit("N1"))
    rows = table(spark, folder, "orders").select(
        F.when(F.col("o_orderstatus") == "F", long).otherwise(F.slice(long, 1, 2)).alias("columns")
    )
    return to_records(rows).select(
        "record_id",
        "court_identifier.jurisdiction",
        "court_identifier.court_name",
        "case_metadata.case_number",
        "case_metadata.parties",
    )


@query(
    "c8_field_mappings",
    """SELECT record_id, 6 AS minimal_fields, court_name, 6 AS custom_fields, filing_date AS case_status FROM (
         SELECT CAST(o_orderkey AS VARCHAR) AS record_id, n_name AS court_name,
           CAST(o_custkey AS VARCHAR) AS filing_date
         FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)""",
)
def field_mappings(spark, folder):
    rows = split_court_lines(lines(spark, folder))
    maps = rows.select(
        F.get("columns", F.lit(0)).alias("record_id"),
        mapped_values(F.col("columns"), MINIMAL_MAPPING).alias("minimal"),
        mapped_values(F.col("columns"), CUSTOM_MAPPING).alias("custom"),
    )
    return maps.select(
        "record_id",
        F.size("minimal").alias("minimal_fields"),
        F.try_element_at("minimal", F.lit("court_name")).alias("court_name"),
        F.size("custom").alias("custom_fields"),
        F.try_element_at("custom", F.lit("case_status")).alias("case_status"),
    )


@query(
    "c9_enrich",
    f"""WITH {RECORDS} SELECT record_id, md5(search_text) AS text_md5, 1 AS has_parties, 1 AS has_filing_date, 21 AS column_count FROM records""",
)
def enrich(spark, folder):
    rows = enrich_records(records(spark, folder))
    return rows.select(
        "record_id",
        md5("searchable_text").alias("text_md5"),
        flag(F.col("has_parties")).alias("has_parties"),
        flag(F.col("has_filing_date")).alias("has_filing_date"),
        "column_count",
    )


@query(
    "c10_partial_columns",
    """SELECT o_orderkey AS id, CAST(NULL AS VARCHAR) AS judges, CAST(NULL AS BIGINT) AS votes, 0 AS blocked, 0 AS sub_opinions
       FROM orders WHERE o_orderkey <> 0 AND o_custkey <> 0""",
)
def partial_columns(spark, folder):
    raw = table(spark, folder, "orders").select(text("o_orderkey").alias("id"), text("o_custkey").alias("docket_id"))
    return good(project(raw, "opinion_clusters", "postgres")).select(
        "id",
        "judges",
        F.col("scdb_votes_majority").cast("bigint").alias("votes"),
        flag(F.col("blocked")).alias("blocked"),
        F.size("sub_opinions").alias("sub_opinions"),
    )


@query(
    "c2_rejected_rows",
    """SELECT CASE WHEN o_orderkey = 0 THEN NULL ELSE o_orderkey END AS id,
         CASE WHEN o_orderkey = 0 THEN 'Docket ID is required|' ELSE '' END || 'Case name is required' AS errors
       FROM orders WHERE o_orderstatus = 'F'
       UNION ALL SELECT NULL, 'Docket ID is required' FROM orders WHERE o_orderkey = 0 AND o_orderstatus <> 'F'""",
)
def rejected_rows(spark, folder):
    raw = table(spark, folder, "orders").select(
        F.when(F.col("o_orderkey") > 0, text("o_orderkey")).otherwise("x").alias("id"),
        F.lit("1").alias("court_id"),
        F.when(F.col("o_orderstatus") == "F", "").otherwise("a").alias("case_name"),
        F.lit("n").alias("docket_number"),
    )
    return rejected(project(raw, "dockets")).select("id", F.array_join("errors", "|").alias("errors"))
