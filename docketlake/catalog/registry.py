"""Registry of queries and the driver tables in the roles of the legal entities."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QueryFunction = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFunction] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[QueryFunction], QueryFunction]:
    """Register a query and, where there is one, its SQL."""

    def add(fn: QueryFunction) -> QueryFunction:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def day(c: str | Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


def md5(c: str | Column) -> Column:
    return F.md5((F.col(c) if isinstance(c, str) else c).cast("binary"))


def flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False)).cast("int")


# Entities in terms of the driver tables; the SQL beside each says the same.

COURTS = """courts AS (
  SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name AS full_name, substr(n_name, 1, 6) AS short_name,
         r_name AS jurisdiction, CAST(n_nationkey AS DOUBLE) AS position, lower(n_name) AS citation_string
  FROM nation JOIN region ON n_regionkey = r_regionkey)"""


def courts(spark: SparkSession, folder: str) -> DataFrame:
    nation, region = table(spark, folder, "nation"), table(spark, folder, "region")
    return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        text("n_nationkey").alias("id"),
        F.col("n_name").alias("full_name"),
        F.substring("n_name", 1, 6).alias("short_name"),
        F.col("r_name").alias("jurisdiction"),
        F.col("n_nationkey").cast("double").alias("position"),
        F.lower("n_name").alias("citation_string"),
        F.lit(None).cast("date").alias("start_date"),
        F.lit(None).cast("date").alias("end_date"),
        F.lit(None).cast("string").alias("notes"),
    )


DOCKETS = """dockets AS (
  SELECT c_custkey + 1 AS id, CAST(c_nationkey AS VARCHAR) AS court_id, c_name AS case_name,
         'D-' || CAST(c_custkey AS VARCHAR) AS docket_number, c_mktsegment AS source, c_acctbal AS balance
  FROM customer)"""


def dockets(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").select(
        (F.col("c_custkey") + 1).alias("id"),
        text("c_nationkey").alias("court_id"),
        F.col("c_name").alias("case_name"),
        F.concat(F.lit("D-"), text("c_custkey")).alias("docket_number"),
        F.col("c_mktsegment").alias("source"),
        F.col("c_acctbal").alias("balance"),
    )


CLUSTERS = """clusters AS (
  SELECT o_orderkey + 1 AS id, o_custkey + 1 AS docket_id, CAST(o_orderdate AS DATE) AS date_filed,
         o_orderpriority AS case_name, o_totalprice AS amount, o_orderpriority = '1-URGENT' AS blocked,
         CASE o_orderstatus WHEN 'F' THEN 'Published' WHEN 'O' THEN 'Unpublished' ELSE 'Errata' END
           AS precedential_status
  FROM orders)"""


def clusters(spark: SparkSession, folder: str) -> DataFrame:
    status = F.col("o_orderstatus")
    return table(spark, folder, "orders").select(
        (F.col("o_orderkey") + 1).alias("id"),
        (F.col("o_custkey") + 1).alias("docket_id"),
        F.col("o_orderdate").cast("date").alias("date_filed"),
        F.col("o_orderpriority").alias("case_name"),
        F.col("o_totalprice").alias("amount"),
        (F.col("o_orderpriority") == "1-URGENT").alias("blocked"),
        F.when(status == "F", "Published").when(status == "O", "Unpublished").otherwise("Errata").alias(
            "precedential_status"
        ),
    )


OPINIONS = """opinions AS (
  SELECT (l_orderkey + 1) * 10 + l_linenumber AS id, l_orderkey + 1 AS cluster_id, l_returnflag AS type,
         l_quantity AS pages
  FROM lineitem)"""


def opinions(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").select(
        ((F.col("l_orderkey") + 1) * 10 + F.col("l_linenumber")).alias("id"),
        (F.col("l_orderkey") + 1).alias("cluster_id"),
        F.col("l_returnflag").alias("type"),
        F.col("l_quantity").alias("pages"),
    )


def text_opinions(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as opinions with a text."""
    return table(spark, folder, "documents").select(
        (F.col("doc_id") + 1).alias("id"),
        (F.col("doc_id") + 1).alias("cluster_id"),
        F.col("text").alias("plain_text"),
        F.lit(None).cast("string").alias("html"),
        F.col("source").alias("sha1"),
        "lang",
        "n_chars",
    )


# Opinions are suppliers and parts; part ids start at ten million.
CITATIONS = """citations AS (
  SELECT l_suppkey + 1 AS citing_opinion_id, 10000000 + l_partkey AS cited_opinion_id,
         l_linenumber AS depth, l_returnflag = 'R' AS quoted
  FROM lineitem)"""


def citations(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").select(
        (F.col("l_suppkey") + 1).alias("citing_opinion_id"),
        (F.col("l_partkey") + 10_000_000).alias("cited_opinion_id"),
        F.col("l_linenumber").alias("depth"),
        (F.col("l_returnflag") == "R").alias("quoted"),
    )


def nodes(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of all opinions in the citation graph."""
    suppliers = table(spark, folder, "supplier").select((F.col("s_suppkey") + 1).alias("id"))
    parts = table(spark, folder, "part").select((F.col("p_partkey") + 10_000_000).alias("id"))
    return suppliers.unionByName(parts)


PEOPLE = """people AS (
  SELECT p_partkey + 1 AS id, split_part(p_name, ' ', 1) AS name_first, split_part(p_name, ' ', 2) AS name_last,
         CASE WHEN p_size % 2 = 0 THEN p_brand ELSE '' END AS name_middle, p_type AS dob_city
  FROM part)"""


def people(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select(
        (F.col("p_partkey") + 1).alias("id"),
        F.split_part("p_name", F.lit(" "), F.lit(1)).alias("name_first"),
        F.split_part("p_name", F.lit(" "), F.lit(2)).alias("name_last"),
        F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).otherwise("").alias("name_middle"),
        F.col("p_type").alias("dob_city"),
    )


IMPORT_LOG = """import_log AS (
  SELECT event_type AS data_type, ts, event_id + 1 AS processed, event_id + 1 - CAST(floor(value) AS BIGINT) AS imported,
         CAST(floor(value) AS BIGINT) AS errors, 1000000 AS estimated_total,
         CASE WHEN event_type = 'view' THEN 'completed' ELSE 'processing' END AS status
  FROM events)"""


def import_log(spark: SparkSession, folder: str) -> DataFrame:
    errors = F.floor("value").cast("bigint")
    return table(spark, folder, "events").select(
        F.col("event_type").alias("data_type"),
        "ts",
        (F.col("event_id") + 1).alias("processed"),
        (F.col("event_id") + 1 - errors).alias("imported"),
        errors.alias("errors"),
        F.lit(1_000_000).cast("bigint").alias("estimated_total"),
        F.when(F.col("event_type") == "view", "completed").otherwise("processing").alias("status"),
    )


# A log of processed records: purchases lack an id, signups a name, errors fail otherwise.
RECORD_LOG = """record_log AS (
  SELECT event_id, user_id, event_type, value,
         CASE event_type WHEN 'purchase' THEN 'Docket ID is required' WHEN 'signup' THEN 'Case name is required'
                         WHEN 'error' THEN 'Bad value ' || CAST(user_id AS VARCHAR) END AS error
  FROM events)"""


def record_log(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.col("event_type")
    return table(spark, folder, "events").select(
        "event_id",
        "user_id",
        "event_type",
        "value",
        F.when(kind == "purchase", "Docket ID is required")
        .when(kind == "signup", "Case name is required")
        .when(kind == "error", F.concat(F.lit("Bad value "), text("user_id")))
        .alias("error"),
    )


# Documents as files of a data set per source.
MANIFEST = """manifest AS (
  SELECT source AS dataset_id, source || '/' || CAST(doc_id AS VARCHAR) AS path, n_chars AS size,
         CASE WHEN d.lang IN ('en', 'fr') THEN 'downloaded' WHEN d.lang = 'de' THEN 'parsed'
              WHEN n_chars > 3000 THEN 'error' ELSE 'pending' END AS status,
         CASE WHEN d.lang = 'es' AND n_chars > 3000 THEN 'too long: ' || CAST(n_chars AS VARCHAR) END AS error_message
  FROM documents d)"""


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    lang, size = F.col("lang"), F.col("n_chars")
    return table(spark, folder, "documents").select(
        F.col("source").alias("dataset_id"),
        F.concat("source", F.lit("/"), text("doc_id")).alias("path"),
        size.alias("size"),
        F.when(lang.isin("en", "fr"), "downloaded")
        .when(lang == "de", "parsed")
        .when(size > 3000, "error")
        .otherwise("pending")
        .alias("status"),
        F.when((lang == "es") & (size > 3000), F.concat(F.lit("too long: "), text(size))).alias("error_message"),
    )
