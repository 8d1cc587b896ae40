"""Scalar functions over columns of the driver tables."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketlake.catalog.records import RECORDS, records
from docketlake.catalog.registry import COURTS, PEOPLE, courts, day, flag, md5, people, query, table, text
from docketlake.functions import parsing as P
from docketlake.functions import text as X
from docketlake.operators.court_records import record_text
from docketlake.schemas import OPINION_TYPE, PRECEDENTIAL_STATUS


def _on(table_name, *columns):
    """A query that selects the given columns from one table."""
    return lambda spark, folder: table(spark, folder, table_name).select(*[c() if callable(c) else c for c in columns])


def tick(c):
    return F.concat(F.lit("`"), c, F.lit("`"))


def register(name, sql, table_name, *columns):
    query(name, sql)(_on(table_name, *columns))


register(
    "f1_unwrap",
    "SELECT doc_id, md5(text) AS text_md5, '' AS lone, lang AS bare FROM documents",
    "documents",
    "doc_id",
    lambda: md5(P.unwrap(tick(F.col("text")))).alias("text_md5"),
    lambda: P.unwrap(F.lit("`")).alias("lone"),
    lambda: P.unwrap(F.col("lang")).alias("bare"),
)
register(
    "f2_parse_string",
    "SELECT event_id, CASE WHEN event_type = 'view' THEN '' ELSE event_type END AS value, '\\N' AS marker FROM events",
    "events",
    "event_id",
    lambda: P.parse_string(F.when(F.col("event_type") != "view", tick(F.col("event_type")))).alias("value"),
    lambda: P.parse_string(F.lit("`\\N`")).alias("marker"),
)
register(
    "f3_parse_integer",
    """SELECT o_orderkey, o_custkey AS value, CAST(NULL AS BIGINT) AS bad,
         CASE WHEN o_orderstatus = 'F' THEN o_orderkey END AS mixed FROM orders""",
    "orders",
    "o_orderkey",
    lambda: P.parse_integer(F.concat(F.lit("` +"), text("o_custkey"), F.lit(" `"))).alias("value"),
    lambda: P.parse_integer(text("o_totalprice")).alias("bad"),
    lambda: P.parse_integer(
        F.when(F.col("o_orderstatus") == "F", text("o_orderkey")).otherwise(F.concat(text("o_orderkey"), F.lit("x"))), False
    ).alias("mixed"),
)
register(
    "f4_parse_float",
    "SELECT o_orderkey, o_totalprice AS value, CAST(NULL AS DOUBLE) AS bad, CAST(o_custkey AS DOUBLE) * 100 AS scaled FROM orders",
    "orders",
    "o_orderkey",
    lambda: P.parse_float(tick(text("o_totalprice"))).alias("value"),
    lambda: P.parse_float(F.concat(text("o_totalprice"), F.lit("d"))).alias("bad"),
    lambda: P.parse_float(F.concat(text("o_custkey"), F.lit("e2"))).alias("scaled"),
)
register(
    "f5_parse_boolean",
    """SELECT l_orderkey, l_linenumber, CAST(l_returnflag = 'R' AS INTEGER) AS value, CAST(l_linestatus = 'O' AS INTEGER) AS word, 0 AS empty
       FROM lineitem""",
    "lineitem",
    "l_orderkey",
    "l_linenumber",
    lambda: flag(P.parse_boolean(F.when(F.col("l_returnflag") == "R", "` T `").otherwise("`f`"))).alias("value"),
    lambda: flag(P.parse_boolean(F.when(F.col("l_linestatus") == "O", "Yes").otherwise("no"))).alias("word"),
    lambda: flag(P.parse_boolean(F.lit(None).cast("string"))).alias("empty"),
)
register(
    "f6_parse_date",
    """SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS value, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS from_time,
         CAST(NULL AS VARCHAR) AS lenient_time, CAST(NULL AS VARCHAR) AS impossible FROM orders""",
    "orders",
    "o_orderkey",
    lambda: day(P.parse_date(tick(F.date_format("o_orderdate", "yyyy-M-d")))).alias("value"),
    lambda: day(P.parse_date(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss.SSS"), False, times=True)).alias("from_time"),
    lambda: day(P.parse_date(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))).alias("lenient_time"),
    lambda: day(P.parse_date(F.date_format("o_orderdate", "yyyy-'02'-'31'"))).alias("impossible"),
)
register(
    "f7_parse_datetime",
    """SELECT event_id, epoch_us(ts) AS value, epoch_us(ts) AS zulu, CAST(NULL AS BIGINT) AS negative, CAST(NULL AS BIGINT) AS with_t FROM events""",
    "events",
    "event_id",
    lambda: X.micros(P.parse_datetime(tick(F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit("+00"))))).alias("value"),
    lambda: X.micros(P.parse_datetime(F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit("Z")))).alias("zulu"),
    lambda: X.micros(P.parse_datetime(F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit("-05")))).alias("negative"),
    lambda: X.micros(P.parse_datetime(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))).alias("with_t"),
)
register(
    "f8_parse_list",
    "SELECT p_partkey, p_name || '|' || p_brand || '|x' AS items, 0 AS none FROM part",
    "part",
    "p_partkey",
    lambda: F.array_join(P.parse_list(F.concat_ws(",", "p_name", F.lit(" "), F.concat(F.lit(" "), "p_brand", F.lit("\t")), F.lit(""), F.lit("x"))), "|").alias("items"),
    lambda: F.size(P.parse_list(F.lit("  "))).alias("none"),
)
register(
    "f9_codes",
    """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'Published' WHEN 'O' THEN 'Relating-to' END AS status,
         CASE o_orderstatus WHEN 'F' THEN '040dissent' ELSE '999unknown' END AS type FROM orders""",
    "orders",
    "o_orderkey",
    lambda: P.parse_code(
        F.when(F.col("o_orderstatus") == "F", " Published").when(F.col("o_orderstatus") == "O", "Relating_To").otherwise("x"),
        PRECEDENTIAL_STATUS,
    ).alias("status"),
    lambda: P.code_or(F.when(F.col("o_orderstatus") == "F", "`040dissent`").otherwise("`dissent`"), OPINION_TYPE, "999unknown").alias("type"),
)
register(
    "f10_null_or_blank",
    "SELECT event_id, CASE WHEN event_type <> 'view' THEN event_type END AS value, 0 AS items FROM events",
    "events",
    "event_id",
    lambda: F.nullif(F.when(F.col("event_type") == "view", "").otherwise(F.col("event_type")), F.lit("")).alias("value"),
    lambda: F.size(P.parse_long_list(F.lit(""))).alias("items"),
)
register(
    "f11_null_marker",
    "SELECT event_id, CASE WHEN event_type <> 'view' THEN event_type END AS value FROM events",
    "events",
    "event_id",
    lambda: P.null_marker(F.when(F.col("event_type") == "view", "\\N").otherwise(F.col("event_type"))).alias("value"),
)
register(
    "f12_clean_text",
    r"""SELECT doc_id, md5(trim(regexp_replace(text, '[\x00-\x08\x0B-\x1F]', '', 'g'), '""" + P.WHITESPACE + r"""')) AS text_md5,
          'a' || lang || E'\n' || source AS dirty FROM documents""",
    "documents",
    "doc_id",
    lambda: md5(X.clean_text(F.col("text"))).alias("text_md5"),
    lambda: X.clean_text(
        F.concat(F.lit(" \t a\x00"), "lang", F.lit("\r\n\x07"), "source", F.lit("\x1f  "))
    ).alias("dirty"),
)


@query(
    "f13_clean_columns",
    """SELECT o_orderkey, ' ' || c_mktsegment || 'x' AS untouched, c_mktsegment AS cleaned, 1 AS changed, 0 AS changed_compat
       FROM orders JOIN customer ON o_custkey = c_custkey""",
)
def clean_columns(spark, folder):
    joined = table(spark, folder, "orders").join(table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    pad = [F.lit("x") for _ in range(11)]
    raw = F.array(F.concat(F.lit(" "), "c_mktsegment", F.lit("x")), *pad, F.concat(F.lit(" "), "c_mktsegment", F.lit("\x01")))
    rows = joined.select("o_orderkey", raw.alias("c"))
    cleaned, compat = X.clean_columns(F.col("c")), X.clean_columns(F.col("c"), compat=True)
    return rows.select(
        "o_orderkey",
        F.get(cleaned, F.lit(0)).alias("untouched"),
        F.get(cleaned, F.lit(12)).alias("cleaned"),
        X.changed_positions(F.col("c"), cleaned).alias("changed"),
        X.changed_positions(F.col("c"), compat).alias("changed_compat"),
    )


register(
    "f14_parties",
    """SELECT c_custkey, c_mktsegment || ' vs ' || c_name AS both_sides, c_name AS one_side, CAST(NULL AS VARCHAR) AS none,
         trim(c_mktsegment || 's vs ', ' vs') AS compat FROM customer""",
    "customer",
    "c_custkey",
    lambda: X.parties(F.col("c_mktsegment"), F.col("c_name")).alias("both_sides"),
    lambda: X.parties(F.lit(""), F.col("c_name")).alias("one_side"),
    lambda: X.parties(F.lit(""), F.lit(None).cast("string")).alias("none"),
    lambda: X.parties(F.concat("c_mktsegment", F.lit("s")), F.lit(""), compat=True).alias("compat"),
)


@query(
    "f15_full_name",
    f"""WITH {PEOPLE} SELECT id, name_first || CASE WHEN name_middle = '' THEN '' ELSE ' ' || name_middle END || ' ' || name_last AS full_name FROM people""",
)
def person_names(spark, folder):
    name = X.full_name(F.col("name_first"), F.col("name_middle"), F.col("name_last"), F.lit(None).cast("string"))
    return people(spark, folder).select("id", name.alias("full_name"))


@query(
    "f16_labels",
    f"WITH {RECORDS} SELECT record_id, jurisdiction || ' - ' || court_name AS court, 'Case ' || case_number AS case_label FROM records",
)
def labels(spark, folder):
    return records(spark, folder).select(
        "record_id",
        X.court_label(F.col("court_identifier.jurisdiction"), F.col("court_identifier.court_name")).alias("court"),
        X.case_label(F.col("case_metadata.case_number")).alias("case_label"),
    )


@query(
    "f17_search_text",
    f"""WITH {COURTS}, {PEOPLE} SELECT 'courts' AS entity, id, full_name || ' ' || short_name || ' ' || jurisdiction || ' ' || citation_string AS search_text FROM courts
        UNION ALL SELECT 'people', CAST(id AS VARCHAR), name_first || CASE WHEN name_middle = '' THEN '' ELSE ' ' || name_middle END || ' ' || name_last || ' ' || dob_city FROM people
        UNION ALL SELECT 'opinions', CAST(doc_id AS VARCHAR), md5(CASE WHEN text = '' THEN '' ELSE text || ' ' END || source) FROM documents
        UNION ALL SELECT 'dockets', CAST(c_custkey AS VARCHAR), c_name || ' D-' || CAST(c_custkey AS VARCHAR) || CASE WHEN c_nationkey = 0 THEN '' ELSE ' n' || CAST(c_nationkey AS VARCHAR) END FROM customer
        UNION ALL SELECT 'opinion_clusters', CAST(o_orderkey AS VARCHAR), CASE WHEN o_orderstatus = 'P' THEN '' ELSE o_orderpriority || ' ' END || CAST(o_custkey AS VARCHAR) FROM orders
        UNION ALL SELECT 'citations', CAST(l_orderkey AS VARCHAR) || '.' || CAST(l_linenumber AS VARCHAR), CAST(l_partkey AS VARCHAR) || ' ' || CAST(l_suppkey AS VARCHAR) FROM lineitem""",
)
def search_texts(spark, folder):
    court, person = courts(spark, folder), people(spark, folder)
    docs = table(spark, folder, "documents").select("doc_id", F.col("text").alias("plain_text"), F.col("source").alias("sha1"))
    lines = table(spark, folder, "lineitem").select(
        F.concat_ws(".", "l_orderkey", "l_linenumber").alias("id"),
        F.col("l_partkey").alias("cited_opinion_id"),
        F.col("l_suppkey").alias("citing_opinion_id"),
    )
    docket = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("key"),
        F.col("c_name").alias("case_name"),
        F.concat(F.lit("D-"), text("c_custkey")).alias("docket_number"),
        F.when(F.col("c_nationkey") == 0, "").otherwise(F.concat(F.lit("n"), text("c_nationkey"))).alias("source"),
    )
    cluster = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("key"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")).alias("case_name"),
        text("o_custkey").alias("judges"),
    )
    of = lambda df, name, key, wrap=lambda c: c: df.select(
        F.lit(name).alias("entity"), text(key).alias("id"), wrap(X.search_text(name, df.columns)).alias("search_text")
    )
    return (
        of(court, "courts", "id")
        .unionByName(of(person, "people", "id"))
        .unionByName(of(docs, "opinions", "doc_id", md5))
        .unionByName(of(lines, "citations", "id"))
        .unionByName(of(docket, "dockets", "key"))
        .unionByName(of(cluster, "opinion_clusters", "key"))
    )


@query("f18_record_text", f"WITH {RECORDS} SELECT record_id, search_text FROM records")
def record_texts(spark, folder):
    return records(spark, folder).select("record_id", record_text().alias("search_text"))


register(
    "f19_preferred_text",
    """SELECT page_id, md5(CASE WHEN page_id % 2 = 0 THEN url ELSE html END) AS text_md5 FROM pages""",
    "pages",
    "page_id",
    lambda: md5(X.plain_text_of(F.when(F.col("page_id") % 2 == 0, F.col("url")).otherwise(""), F.col("html"))).alias("text_md5"),
)
register(
    "f20_entity_of_file",
    """SELECT doc_id, CASE source WHEN 'src1' THEN 'opinion_clusters' WHEN 'src2' THEN 'opinions' WHEN 'src3' THEN 'dockets'
         WHEN 'src4' THEN 'people' WHEN 'src5' THEN 'citations' ELSE 'courts' END AS data_type FROM documents""",
    "documents",
    "doc_id",
    lambda: X.entity_of_file(
        F.concat(
            F.lit("/data/opinions/x/"),
            F.when(F.col("source") == "src1", "Opinion-Clusters-2024")
            .when(F.col("source") == "src2", "opinions")
            .when(F.col("source") == "src3", "dockets")
            .when(F.col("source") == "src4", "people-db-people")
            .when(F.col("source") == "src5", "citation-map")
            .otherwise("other"),
            F.lit(".csv.bz2"),
        )
    ).alias("data_type"),
)
register(
    "f21_index_key",
    """SELECT doc_id, substr(text, 1, 100) AS key, CASE WHEN n_chars > 500 THEN 'True' ELSE 'False' END AS flag_key, CAST(n_chars AS VARCHAR) AS number_key FROM documents""",
    "documents",
    "doc_id",
    lambda: X.index_key(F.col("text"), T.StringType()).alias("key"),
    lambda: X.index_key(F.col("n_chars") > 500, T.BooleanType()).alias("flag_key"),
    lambda: X.index_key(F.col("n_chars"), T.LongType()).alias("number_key"),
)
register(
    "f22_iso_text",
    """SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS iso, strftime(date_trunc('day', ts), '%Y-%m-%dT%H:%M:%S') AS whole,
         strftime(ts, '%Y-%m-%d') AS iso_day FROM events""",
    "events",
    "event_id",
    lambda: X.iso_text(F.col("ts"), T.TimestampNTZType()).alias("iso"),
    lambda: X.iso_text(F.date_trunc("day", "ts"), T.TimestampNTZType()).alias("whole"),
    lambda: X.iso_text(F.col("ts").cast("date"), T.DateType()).alias("iso_day"),
)
