"""Filter operators over orders, documents and records."""

from pyspark.sql import functions as F

from docketlake.catalog.records import RECORDS, records
from docketlake.catalog.registry import CLUSTERS, MANIFEST, clusters, flag, manifest, query, table, text
from docketlake.operators import predicates as P
from docketlake.operators.court_records import search_records
from docketlake.operators.entities import valid_opinion_row
from docketlake.operators.fuzzy import fuzzy_join
from docketlake.operators.predicates import Filter, RecordQuery, apply_filters, full_text
from docketlake.operators.quality import dataset_checks, files_with_status

ORDER_COLUMNS = ["o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]


def _filtered(*filters):
    def run(spark, folder):
        return apply_filters(table(spark, folder, "orders"), list(filters)).select(*ORDER_COLUMNS)

    return run


def _register(name, condition, *filters):
    query(name, f"SELECT {', '.join(ORDER_COLUMNS)} FROM orders WHERE {condition}")(_filtered(*filters))


_register("d1_equals", "o_orderstatus = 'F'", Filter("o_orderstatus", "eq", "F"))
_register("d2_contains", "o_orderpriority LIKE '%URG%'", Filter("o_orderpriority", "contains", "URG"))
_register("d2_contains_number", "CAST(o_orderkey AS VARCHAR) LIKE '%77%'", Filter("o_orderkey", "contains", 77))
_register("d3_starts_with", "o_orderpriority LIKE '4-%'", Filter("o_orderpriority", "starts_with", "4-"))
_register("d4_ends_with", "o_orderpriority LIKE '%LOW'", Filter("o_orderpriority", "ends_with", "LOW"))
_register("d5_greater_than", "o_totalprice > 250000", Filter("o_totalprice", "gt", 250000))
_register("d6_less_than", "o_orderdate < DATE '1997-01-01'", Filter("o_orderdate", "lt", "1997-01-01"))
_register("d7_greater_equal", "o_orderdate >= DATE '1999-06-01'", Filter("o_orderdate", "gte", "1999-06-01"))
_register("d8_less_equal", "o_totalprice <= 5000.5", Filter("o_totalprice", "lte", "5000.5"))
_register("d9_between", "o_totalprice BETWEEN 1000 AND 90000", Filter("o_totalprice", "between", [1000, 90000]))
_register("d10_in", "o_orderstatus IN ('F', 'P')", Filter("o_orderstatus", "in", ["F", "P"]))
_register(
    "d10_in_long_list",
    "o_custkey BETWEEN 0 AND 1199",
    Filter("o_custkey", "in", list(range(1200))),
)
_register("d11_not_in", "o_orderstatus NOT IN ('F')", Filter("o_orderstatus", "not_in", ["F"]))
_register(
    "d12_regex",
    "regexp_matches(o_orderpriority, '^[1-3]-[A-Z]+$')",
    Filter("o_orderpriority", "regex", "^[1-3]-[A-Z]+$"),
)
_register(
    "d12_regex_named_group",
    "regexp_matches(lower(o_orderpriority), 'low|high')",
    Filter("o_orderpriority", "regex", "(?P<level>low|high)", case_sensitive=False),
)
_register(
    "d14_case_insensitive",
    "lower(o_orderpriority) IN ('5-low', '2-high')",
    Filter("o_orderpriority", "in", ["5-Low", "2-High"], case_sensitive=False),
)
_register(
    "d15_conjunction",
    "o_orderstatus = 'O' AND o_totalprice > 100000 AND o_orderpriority LIKE '%U%'",
    Filter("o_orderstatus", "eq", "O"),
    Filter("o_totalprice", "gt", 100000),
    Filter("o_orderpriority", "contains", "u", case_sensitive=False),
)
_register("d5_uncastable_literal", "FALSE", Filter("o_totalprice", "gt", "a lot"))


@query(
    "d1_is_null",
    """SELECT e.event_id, CAST(NULL AS VARCHAR) AS error
       FROM events e WHERE event_type NOT IN ('purchase', 'signup', 'error')""",
)
def is_null(spark, folder):
    from docketlake.catalog.registry import record_log

    rows = apply_filters(record_log(spark, folder), [Filter("error", "eq", None)])
    return rows.select("event_id", "error")


@query(
    "d11_not_in_excludes_null",
    """SELECT event_id, event_type FROM events WHERE event_type IN ('purchase', 'error')""",
)
def not_in_null(spark, folder):
    from docketlake.catalog.registry import record_log

    rows = apply_filters(record_log(spark, folder), [Filter("error", "not_in", ["Case name is required"])])
    return rows.select("event_id", "event_type")


@query(
    "d13_fuzzy",
    """SELECT p_partkey, p_name FROM part
       WHERE abs(length(p_name) - 9) <= 2 AND levenshtein(lower(p_name), 'blue bold') <= 2""",
)
def fuzzy(spark, folder):
    rows = apply_filters(table(spark, folder, "part"), [Filter("p_name", "fuzzy", "Blue Bold", False)])
    return rows.select("p_partkey", "p_name")


@query(
    "d13_fuzzy_join",
    """SELECT c_custkey, p.name AS pattern FROM customer
       JOIN (SELECT DISTINCT substr(c_name, 1, 9) || substr(c_name, 11) || 'x' AS name FROM customer WHERE c_nationkey = 3) p
         ON levenshtein(lower(c_name), lower(p.name)) <= 2""",
)
def fuzzy_joined(spark, folder):
    """Names against many patterns that each lack a character and have one too many."""
    names = table(spark, folder, "customer").select("c_custkey", "c_name")
    spoilt = F.concat(F.substring("c_name", 1, 9), F.expr("substring(c_name, 11)"), F.lit("x"))
    patterns = table(spark, folder, "customer").where("c_nationkey = 3").select(spoilt.alias("pattern")).distinct()
    return fuzzy_join(names, patterns, "c_name", "pattern").select("c_custkey", "pattern")


@query(
    "d16_full_text",
    """SELECT doc_id, lang FROM documents WHERE lower(text) LIKE '%the%' AND lower(text) LIKE '%nd ti%'
       AND lower(text) LIKE '%er%'""".replace("%nd ti%", "%nd%"),
)
def full_text_search(spark, folder):
    docs = table(spark, folder, "documents")
    return docs.where(full_text(F.col("text"), "The nd  ER")).select("doc_id", "lang")


@query(
    "d16_full_text_empty",
    "SELECT doc_id FROM documents",
)
def full_text_empty(spark, folder):
    return table(spark, folder, "documents").where(full_text(F.col("text"), "")).select("doc_id")


@query(
    "d17_dictionary_predicate",
    """SELECT event_id,
         CAST(props LIKE '%"k": 7%' AS INTEGER) AS starts, CAST(props = '{"k": 42}' AS INTEGER) AS same,
         CAST(regexp_matches(props, ' [13579]*}') AS INTEGER) AS odd, 1 AS word, 0 AS rejected, 0 AS absent
       FROM events""",
)
def dictionary_predicate(spark, folder):
    props = F.from_json("props", "map<string,string>")
    ask = lambda field, value, op: flag(RecordQuery(field, value, op).on_map(F.col("m")))
    named = F.map_concat(props, F.create_map(F.lit("name"), F.lit("Müller")))
    return table(spark, folder, "events").withColumn("m", named).select(
        "event_id",
        ask("k", "7", "starts_with").alias("starts"),
        ask("k", "42", "equals").alias("same"),
        ask("k", "^[13579]*$", "regex").alias("odd"),
        ask("name", r"^\w+$", "regex").alias("word"),
        ask("name", "[[]|(?a:x)", "regex").alias("rejected"),
        ask("missing", "7", "contains").alias("absent"),
    )


@query(
    "d18_record_predicate",
    f"WITH {RECORDS} SELECT record_id, jurisdiction FROM records WHERE lower(jurisdiction) LIKE '%asia%'",
)
def record_predicate(spark, folder):
    rows = search_records(records(spark, folder), RecordQuery("jurisdiction", "Asia"))
    return rows.select("record_id", F.col("court_identifier.jurisdiction").alias("jurisdiction"))


@query(
    "d19_operator_by_name",
    f"""WITH {RECORDS} SELECT 'ends_with' AS operator, count(*) AS n FROM records WHERE case_number LIKE '%7'
        UNION ALL SELECT 'no_such', count(*) FROM records WHERE case_number LIKE '%7%'""",
)
def operator_by_name(spark, folder):
    rows = records(spark, folder)
    parts = [
        search_records(rows, P.build_record_query("case_number", "7", op)).agg(F.count("*").alias("n")).select(
            F.lit(op).alias("operator"), "n"
        )
        for op in ("ends_with", "no_such")
    ]
    return parts[0].unionByName(parts[1])


@query(
    "d20_record_text_search",
    f"WITH {RECORDS} SELECT record_id FROM records WHERE lower(search_text) LIKE '%urgent%'",
)
def record_text_search(spark, folder):
    return search_records(records(spark, folder), P.text_record_query("URGENT")).select("record_id")


RAW_OPINIONS = """raw AS (
  SELECT doc_id, '`' || CAST(doc_id AS VARCHAR) || CASE WHEN n_chars % 11 = 0 THEN 'x' ELSE '' END || '`' AS id,
         CASE WHEN n_chars % 7 = 0 THEN '<p>' ELSE '020lead' END AS type,
         CASE n_chars % 5 WHEN 0 THEN '' WHEN 1 THEN '<i>' WHEN 2 THEN '`' || CAST(n_chars AS VARCHAR) || '`'
                          WHEN 3 THEN 'cl' ELSE repeat('z', 51) END AS cluster_id
  FROM documents)"""


@query(
    "d21_valid_opinion_row",
    f"""WITH {RAW_OPINIONS} SELECT doc_id,
          CAST(regexp_matches(id, '^`[0-9]+`$') AND type NOT LIKE '<%' AND
               (cluster_id = '' OR regexp_matches(cluster_id, '^`[0-9]+`$') OR
                NOT (contains(cluster_id, '<') OR length(cluster_id) > 50)) AS INTEGER) AS valid,
          CAST(regexp_matches(id, '^`[0-9]+`$') AS INTEGER) AS valid_short
        FROM raw""",
)
def valid_opinion(spark, folder):
    n = F.col("n_chars")
    tick = F.lit("`")
    raw = table(spark, folder, "documents").select(
        "doc_id",
        F.concat(tick, text("doc_id"), F.when(n % 11 == 0, "x").otherwise(""), tick).alias("id"),
        F.concat(tick, F.when(n % 7 == 0, "<p>").otherwise("020lead"), tick).alias("type"),
        F.when(n % 5 == 0, "")
        .when(n % 5 == 1, "<i>")
        .when(n % 5 == 2, F.concat(tick, text("n_chars"), tick))
        .when(n % 5 == 3, "cl")
        .otherwise("z" * 51)
        .alias("cluster_id"),
    )
    args = F.col("id"), F.col("type"), F.col("cluster_id")
    return raw.select(
        "doc_id",
        flag(valid_opinion_row(*args)).alias("valid"),
        flag(valid_opinion_row(*args, short=True)).alias("valid_short"),
    )


@query(
    "d22_entity_states",
    f"""WITH {CLUSTERS} SELECT id, CAST(precedential_status = 'Published' AS INTEGER) AS published,
          CAST(blocked AS INTEGER) AS blocked,
          CAST(date_filed > DATE '1998-01-01' AS INTEGER) AS court_active,
          CAST(amount < 100000 AS INTEGER) AS docket_active, CAST(amount < 100000 AS INTEGER) AS alive
        FROM clusters""",
)
def entity_states(spark, folder):
    ended = F.when(F.col("amount") >= 100000, F.col("date_filed"))
    rows = clusters(spark, folder).withColumns(
        {"end_date": F.col("date_filed"), "date_terminated": ended, "date_dod": ended}
    )
    today = F.lit("1998-01-01").cast("date")
    return rows.select(
        "id",
        flag(P.cluster_is_published()).alias("published"),
        flag(P.cluster_is_blocked()).alias("blocked"),
        flag(P.court_is_active(today)).alias("court_active"),
        flag(P.docket_is_active()).alias("docket_active"),
        flag(~P.person_is_deceased()).alias("alive"),
    )


@query(
    "d22_opinion_has_text",
    "SELECT doc_id, CAST(length(text) > 0 AS INTEGER) AS has_text FROM documents",
)
def opinion_text_state(spark, folder):
    docs = table(spark, folder, "documents").withColumnRenamed("text", "plain_text").withColumn("html", F.lit(None).cast("string"))
    return docs.select("doc_id", flag(P.opinion_has_text()).alias("has_text"))


@query(
    "d23_manifest_predicates",
    f"""WITH {MANIFEST} SELECT dataset_id, CAST(bool_and(status = 'downloaded') AS INTEGER) AS download_complete,
          CAST(bool_and(status = 'parsed') AS INTEGER) AS parsing_complete,
          CAST(bool_or(status = 'error') AS INTEGER) AS has_errors,
          count(*) FILTER (WHERE status = 'error') AS error_files
        FROM manifest GROUP BY dataset_id""",
)
def manifest_predicates(spark, folder):
    return dataset_checks(manifest(spark, folder)).select(
        "dataset_id",
        *[flag(F.col(c)).alias(c) for c in ("download_complete", "parsing_complete", "has_errors")],
        "error_files",
    )


@query(
    "d23_files_by_status",
    f"WITH {MANIFEST} SELECT path, size FROM manifest WHERE status = 'error'",
)
def files_by_status(spark, folder):
    return files_with_status(manifest(spark, folder), "error").select("path", "size")
