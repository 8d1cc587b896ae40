"""Speed windows, sorting and paging."""

from pyspark.sql import functions as F

from docketlake.catalog.registry import import_log, query, table
from docketlake.catalog.statistics import SPEEDS
from docketlake.operators import progress as P
from docketlake.operators.predicates import Filter
from docketlake.plans.paging import page, sort_columns
from docketlake.plans.search import SearchQuery, search


@query("i1_instant_speed", f"WITH {SPEEDS} SELECT data_type, processed, round(speed, 6) AS speed FROM speeds")
def instant_speed(spark, folder):
    rows = P.instant_speed(import_log(spark, folder))
    return rows.select("data_type", "processed", F.round("speed", 6).alias("speed"))


@query("i2_average_speed", f"WITH {SPEEDS} SELECT data_type, processed, round(avg_speed, 6) AS avg_speed FROM progress")
def average_speed(spark, folder):
    rows = P.average_speed(import_log(spark, folder))
    return rows.select("data_type", "processed", F.round("avg_speed", 6).alias("avg_speed"))


@query(
    "i2_average_speed_segmented",
    f"WITH {SPEEDS} SELECT data_type, processed, round(avg_speed, 6) AS avg_speed FROM progress",
)
def average_speed_segmented(spark, folder):
    """The same windows with every type spread over many ranges."""
    rows = P.average_speed(import_log(spark, folder), rows_per_range=100)
    return rows.select("data_type", "processed", F.round("avg_speed", 6).alias("avg_speed"))


@query(
    "i3_time_left",
    f"""WITH {SPEEDS} SELECT data_type, processed, CASE WHEN avg_speed > 0 THEN
          CASE WHEN estimated_total <= processed THEN 0 ELSE CAST(floor((estimated_total - processed) / avg_speed) AS BIGINT) END END AS eta_seconds
        FROM progress""",
)
def time_left(spark, folder):
    rows = P.average_speed(import_log(spark, folder)).transform(P.with_eta)
    return rows.select("data_type", "processed", "eta_seconds")


def _orders(spark, folder):
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("id"), "o_orderstatus", "o_orderpriority", "o_totalprice"
    )


@query(
    "i4_multi_key_sort",
    """SELECT id, o_orderstatus, o_totalprice, row_number() OVER (ORDER BY o_orderstatus ASC, o_totalprice DESC, id) AS place
       FROM (SELECT o_orderkey AS id, o_orderstatus, o_totalprice FROM orders) QUALIFY place <= 500""",
)
def multi_key_sort(spark, folder):
    rows = page(
        _orders(spark, folder), sort_columns([("o_orderstatus", "asc"), ("o_totalprice", "desc")], ["id"]), limit=500
    ).select("id", "o_orderstatus", "o_totalprice")
    return rows.withColumn("place", F.monotonically_increasing_id() + 1)


@query("i4_full_sort", "SELECT o_orderkey AS id, o_totalprice FROM orders")
def full_sort(spark, folder):
    rows = page(_orders(spark, folder), sort_columns([("o_totalprice", "desc")], ["id"], reverse_all=True))
    return rows.select("id", "o_totalprice")


@query(
    "i5_pagination",
    "SELECT o_orderkey AS id, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40",
)
def pagination(spark, folder):
    rows = page(_orders(spark, folder), sort_columns([("o_totalprice", "desc")], ["id"]), 20, 40)
    return rows.select("id", "o_totalprice")


@query(
    "i5_deep_page",
    "SELECT o_orderkey AS id, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey OFFSET 700",
)
def deep_page(spark, folder):
    """An offset without a limit: numbered after a distributed sort."""
    rows = page(_orders(spark, folder), sort_columns([("o_totalprice", "asc")], ["id"]), None, 700)
    return rows.select("id", "o_totalprice")


@query(
    "i6_page_counts",
    """SELECT count(*) AS total_count, count(*) FILTER (WHERE o_orderstatus = 'F') AS filtered_count, CAST(25 AS BIGINT) AS returned_count, 1 AS has_more FROM orders""",
)
def page_counts(spark, folder):
    q = SearchQuery(filters=(Filter("o_orderstatus", "eq", "F"),)).take(25, 10)
    counts = search(_orders(spark, folder), q).counts
    return counts.withColumn("has_more", F.col("has_more").cast("int"))


@query(
    "i7_top_n",
    "SELECT o_orderkey AS id, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10",
)
def top_n(spark, folder):
    q = SearchQuery().order("o_totalprice", "desc").take(10)
    return search(_orders(spark, folder), q).rows.select("id", "o_totalprice")
