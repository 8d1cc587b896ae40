"""Court record lines rendered from orders, customers and nations."""

from pyspark.sql import functions as F

from docketlake.catalog.registry import day, table, text
from docketlake.operators.court_records import to_records
from docketlake.sources.lines import split_court_lines

# Columns: id, created, modified, filed, case number, docket number, court id, court name, jurisdiction,
# case name, case type, status, plaintiff, defendant, two attorneys, judge, notes, tags, description, url.
LINES = """lines AS (
  SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS record_id, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS filing_date,
         CASE WHEN o_orderkey % 13 = 0 THEN '' ELSE 'N-' || CAST(o_orderkey AS VARCHAR) END AS case_number,
         CAST(o_custkey AS VARCHAR) AS docket_number, CAST(c_nationkey AS VARCHAR) AS court_code, n_name AS court_name,
         CASE WHEN o_orderkey % 17 = 0 THEN '' ELSE r_name END AS jurisdiction,
         c_name AS case_name, o_orderpriority AS case_type, o_orderstatus AS status,
         c_mktsegment AS plaintiff, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE c_name END AS defendant
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
       JOIN region ON n_regionkey = r_regionkey)"""

RECORDS = (
    LINES
    + """, records AS (
  SELECT *, CASE WHEN defendant = '' THEN plaintiff ELSE plaintiff || ' vs ' || defendant END AS parties,
    jurisdiction || ' ' || court_name || ' ' || case_number || ' ' ||
      CASE WHEN defendant = '' THEN plaintiff ELSE plaintiff || ' vs ' || defendant END || ' ' || case_type || ' ' ||
      record_id || ' ' || filing_date || ' ' || filing_date || ' ' || filing_date || ' ' || case_number || ' ' ||
      docket_number || ' ' || court_code || ' ' || court_name || ' ' || jurisdiction || ' ' || case_name || ' ' ||
      case_type || ' ' || status || ' ' || plaintiff || ' ' || defendant ||
      ' a1 a2 judge no te tag text url ' ||
      record_id || ' ' || filing_date || ' ' || filing_date || ' ' || filing_date || ' ' || case_number || ' ' ||
      docket_number || ' ' || court_code || ' ' || court_name || ' ' || jurisdiction || ' ' || case_name || ' ' ||
      case_type || ' ' || status || ' text url' AS search_text
  FROM lines)"""
)


def line_columns(spark, folder):
    orders, customer = table(spark, folder, "orders"), table(spark, folder, "customer")
    nation, region = table(spark, folder, "nation"), table(spark, folder, "region")
    joined = (
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    )
    k, filed = F.col("o_orderkey"), day("o_orderdate")
    values = [
        text("o_orderkey"),
        filed,
        filed,
        filed,
        F.when(k % 13 == 0, "").otherwise(F.concat(F.lit("N-"), text("o_orderkey"))),
        text("o_custkey"),
        text("c_nationkey"),
        F.col("n_name"),
        F.when(k % 17 == 0, "").otherwise(F.col("r_name")),
        F.col("c_name"),
        F.col("o_orderpriority"),
        F.col("o_orderstatus"),
        F.concat(F.lit(" "), "c_mktsegment", F.lit("\x07")),
        F.when(k % 3 == 0, "\x01").otherwise(F.concat("c_name", F.lit("\x00 "))),
        F.lit("a1"),
        F.lit("a2 "),
        F.lit("judge\x0b"),
        F.lit(" no\x02 te"),
        F.lit("tag"),
        F.lit("text"),
        F.lit("url"),
    ]
    return joined.select("o_orderkey", F.array(*values).alias("columns"))


def lines(spark, folder):
    """Tab-separated text lines, as they stand in the files."""
    return line_columns(spark, folder).select(
        "o_orderkey", F.concat(F.lit(" "), F.array_join("columns", "\t"), F.lit("\r")).alias("value")
    )


def records(spark, folder):
    return to_records(split_court_lines(lines(spark, folder)), rule=None)
