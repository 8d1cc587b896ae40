"""Unions, differences and duplicates."""

from pyspark.sql import functions as F

from docketlake.catalog.registry import CITATIONS, COURTS, OPINIONS, citations, courts, opinions, query, table
from docketlake.operators.index import courts_named
from docketlake.operators.joins import citations_of_opinion
from docketlake.operators.quality import compare_headers
from docketlake.operators.tables import latest_rows, merge, without


@query(
    "j1_union_of_matches",
    f"WITH {COURTS} SELECT id, full_name, jurisdiction FROM courts WHERE full_name = 'ASIA' OR jurisdiction = 'ASIA'",
)
def union_of_matches(spark, folder):
    return courts_named(courts(spark, folder), "ASIA").select("id", "full_name", "jurisdiction")


@query(
    "j2_bag_union",
    f"""WITH {CITATIONS}, both_ways AS (
          SELECT citing_opinion_id, cited_opinion_id FROM citations WHERE cited_opinion_id IN (SELECT s_suppkey + 1 FROM supplier)
          UNION ALL SELECT citing_opinion_id, cited_opinion_id FROM citations WHERE citing_opinion_id IN (SELECT s_suppkey + 1 FROM supplier))
        SELECT citing_opinion_id, count(*) AS n FROM both_ways GROUP BY citing_opinion_id""",
)
def bag_union(spark, folder):
    ids = table(spark, folder, "supplier").select((F.col("s_suppkey") + 1).alias("id"))
    rows = citations_of_opinion(citations(spark, folder), ids)
    return rows.groupBy("citing_opinion_id").agg(F.count("*").alias("n"))


@query(
    "j3_header_difference",
    "SELECT doc_id, 'id' AS missing, lang AS extra FROM documents",
)
def header_difference(spark, folder):
    expected, actual = F.array(F.lit("id"), F.lit("type")), F.array(F.lit("type"), F.col("lang"))
    rows = table(spark, folder, "documents").select("doc_id", expected.alias("expected"), actual.alias("headers"))
    return compare_headers(rows).select(
        "doc_id", F.array_join("missing_fields", ",").alias("missing"), F.array_join("extra_fields", ",").alias("extra")
    )


@query(
    "j4_unvisited",
    f"""WITH {CITATIONS} SELECT DISTINCT cited_opinion_id FROM citations WHERE cited_opinion_id NOT IN
          (SELECT cited_opinion_id FROM citations WHERE citing_opinion_id = 1)""",
)
def unvisited(spark, folder):
    edges = citations(spark, folder)
    visited = edges.where("citing_opinion_id = 1").select("cited_opinion_id")
    return without(edges.select("cited_opinion_id").distinct(), visited)


@query(
    "j5_dedupe_ingests",
    f"WITH {OPINIONS} SELECT id, max(pages) AS pages FROM opinions GROUP BY id",
)
def dedupe(spark, folder):
    rows = opinions(spark, folder)
    first = latest_rows(rows, ["id"], [F.col("pages").asc()])
    return merge(first, rows, ["id"], [F.col("pages").desc()]).select("id", "pages")
