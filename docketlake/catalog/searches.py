"""Composite searches over all entities."""

from pyspark.sql import functions as F

from docketlake.catalog.records import RECORDS, records
from docketlake.catalog.registry import (
    CITATIONS,
    CLUSTERS,
    COURTS,
    DOCKETS,
    PEOPLE,
    citations,
    clusters,
    courts,
    dockets,
    people,
    query,
    text,
    text_opinions,
)
from docketlake.functions.text import search_text
from docketlake.operators.court_records import search_records
from docketlake.operators.fuzzy import fuzzy_join
from docketlake.operators.index import dockets_named
from docketlake.operators.predicates import RecordQuery
from docketlake.operators.text_index import search_index, write_text_index
from docketlake.plans.search import Searcher, SearchQuery
from docketlake.session import scratch_path


def searcher(spark, folder):
    return Searcher(
        {
            "courts": courts(spark, folder),
            "dockets": dockets(spark, folder),
            "opinion_clusters": clusters(spark, folder),
            "opinions": text_opinions(spark, folder),
            "citations": citations(spark, folder),
            "people": people(spark, folder),
        }
    )


FLAGSHIP = """SELECT doc_id + 1 AS id, lang, n_chars FROM documents
  WHERE lang IN ('en', 'de') AND n_chars > 100 AND contains(lower(text), 'the') AND contains(lower(text), 'er')
  ORDER BY n_chars DESC, doc_id LIMIT 20"""


@query("k1_search", FLAGSHIP)
def flagship(spark, folder):
    q = (
        SearchQuery()
        .where("lang", "in", ["en", "de"])
        .where("n_chars", "gt", 100)
        .text("The ER")
        .order("n_chars", "desc")
        .take(20)
    )
    return searcher(spark, folder).opinions(q).rows.select("id", "lang", "n_chars")


@query(
    "k1_search_counts",
    """SELECT count(*) AS total_count, count(*) FILTER (WHERE lang = 'en' AND contains(lower(text || ' ' || source), 'the')) AS filtered_count,
         count(*) FILTER (WHERE lang = 'en' AND contains(lower(text || ' ' || source), 'the')) AS returned_count, 0 AS has_more FROM documents""",
)
def search_counts(spark, folder):
    q = SearchQuery().where("lang", "eq", "en").text("the")
    return searcher(spark, folder).opinions(q).counts.withColumn("has_more", F.col("has_more").cast("int"))


@query("k2_search_courts", f"WITH {COURTS} SELECT id, full_name FROM courts WHERE jurisdiction = 'EUROPE' AND lower(full_name || ' ' || short_name) LIKE '%nation%'")
def search_courts(spark, folder):
    return searcher(spark, folder).courts(SearchQuery().where("jurisdiction", "eq", "EUROPE").text("Nation")).rows.select("id", "full_name")


@query("k2_search_dockets", f"WITH {DOCKETS} SELECT id, case_name FROM dockets WHERE contains(lower(case_name || ' ' || docket_number || ' ' || source), 'building') AND balance > 0")
def search_dockets(spark, folder):
    return searcher(spark, folder).dockets(SearchQuery().where("balance", "gt", 0).text("Building")).rows.select("id", "case_name")


@query("k2_search_clusters", f"WITH {CLUSTERS} SELECT id, amount FROM clusters WHERE date_filed >= DATE '1998-06-01' AND contains(lower(case_name), 'urgent') ORDER BY amount DESC, id LIMIT 50")
def search_clusters(spark, folder):
    q = SearchQuery().where("date_filed", "gte", "1998-06-01").text("URGENT").order("amount", "desc").take(50)
    return searcher(spark, folder).opinion_clusters(q).rows.select("id", "amount")


@query("k2_search_opinions", "SELECT doc_id + 1 AS id FROM documents WHERE contains(lower(text || ' ' || source), 'src3')")
def search_opinions(spark, folder):
    return searcher(spark, folder).opinions(SearchQuery().text("SRC3")).rows.select("id")


@query(
    "k2_search_citations",
    f"""WITH {CITATIONS} SELECT citing_opinion_id, cited_opinion_id, depth FROM citations
        WHERE depth >= 6 AND contains(CAST(cited_opinion_id AS VARCHAR) || ' ' || CAST(citing_opinion_id AS VARCHAR), '99')""",
)
def search_citations(spark, folder):
    q = SearchQuery().where("depth", "gte", 6).text("99")
    return searcher(spark, folder).citations(q).rows.select("citing_opinion_id", "cited_opinion_id", "depth")


@query("k2_search_people", f"WITH {PEOPLE} SELECT id, name_last FROM people WHERE name_first = 'red' AND contains(lower(concat_ws(' ', name_first, nullif(name_middle, ''), name_last, dob_city)), 'economy')")
def search_people(spark, folder):
    return searcher(spark, folder).people(SearchQuery().where("name_first", "eq", "RED", False).text("economy")).rows.select("id", "name_last")


@query(
    "k3_search_advanced",
    """SELECT doc_id + 1 AS id, n_chars FROM documents WHERE lang = 'fr' AND n_chars BETWEEN 200 AND 5000 AND contains(lower(text), 'les')
       ORDER BY n_chars, doc_id LIMIT 30 OFFSET 5""",
)
def search_advanced(spark, folder):
    spec = """{"filters": [{"field": "lang", "operator": "eq", "value": "FR", "case_sensitive": false},
               {"field": "n_chars", "operator": "between", "value": [200, 5000]}],
               "sort": [{"field": "n_chars"}], "limit": 30, "offset": 5, "full_text": "LES"}"""
    return searcher(spark, folder).advanced(spec).rows.select("id", "n_chars")


@query("k4_court_by_name", f"WITH {COURTS} SELECT id, full_name FROM courts WHERE contains(lower(full_name), 'nation_1')")
def court_by_name(spark, folder):
    return searcher(spark, folder).court_by_name("Nation_1").select("id", "full_name")


@query("k4_court_by_exact_name", f"WITH {COURTS} SELECT id, full_name FROM courts WHERE lower(full_name) = 'nation_1'")
def court_by_exact_name(spark, folder):
    return searcher(spark, folder).court_by_name("Nation_1", exact=True).select("id", "full_name")


@query("k5_dockets_by_case_name", f"WITH {DOCKETS} SELECT id, case_name FROM dockets WHERE contains(lower(case_name), 'customer#00000001') AND court_id = '3'")
def dockets_by_case_name(spark, folder):
    return searcher(spark, folder).dockets_by_case_name("CUSTOMER#00000001", "3").select("id", "case_name")


@query("k6_opinions_by_text", "SELECT doc_id + 1 AS id FROM documents WHERE contains(lower(text || ' ' || source), 'tion') ORDER BY doc_id LIMIT 100")
def opinions_by_text(spark, folder):
    return searcher(spark, folder).opinions_by_text("tion", limit=100).select("id")


@query(
    "k6_opinions_by_text_indexed",
    """SELECT doc_id + 1 AS id FROM documents
       WHERE contains(lower(text || ' ' || source), 'tion') AND contains(lower(text || ' ' || source), 'r')""",
)
def opinions_by_text_indexed(spark, folder):
    path = scratch_path(spark, "texts")
    rows = text_opinions(spark, folder)
    write_text_index(rows, path, search_text("opinions", rows.columns))
    return search_index(spark, path, "TION r").select("id")


@query("k7_person_by_name", f"WITH {PEOPLE} SELECT id FROM people WHERE contains(lower(concat_ws(' ', name_first, nullif(name_middle, ''), name_last, dob_city)), 'blue') AND contains(lower(concat_ws(' ', name_first, nullif(name_middle, ''), name_last, dob_city)), 'bolt')")
def person_by_name(spark, folder):
    return searcher(spark, folder).person_by_name("Bolt BLUE").select("id")


@query("k7_person_fuzzy", f"WITH {PEOPLE} SELECT id, name_last FROM people WHERE levenshtein(lower(name_last), 'wigdet') <= 2")
def person_fuzzy(spark, folder):
    return searcher(spark, folder).person_by_name("Wigdet", fuzzy=True).select("id", "name_last")


@query(
    "k7_people_fuzzy_join",
    f"""WITH {PEOPLE} SELECT id, name_last, wanted FROM people
        JOIN (SELECT DISTINCT substr(name_first, 2) AS wanted FROM people) w ON levenshtein(lower(name_last), lower(wanted)) <= 2""",
)
def people_fuzzy_join(spark, folder):
    rows = people(spark, folder)
    wanted = rows.select(F.expr("substring(name_first, 2)").alias("wanted")).distinct()
    return fuzzy_join(rows, wanted, "name_last", "wanted").select("id", "name_last", "wanted")


@query("k8_docket_by_exact_name", f"WITH {DOCKETS} SELECT id, case_name FROM dockets WHERE case_name = 'Customer#000000042'")
def docket_by_exact_name(spark, folder):
    return dockets_named(dockets(spark, folder), "Customer#000000042").select("id", "case_name")


@query(
    "k9_record_search",
    f"WITH {RECORDS} SELECT record_id, case_type FROM records WHERE contains(lower(case_type), 'low') ORDER BY record_id LIMIT 50",
)
def record_search(spark, folder):
    rows = search_records(records(spark, folder), RecordQuery("case_type", "LOW"), 50)
    return rows.select("record_id", text(F.col("case_metadata.case_type")).alias("case_type"))
