"""Extension points: text extractors, field maps, mappings and cleaning rules."""

from pyspark.sql import functions as F

from docketlake.catalog.registry import flag, query, table, text, text_opinions
from docketlake.functions.text import CleaningRule, clean_text, join_present
from docketlake.operators.court_records import to_records
from docketlake.operators.entities import good, project
from docketlake.plans import search as K
from docketlake.schemas import Field, Entity, ENTITIES


@query(
    "m1_text_extractor",
    "SELECT doc_id + 1 AS id FROM documents WHERE contains(lower(lang || ' ' || source), 'fr') AND contains(lower(lang || ' ' || source), 'src1')",
)
def text_extractor(spark, folder):
    before = K.TEXT_EXTRACTORS["opinions"]
    K.register_text("opinions", lambda name, columns: join_present(F.col("lang"), F.col("sha1")))
    try:
        found = K.search(text_opinions(spark, folder), K.SearchQuery().text("FR src1"), "opinions").rows
    finally:
        K.register_text("opinions", before)
    return found.select("id")


@query(
    "m2_row_parser",
    "SELECT CAST(page_id + 1 AS BIGINT) AS id, url, CAST(page_id % 2 = 0 AS INTEGER) AS even FROM pages",
)
def row_parser(spark, folder):
    """A further entity only needs its fields; parsing and validation come with it."""
    web_pages = Entity(
        "web_pages",
        (Field("id", "long", "Page ID is required"), Field("url", "string", "URL is required"), Field("even", "bool", default=False)),
        ("id",),
    )
    raw = table(spark, folder, "pages").select(
        text(F.col("page_id") + 1).alias("id"), "url", F.when(F.col("page_id") % 2 == 0, "t").alias("even")
    )
    return good(project(raw, web_pages)).select("id", "url", flag(F.col("even")).alias("even"))


@query(
    "m3_custom_mapping",
    "SELECT CAST(p_partkey AS VARCHAR) AS record_id, p_name AS title, p_brand AS brand, 2 AS fields FROM part",
)
def custom_mapping(spark, folder):
    rows = table(spark, folder, "part").select(F.array(text("p_partkey"), "p_name", "p_brand").alias("columns"))
    out = to_records(rows, {1: "title", 2: "brand", 9: "absent"})
    return out.select(
        "record_id",
        F.try_element_at("parsed_data", F.lit("title")).alias("title"),
        F.try_element_at("parsed_data", F.lit("brand")).alias("brand"),
        F.size("parsed_data").alias("fields"),
    )


@query(
    "m4_cleaning_rule",
    r"""SELECT doc_id, md5(regexp_replace(regexp_replace(text, '[aeiou]', '', 'g'), 'th', 'TH', 'g')) AS text_md5,
          ' ' || lang || chr(7) AS untouched FROM documents""",
)
def cleaning_rule(spark, folder):
    rule = CleaningRule(
        trim_whitespace=False, remove_control_chars=False, remove_patterns=("[aeiou]",), replace_patterns={"th": "TH"}
    )
    keep = CleaningRule(trim_whitespace=False, remove_control_chars=False)
    return table(spark, folder, "documents").select(
        "doc_id",
        F.md5(clean_text(F.col("text"), rule).cast("binary")).alias("text_md5"),
        clean_text(F.concat(F.lit(" "), "lang", F.lit("\x00\x07")), keep).alias("untouched"),
    )
