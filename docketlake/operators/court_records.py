"""Court records built from positional columns: parse, validate, clean, enrich, search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketlake.functions.text import CleaningRule, changed_positions, clean_columns, parties, present
from docketlake.operators.predicates import RecordQuery
from docketlake.plans.paging import SortKey, page
from docketlake.schemas import STANDARD_MAPPING

# Messages of record checks, and defaults of short records.
EMPTY_MESSAGES = {
    "record_id": "Record ID cannot be empty",
    "jurisdiction": "Court jurisdiction cannot be empty",
    "court_name": "Court name cannot be empty",
    "case_number": "Case number cannot be empty",
}
UNKNOWN = "Unknown"
UNKNOWN_COURT = "Unknown Court"
CONTROL_SHARE = 0.1


def _at(columns: Column, position: int, default: str | None = None) -> Column:
    value = F.get(columns, F.lit(position))
    if default is None:
        return value
    return F.when(F.size(columns) > position, value).otherwise(F.lit(default))


def mapped_values(columns: Column, mapping: dict[int, str]) -> Column:
    """Map of field name to value, in position order, for the positions a record has."""
    names = F.array(*[F.lit(mapping.get(i)).cast("string") for i in range(max(mapping) + 1)])
    cells = F.transform(columns, lambda v, i: F.struct(F.get(names, i).alias("key"), v.alias("value")))
    return F.map_from_entries(F.filter(cells, lambda c: c["key"].isNotNull()))


def to_records(
    lines: DataFrame,
    mapping: dict[int, str] | None = None,
    compat_parties: bool = False,
    rule: CleaningRule | None = CleaningRule(),
) -> DataFrame:
    """Court record structs from ``columns: array<string>`` plus ``errors``.

    Mapped values are cleaned, ``column_data`` is not; ``cleaned_data`` holds its
    cleaned form for later steps.  Lines read by this package are clean already
    and need no ``rule``.  Rows with an empty id, jurisdiction, court name or
    case number are not records; they are kept with the reason in ``errors``.
    """
    # Exploding an array of one cleans each record once.
    cleaned = F.explode(F.array(clean_columns(F.col("columns"), rule))) if rule else F.col("columns")
    lines = lines.withColumn("cleaned_data", cleaned)
    c = F.col("columns")
    has_parties = F.size(c) > 13
    empty_id = F.md5(F.array_join(c, "\t").cast("binary"))
    out = lines.withColumns(
        {
            "record_id": F.when(F.size(c) > 0, _at(c, 0)).otherwise(empty_id),
            "court_identifier": F.struct(
                _at(c, 8, UNKNOWN).alias("jurisdiction"),
                _at(c, 7, UNKNOWN_COURT).alias("court_name"),
                _at(c, 6).alias("court_code"),
            ),
            "case_metadata": F.struct(
                _at(c, 4, UNKNOWN).alias("case_number"),
                _at(c, 3).alias("filing_date"),
                F.when(has_parties, parties(_at(c, 12), _at(c, 13), compat_parties)).alias("parties"),
                _at(c, 10).alias("case_type"),
                _at(c, 11).alias("status"),
            ),
            "raw_data": F.create_map().cast("map<string,string>"),
            "parsed_data": mapped_values(F.col("cleaned_data"), mapping or STANDARD_MAPPING),
        }
    ).withColumnRenamed("columns", "column_data")
    return out.withColumn("errors", present(*_empty_checks()))


def _empty_checks() -> list[Column]:
    fields = {
        "record_id": F.col("record_id"),
        "jurisdiction": F.col("court_identifier.jurisdiction"),
        "court_name": F.col("court_identifier.court_name"),
        "case_number": F.col("case_metadata.case_number"),
    }
    return [
        F.when(F.coalesce(value, F.lit("")) == "", F.lit(EMPTY_MESSAGES[name])) for name, value in fields.items()
    ]


def column_errors(columns: Column) -> Column:
    """Messages for NULL values, NUL bytes and too many control characters."""

    control = r"[\x00-\x08\x0B\x0C\x0E-\x1F]"

    def check(v: Column, i: Column) -> Column:
        label = F.concat(F.lit("Column "), i.cast("string"))
        controls = F.length(v) - F.length(F.regexp_replace(v, control, ""))
        excess = controls > F.length(v) * CONTROL_SHARE
        messages = present(
            F.when(v.isNull(), F.concat(label, F.lit(" is None"))),
            F.when(v.contains("\x00"), F.concat(label, F.lit(" contains null bytes"))),
            F.when(excess, F.concat(label, F.lit(" contains excessive control characters"))),
        )
        return F.when(F.coalesce(v.rlike(control), F.lit(True)), messages)

    found = F.flatten(F.filter(F.transform(columns, check), lambda m: m.isNotNull()))
    # One look at the whole record spares clean ones the check of every column;
    # NULL values count as a NUL here.
    suspect = F.array_join(columns, "", "\x00").rlike(control)
    return F.when(suspect, found).otherwise(F.array().cast("array<string>"))


def record_errors() -> Column:
    """All validation messages of a record: empty fields first, then columns."""
    empty = present(*_empty_checks())
    return F.concat(empty, column_errors(F.col("column_data")))


def record_text(rule: CleaningRule = CleaningRule()) -> Column:
    """Ids, parties, parsed values and the columns outside the cleaned range."""
    blank = F.lit("")
    head = F.array(
        F.col("court_identifier.jurisdiction"),
        F.col("court_identifier.court_name"),
        F.col("case_metadata.case_number"),
        F.coalesce("case_metadata.parties", blank),
        F.coalesce("case_metadata.case_type", blank),
    )
    before = F.slice("column_data", 1, rule.start)
    after = F.slice("column_data", F.lit(rule.end + 2), F.size("column_data"))
    return F.array_join(F.concat(head, F.map_values("parsed_data"), before, after), " ")


def clean_records(records: DataFrame, rule: CleaningRule = CleaningRule()) -> DataFrame:
    """Clean the troublesome columns and count the changed ones."""
    if "cleaned_data" not in records.columns:
        records = records.withColumn("cleaned_data", F.explode(F.array(clean_columns(F.col("column_data"), rule))))
    counted = records.withColumn("cleaned_count", changed_positions(F.col("column_data"), F.col("cleaned_data"), rule))
    return counted.withColumn("column_data", F.col("cleaned_data")).drop("cleaned_data")


def enrich_records(records: DataFrame) -> DataFrame:
    filled = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    return records.withColumns(
        {
            "searchable_text": record_text(),
            "has_parties": filled("case_metadata.parties"),
            "has_filing_date": filled("case_metadata.filing_date"),
            "column_count": F.size("column_data"),
        }
    )


def validate_and_enrich(records: DataFrame, rule: CleaningRule = CleaningRule()) -> DataFrame:
    """Validate, then clean, then enrich."""
    checked = records.withColumn("validation_errors", record_errors())
    return checked.transform(clean_records, rule).transform(enrich_records)


# Derived fields a record query may name besides its dictionaries.
DERIVED = {
    "jurisdiction": "court_identifier.jurisdiction",
    "court_name": "court_identifier.court_name",
    "court_code": "court_identifier.court_code",
    "case_number": "case_metadata.case_number",
    "filing_date": "case_metadata.filing_date",
    "parties": "case_metadata.parties",
    "case_type": "case_metadata.case_type",
    "status": "case_metadata.status",
}


def matches_record(query: RecordQuery, columns: list[str]) -> Column:
    """A record matches when its parsed data, raw data or derived fields do."""
    hit = query.on_map(F.col("parsed_data")) | query.on_map(F.col("raw_data"))
    if query.field in DERIVED:
        hit = hit | query.test(F.coalesce(F.col(DERIVED[query.field]), F.lit("")))
    elif query.field == "searchable_text":
        text = F.col("searchable_text") if "searchable_text" in columns else record_text()
        hit = hit | query.test(text)
    return hit


def search_records(records: DataFrame, query: RecordQuery, limit: int | None = None) -> DataFrame:
    """Matching records; with a limit the first ones by record id."""
    found = records.where(matches_record(query, records.columns))
    return page(found, [SortKey("record_id")], limit) if limit else found
