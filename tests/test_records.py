import pytest
from pyspark.sql import functions as F

from docketlake.operators import joins as J
from docketlake.operators.court_records import record_errors, record_text, search_records, to_records, validate_and_enrich
from docketlake.operators.predicates import RecordQuery, text_record_query
from docketlake.operators.quality import dataset_checks, file_error_rows
from docketlake.schemas import MINIMAL_MAPPING, STANDARD_MAPPING
from docketlake.streaming import audit


def line(**values):
    base = {n: n[:3] for n in STANDARD_MAPPING.values()}
    return [{**base, **values}[n] for n in STANDARD_MAPPING.values()]


@pytest.fixture(scope="module")
def records(spark):
    rows = [
        line(id="r1", jurisdiction="Federal", case_number="3:21-cv-00123", plaintiff="Smith", defendant="Jones"),
        line(id="r2", jurisdiction="Federal", case_number="2", plaintiff="\x07 State", defendant=""),
        line(id="r3", jurisdiction="State", case_number="3", plaintiff="", defendant="", case_type=""),
    ]
    return to_records(spark.createDataFrame([(r,) for r in rows], "columns array<string>"))


def test_fields_and_columns(records):
    r = records.where("record_id = 'r1'").head()
    assert (r.case_metadata.case_number, r.case_metadata.parties, r.court_identifier.court_code) == ("3:21-cv-00123", "Smith vs Jones", "cou")
    assert len(r.column_data) == 21 and len(r.parsed_data) == 21
    assert [x.parsed_data["plaintiff"] for x in records.where("record_id = 'r2'").collect()] == ["State"]


def test_short_and_rejected_records(spark):
    rows = spark.createDataFrame([(["r1", "", "", "", "n1"],), ([""],), (line(jurisdiction="", case_number=""),)], "columns array<string>")
    out = to_records(rows, MINIMAL_MAPPING).collect()
    assert (out[0].court_identifier.jurisdiction, out[0].court_identifier.court_name, out[0].case_metadata.parties) == ("Unknown", "Unknown Court", None)
    assert out[0].parsed_data == {"id": "r1", "case_number": "n1"}
    assert out[1].errors == ["Record ID cannot be empty"]
    assert out[2].errors == ["Court jurisdiction cannot be empty", "Case number cannot be empty"]


def test_searches(records):
    found = lambda q, n=None: sorted(r.record_id for r in search_records(records, q, n).collect())
    assert found(RecordQuery("jurisdiction", "federal", "equals")) == ["r1", "r2"]
    assert found(RecordQuery("case_number", "3:21-cv-00123", "equals")) == ["r1"]
    assert found(RecordQuery("parties", "vs")) == ["r1"]
    assert found(RecordQuery("court_code", "cou")) == ["r1", "r2", "r3"]
    assert found(text_record_query("SMITH")) == ["r1"]
    assert found(RecordQuery("jurisdiction", "e"), 2) == ["r1", "r2"]


def test_pipeline_and_events(records):
    done = validate_and_enrich(records)
    rows = {r.record_id: r for r in done.collect()}
    assert rows["r1"].has_parties and not rows["r3"].has_parties
    assert rows["r1"].column_count == 21 and rows["r1"].validation_errors == []
    assert rows["r2"].cleaned_count == 1 and rows["r2"].column_data[12] == "State"
    assert rows["r2"].validation_errors == ["Column 12 contains excessive control characters"]
    assert "Smith" in rows["r1"].searchable_text
    at = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    events = {(e.event_type, e.aggregate_id): e.payload for e in audit.record_events(done, at).collect()}
    assert set(events) == {("RecordValidationFailed", "r2"), ("ColumnCleaningApplied", "r2")}
    assert events["ColumnCleaningApplied", "r2"] == {"column_range": "12-18", "cleaned_count": "7"}
    asked = audit.query_events(done, RecordQuery("jurisdiction", "State"), at).collect()
    assert {e.aggregate_id: e.payload["matches"] for e in asked} == {"r1": "False", "r2": "False", "r3": "True"}


def test_column_errors(spark):
    rows = spark.createDataFrame([(["id", None, "a\x00", "\x01" * 2 + "x" * 8, "\r\n\t"],)], "columns array<string>")
    errors = to_records(rows).select(record_errors()).head()[0]
    assert errors == [
        "Column 1 is None",
        "Column 2 contains null bytes",
        "Column 2 contains excessive control characters",
        "Column 3 contains excessive control characters",
    ]


def test_case_data_and_enhanced_text(spark, records):
    courts = spark.createDataFrame([("cou", "Ninth", "Fed", "9th")], "id string, full_name string, jurisdiction string, citation_string string")
    dockets = spark.createDataFrame([(2, "2", "Case B", None), (1, "2", "Case A", "Full A")], "id long, docket_number string, case_name string, case_name_full string")
    opinions = spark.createDataFrame([("r2", 5, "o" * 1200 + "hidden"), ("r2", 6, "second text"), ("r1", 7, "")], "record_id string, id long, plain_text string")
    attached = J.attach_case_data(records, courts, dockets)
    flags = {r.record_id: r.has_case_data for r in J.has_case_data(attached, opinions).collect()}
    assert flags == {"r1": True, "r2": True, "r3": True}
    assert attached.where("record_id = 'r2'").head().docket.case_name == "Case A"
    base = {r.record_id: r[1] for r in records.select("record_id", record_text()).collect()}
    want = base["r2"] + " Ninth Fed 9th Case A 2 Full A " + "o" * 1000 + " second text"
    assert J.enhanced_text(attached, opinions, page_rows=1000, prefix=1000).where("record_id = 'r2'").head().text == want
    pages = J.enhanced_text(attached, opinions, page_rows=1).where("record_id = 'r2'").collect()
    whole = want.replace("o" * 1000, "o" * 1200 + "hidden")
    assert sorted(" ".join(p.text for p in pages).split()) == sorted(whole.split())
    find = lambda q, n=None: sorted(r.record_id for r in J.enhanced_search(attached, opinions, q, n).collect())
    assert find("second Case") == ["r2"] and find("hidden") == ["r2"] and find("hidden", 1000) == [] and find("ninth smith") == ["r1"] and len(find("")) == 3


def test_records_without_a_number_are_dealt_to_many_tasks(spark):
    numbers = ["", " ", None, "Unknown", "n1"]
    rows = [(line(id=f"r{i}", case_number=numbers[i % 5]),) for i in range(1000)]
    records = to_records(spark.createDataFrame(rows, "columns array<string>"))
    courts = spark.createDataFrame([("cou", "Ninth")], "id string, full_name string")
    named = [(7, "", "blank"), (5, "", "first blank"), (1, " ", "space"), (2, "Unknown", "unknown"), (3, "n1", "n"), (4, None, "null")]
    dockets = spark.createDataFrame(named, "id long, docket_number string, case_name string")
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        attached = J.attach_case_data(records, courts, dockets)
        assert attached.columns == [*records.columns, "court", "docket"]
        found = attached.select("record_id", "docket.case_name", F.spark_partition_id().alias("task"), "case_metadata.case_number").collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    want = {"": "first blank", " ": "space", None: None, "Unknown": "unknown", "n1": "n"}
    assert len(found) == 1000 and all(r.case_name == want[r.case_number] for r in found)
    assert len({r.task for r in found if r.case_number != "n1"}) > 8


def test_datasets(spark):
    rows = [("a", "f1", 5, "downloaded", None), ("a", "f2", 2**30, "downloaded", None), ("b", "f", 0, "error", "boom"), ("c", "f", 1, "pending", None), ("d", "f", 1, "downloaded", None)]
    manifest = spark.createDataFrame(rows, "dataset_id string, path string, size long, status string, error_message string")
    names = spark.createDataFrame([(x,) for x in "abcde"], "dataset_id string")
    checks = {r.dataset_id: r for r in dataset_checks(manifest, names, max_bytes=2**30).collect()}
    assert dataset_checks(manifest).where("dataset_id = 'a'").head().ready
    assert {k: r.not_ready_reason for k, r in checks.items()} == {
        "a": "Dataset size exceeds 1GB limit",
        "b": "Dataset contains files with errors",
        "c": "Not all files have been downloaded",
        "d": None,
        "e": "No data files in dataset",
    }
    assert checks["e"].dataset_errors == ["Dataset must contain at least one data file"] and checks["d"].ready
    assert sorted(r.error for r in file_error_rows(manifest).collect()) == ["Data file is empty", "File error: boom"]
