from datetime import date, datetime

from docketlake.operators.entities import good, project, rejected
from docketlake.operators.quality import check_header, error_categories, error_samples, stop_on_errors, TooManyErrors
from docketlake.schemas import ENTITIES, entity

import pytest


def raw(spark, rows, names):
    return spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names.split()))


def test_every_entity_projects_to_its_schema(spark):
    for name, e in ENTITIES.items():
        empty = spark.createDataFrame([], e.raw_schema())
        for dialect in ("backtick", "postgres", "wrapped"):
            out = good(project(empty, name, dialect))
            assert [(f.name, f.dataType) for f in out.schema] == [(f.name, f.dataType) for f in e.schema()], name


def test_court_rows(spark):
    rows = raw(spark, [("`scotus`", "`Supreme Court`", "``", "``", "`1789-09-24`"), ("`x`", "``", "`FD`", "`2.5`", "`bad`")], "id full_name jurisdiction position start_date")
    p = project(rows, "courts", "wrapped")
    ok = good(p).head()
    assert (ok.id, ok.jurisdiction, ok.position, ok.start_date, ok.end_date, ok.notes) == ("scotus", "", 0.0, date(1789, 9, 24), None, "")
    assert rejected(p).head().errors == ["Court full name is required"]


def test_strict_dialect_distinguishes_blank_and_bad(spark):
    names = "id court_id case_name docket_number date_filed date_filed_is_approximate"
    rows = raw(spark, [("7", "ca9", "A v. B", "1", "2020-13-01", "t"), ("x7", "ca9", "A", "1", "", ""), ("", "", "A", "1", None, None)], names)
    p = project(rows, "dockets", "postgres")
    ok = good(p).head()
    assert (ok.id, ok.date_filed, ok.date_filed_is_approximate, ok.slug) == (7, None, True, None)
    errors = sorted(r.errors for r in rejected(p).collect())
    assert errors == [["Docket ID is required", "Court ID is required"], ["Error parsing required field id: Unable to parse integer: x7"]]


def test_opinion_rows(spark):
    names = "id cluster_id type plain_text joined_by author_id author_str date_created"
    rows = raw(spark, [("`3`", "`4`", "` `", "`t`", "`1,2`", "`\\N`", "`ignored`", "`2016-07-05 20:18:57.164305+00`"), ("`5`", "``", "`020lead`", None, None, None, None, None)], names)
    p = project(rows, "opinions", "wrapped")
    ok = good(p).head()
    assert (ok.type, ok.joined_by, ok.author_id, ok.date_created) == ("999unknown", [1, 2], None, datetime(2016, 7, 5, 20, 18, 57, 164305))
    assert rejected(p).head().errors == ["Cluster ID is required"]
    strict = project(raw(spark, [("3", "4", "LEAD"), ("3", "4", "odd")], "id cluster_id type"), "opinions", "postgres")
    assert good(strict).head().type == "020lead"
    assert rejected(strict).head().errors == ["Error parsing required field type: Unknown enum value: odd"]


def test_citation_rows(spark):
    rows = raw(spark, [("1", "2", "3", "t"), ("1", "2", "-1", "f"), ("0", "2", "1", ""), ("1", "2", "", "")], "cited_opinion_id citing_opinion_id depth quoted")
    p = project(rows, "citations")
    assert good(p).count() == 1
    assert sorted(r.errors[0] for r in rejected(p).collect()) == [
        "Citation depth is required",
        "Citation depth must be non-negative",
        "Cited opinion ID is required",
    ]


def test_person_alias_names(spark):
    both = [project(raw(spark, [("1", "9")], f"id {n}"), "people") for n in ("is_alias_of", "is_alias_of_id")]
    assert [good(p).head().is_alias_of for p in both] == [9, 9]
    assert good(both[0]).head().has_photo is False


def test_header_check(spark, tmp_path):
    full = tmp_path / "courts.csv"
    full.write_text(",".join(entity("courts").columns) + "\n")
    part = tmp_path / "part.csv"
    part.write_text("id,full_name,short_name,jurisdiction,citation_string,extra\n")
    assert check_header(spark, str(full), "courts").head().valid
    row = check_header(spark, str(part), "courts").head()
    assert (row.valid, row.missing_fields, row.extra_fields) == (False, ["end_date", "notes", "position", "start_date"], ["extra"])


def test_error_reports(spark):
    message = lambda i: "Docket ID is required" if i % 7 == 0 else "Court full name is required" if i % 11 == 0 else "odd" if i % 23 == 0 else None
    log = spark.createDataFrame([(i, message(i)) for i in range(50)], "row_no int, error string")
    rows = {r.category: (r.occurrences, r.percent, r.bar_percent) for r in error_categories(log).collect()}
    assert rows == {"missing_id": (8, 16.0, 16.0), "missing_name": (4, 8.0, 8.0), "other": (2, 4.0, 4.0)}
    failed = log.where("error is not null")
    first = error_samples(failed, "error", "row_no", 2).where("error = 'Docket ID is required'").orderBy("row_no").collect()
    last = error_samples(failed, "error", "row_no", 2, last=True).where("error = 'Docket ID is required'").orderBy("row_no").collect()
    assert [r.row_no for r in first] == [0, 7] and [r.row_no for r in last] == [42, 49]


def test_stop_on_errors(spark):
    p = project(raw(spark, [("",), ("",), ("1",)], "id"), "people")
    assert stop_on_errors(p, 2) is p
    with pytest.raises(TooManyErrors):
        stop_on_errors(p, 1)
