import bz2
import gzip
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docketlake.operators.entities import good, project, rejected
from docketlake.schemas import entity
from docketlake.sources import file_manifest, read_bulk, read_court_lines, read_header, read_json_records, stitch_records, unreadable_files
from docketlake.sources.bulk import drop_blank_keys


def dump(rows, header, quote="`"):
    """Text of a dump; None is an absent value."""
    escape = lambda v: "" if v is None else quote + v.replace("\\", "\\\\").replace(quote, "\\" + quote) + quote
    return ",".join(header) + "\n" + "".join(",".join(map(escape, r)) + "\n" for r in rows)


OPINION_HEADER = ["id", "type", "plain_text", "sha1", "cluster_id"]


def nasty_rows(n, seed=7):
    rng = random.Random(seed)
    pieces = ["\n", "a", "b,", '"', "`", "\\", " x\r\n", "é", "`1`,\n", "<p>"]
    text = lambda: "".join(rng.choice(pieces) for _ in range(rng.randint(0, 60)))
    return [(str(i), "020lead", text(), rng.choice([None, "", "z"]), str(i % 9 + 1)) for i in range(1, n + 1)]


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("kind", ["plain", "bz2", "gz"])
@pytest.mark.parametrize("method", ["parity", "multiline"])
def test_multi_line_records_come_back_exactly(spark, tmp_path, small_splits, kind, method):
    rows = nasty_rows(1500)
    path = {"plain": "o.csv", "bz2": "o.csv.bz2", "gz": "o.csv.gz"}[kind]
    opener = {"plain": open, "bz2": bz2.open, "gz": gzip.open}[kind]
    with opener(tmp_path / path, "wt", newline="", encoding="utf-8") as f:
        f.write(dump(rows, OPINION_HEADER))
    raw = read_bulk(spark, str(tmp_path / path), "opinions", method=method)
    got = {r.id: r.plain_text for r in good(project(raw, "opinions")).select("id", "plain_text").collect()}
    assert got == {int(r[0]): r[2] for r in rows}


def test_one_file_is_read_by_many_tasks(spark, tmp_path, small_splits):
    with open(tmp_path / "o.csv", "w", newline="", encoding="utf-8") as f:
        f.write(dump(nasty_rows(1500), OPINION_HEADER))
    blocks = spark.read.text(str(tmp_path / "o.csv")).select("_metadata.file_block_start").distinct().count()
    assert blocks > 3
    records = stitch_records(spark, str(tmp_path / "o.csv"))
    assert records.count() == 1501
    assert records.select("record").distinct().count() == 1501


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(values=st.lists(st.text(alphabet="ab`\"\\,\n\r é", max_size=12), min_size=1, max_size=8))
def test_any_text_survives_the_parity_reader(spark, tmp_path, values):
    path = tmp_path / f"p{abs(hash(tuple(values)))}.csv"
    rows = [(str(i + 1), "020lead", v, "s", "1") for i, v in enumerate(values)]
    with open(path, "w", newline="", encoding="utf-8") as f:
        f.write(dump(rows, OPINION_HEADER))
    raw = read_bulk(spark, str(path), "opinions")
    got = [r[0] for r in raw.orderBy(F.col("id").cast("int")).select("plain_text").collect()]
    assert got == values


def test_null_blank_and_marker_stay_apart(spark, tmp_path):
    (tmp_path / "d.csv").write_text('id,court_id,case_name,docket_number,slug,cause\n"1","c","n","d",,""\n"2","c","n","d","\\\\N","x"\n')
    raw = read_bulk(spark, str(tmp_path / "d.csv"), "dockets", "postgres")
    rows = {r.id: (r.slug, r.cause) for r in raw.select("id", "slug", "cause").collect()}
    assert rows == {"1": (None, ""), "2": (None, "x")}


def test_carriage_returns_header_only_and_short_rows(spark, tmp_path):
    crlf = dump([("1", "020lead", "a\r\nb", "s", "4"), ("2", "020lead", "c", "s", None)], OPINION_HEADER).replace("`4`\n", "`4`\r\n")
    (tmp_path / "c.csv").write_bytes(crlf.encode())
    rows = project(read_bulk(spark, str(tmp_path / "c.csv"), "opinions"), "opinions")
    assert [tuple(r) for r in good(rows).select("id", "plain_text", "cluster_id").collect()] == [(1, "a\r\nb", 4)]
    assert [r.errors for r in rejected(rows).collect()] == [["Cluster ID is required"]]
    (tmp_path / "h.csv").write_text(",".join(OPINION_HEADER) + "\n")
    assert read_bulk(spark, str(tmp_path / "h.csv"), "opinions").count() == 0
    (tmp_path / "s.csv").write_text(",".join(OPINION_HEADER) + "\n`1`,`t`\n`2`,`020lead`,`x`,`s`,`1`,`more`\n")
    short = project(read_bulk(spark, str(tmp_path / "s.csv"), "opinions"), "opinions")
    assert {r.errors[0] for r in short.collect()} == {"Malformed record"}


@pytest.mark.parametrize("kind", ["plain", "bz2"])
def test_a_stray_quote_costs_one_record(spark, tmp_path, small_splits, kind):
    rows = [(str(i), "020lead", f"text {i} " + "a\nb, `c`\n" * (i % 40), "s", None) for i in range(1, 1200)]
    rows = [(*r[:4], "1") for r in rows]
    text = dump(rows, OPINION_HEADER)
    for i in (3, 500, 501, 900):
        text = text.replace(f"`text {i} ", f"`te`xt {i} ")
    opener, path = {"plain": (open, "bad.csv"), "bz2": (bz2.open, "bad.csv.bz2")}[kind]
    with opener(tmp_path / path, "wt", newline="") as f:
        f.write(text)
    raw = project(read_bulk(spark, str(tmp_path / path), "opinions"), "opinions")
    got = {r.id: r.plain_text for r in good(raw).where("id not in (3, 500, 501, 900)").collect()}
    assert got == {int(r[0]): r[2] for r in rows if r[0] not in ("3", "500", "501", "900")}
    # Nothing is lost silently: what is not good is rejected.
    assert good(raw).count() + rejected(raw).count() >= len(rows)


def test_splits_without_a_certain_start(spark, tmp_path):
    """Values that never tell where a record starts: blank first values, no quotes at all, line feeds only."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        blank = "id,a,b\n" + "".join(f"``,`\n`,`\n{'x' * (i % 90)}\n`\n" for i in range(300))
        plain = "id,a,b\n" + "".join(f"{i},{'y' * (i % 70)},\n" for i in range(300))
        (tmp_path / "blank.csv").write_text(blank)
        (tmp_path / "plain.csv").write_text(plain)
        got = read_bulk(spark, str(tmp_path / "blank.csv"), "dockets")
        assert sorted(r.b for r in got.collect()) == sorted(f"\n{'x' * (i % 90)}\n" for i in range(300))
        got = read_bulk(spark, str(tmp_path / "plain.csv"), "dockets")
        assert {(r.id, r.a) for r in got.collect()} == {(str(i), "y" * (i % 70) or None) for i in range(300)}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("method", ["parity", "multiline", "separator"])
def test_files_are_read_by_their_own_headers(spark, tmp_path, method):
    (tmp_path / "1.csv").write_text("id,full_name,short_name\n`1`,`F\n1`,`S1`\n")
    (tmp_path / "2.csv").write_text("short_name,id,full_name\n`S2`,`2`,`F2`\n")
    (tmp_path / "3.csv").write_text("`id`,`position`\n`3`,`7.5`\n")
    (tmp_path / "4.csv").write_text("id,full_name,short_name\n")
    (tmp_path / "6.csv").write_text("full_name\n`lost`\n")
    raw = read_bulk(spark, str(tmp_path), "courts", method=method, required=["id"])
    rows = {(r.id, r.full_name, r.short_name, r.position) for r in raw.where("_corrupt is null").collect()}
    assert rows == {("1", "F\n1", "S1", None), ("2", "F2", "S2", None), ("3", None, None, "7.5")}
    assert ["lost" in r._corrupt for r in raw.where("_corrupt is not null").collect()] == [True]
    typed = project(raw, "courts")
    assert good(typed).count() + rejected(typed).count() == 4


def test_headers_of_files_are_checked(spark, tmp_path):
    from docketlake.operators.quality import check_headers

    names = [*entity("courts").columns]
    (tmp_path / "1.csv").write_text(",".join(reversed(names)) + "\n`x`\n")
    with bz2.open(tmp_path / "2.csv.bz2", "wt") as f:
        f.write("id,more\n`1`,`2`\n")
    (tmp_path / "3.csv").write_text("")
    rows = {r.file.rsplit("/", 1)[1]: r for r in check_headers(spark, str(tmp_path), "courts").collect()}
    assert rows["1.csv"].valid and rows["1.csv"].missing_fields == []
    assert not rows["2.csv.bz2"].valid and rows["2.csv.bz2"].extra_fields == ["more"]
    assert rows["2.csv.bz2"].missing_fields == sorted(set(names) - {"id"})


def test_records_over_many_splits_stay_whole(spark, tmp_path, small_splits):
    rows = [(str(i), "020lead", f"text {i} " + "x\n" * (40_000 if i == 7 else 300), "s", "1") for i in range(1, 400)]
    (tmp_path / "run.csv").write_text(dump(rows, OPINION_HEADER))
    raw = project(read_bulk(spark, str(tmp_path / "run.csv"), "opinions"), "opinions")
    assert good(raw).count() == len(rows) and rejected(raw).count() == 0
    assert stitch_records(spark, str(tmp_path / "run.csv")).agg(F.max(F.length("value"))).head()[0] > 80_000


def test_gzip_among_plain_files(spark, tmp_path):
    with gzip.open(tmp_path / "c.csv.gz", "wt") as f:
        f.write("id,full_name\n`a`,`A\nB`\n")
    (tmp_path / "d.csv").write_text("full_name,id\n`C\nD`,`c`\n")
    rows = read_bulk(spark, str(tmp_path), "courts").select("id", "full_name").collect()
    assert sorted(map(tuple, rows)) == [("a", "A\nB"), ("c", "C\nD")]


def test_limit_unknown_type_and_header(spark, tmp_path):
    (tmp_path / "c.csv").write_text("id,full_name\n`a`,`A`\n`b`,`B`\n")
    assert read_bulk(spark, str(tmp_path / "c.csv"), "courts", limit=1).count() == 1
    assert read_header(spark, str(tmp_path / "c.csv")) == ["id", "full_name"]
    with pytest.raises(ValueError, match="Unknown data type"):
        read_bulk(spark, str(tmp_path / "c.csv"), "nonsense")


def test_blank_keys_are_skipped(spark):
    rows = spark.createDataFrame([("1",), (" ",), (None,), ("",)], "id string")
    assert drop_blank_keys(rows, entity("dockets")).count() == 1
    edges = spark.createDataFrame([("1", None), (None, None)], "citing_opinion_id string, cited_opinion_id string")
    assert drop_blank_keys(edges, entity("citations")).count() == 1


def test_court_lines_are_stripped_split_and_cleaned(spark, tmp_path):
    columns = [f"c{i}" for i in range(21)]
    columns[12], columns[17] = " p\x00 ", "\x07n"
    (tmp_path / "l.tsv").write_bytes(("\t".join(columns) + "\r\n\n  \nid\t\t\t\n").encode() + b"a\xff\tb\n")
    rows = sorted((r[0] for r in read_court_lines(spark, str(tmp_path / "l.tsv")).collect()), key=len)
    assert rows[0] == ["id"]
    assert rows[1] == ["a", "b"]
    assert len(rows[2]) == 21 and rows[2][12] == "p" and rows[2][17] == "n"


def test_json_records_and_manifest(spark, tmp_path):
    with gzip.open(tmp_path / "1.json.gz", "wt") as f:
        f.write('{"id": 1,\n "docket_id": 2, "date_filed": "2020-01-02"}')
    (tmp_path / "2.json").write_text("{broken")
    rows = read_json_records(spark, str(tmp_path), "opinion_clusters").where("id is not null").collect()
    assert len(rows) == 1
    assert (rows[0].blocked, rows[0].citation_count, rows[0].sub_opinions) == (False, 0, [])
    bad = unreadable_files(spark, str(tmp_path), "opinion_clusters").collect()
    assert [(r.path.rsplit("/", 1)[1], r.text) for r in bad] == [("2.json", "{broken")]
    files = file_manifest(spark, str(tmp_path), "d").collect()
    assert {r.status for r in files} == {"pending"} and len(files) == 2


def test_dumps_with_stray_quotes_are_written_and_read_by_many_tasks(spark, tmp_path, monkeypatch):
    from docketlake.catalog import ingest

    monkeypatch.setattr(ingest, "FILE_ROWS", 50)
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("some words").alias("text"), F.lit("s").alias("source"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    rows = ingest._behind_stray_quotes(spark, str(tmp_path), "none")
    assert sorted(r.id for r in rows.collect()) == [i for i in range(1, 400) if i % 100 != 7]
    written = spark.read.text(ingest._stray_dump(spark, str(tmp_path), "bzip2")).select("value", F.col("_metadata.file_path").alias("file"))
    sizes = [r["count"] for r in written.groupBy("file").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 100 and sum(sizes) == 408
    assert written.where("value like 'id,%'").count() == 8
