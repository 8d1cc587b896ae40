import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from docketlake.operators import progress as P
from docketlake.operators.ranges import RANGE, into_ranges, with_carried
from docketlake.operators.stats import estimated_records, import_totals, indexed_fields, volume
from docketlake.operators.tables import read_table
from docketlake.schemas import entity
from docketlake.streaming import ingest as S

from test_sources import dump

LOG = "data_type string, ts timestamp_ntz, processed long, imported long, errors long, estimated_total long, status string"


def make_log(seed, n=400):
    """One type holds most updates; many updates share their time."""
    rng = random.Random(seed)
    rows = []
    for kind, count in (("dockets", n), ("courts", n // 8), ("people", 1)):
        ts, done = datetime(2024, 1, 1), 0
        for _ in range(count):
            rows.append((kind, ts, done, done, 0, 5000, "processing"))
            ts += timedelta(seconds=rng.choice([0, 0, 1, 2, 5]))
            done += rng.randint(1, 9)
    return rows


def plain_speeds(rows):
    """Speeds and averages computed one update after the other."""
    out, samples, last = {}, {}, {}
    for kind, ts, done, *_ in sorted(rows):
        speed = None
        if kind in last:
            seconds = (ts - last[kind][0]).total_seconds()
            if seconds > 0:
                speed = (done - last[kind][1]) / seconds
                samples.setdefault(kind, []).append(speed)
        last[kind] = (ts, done)
        recent = samples.get(kind, [])[-20:]
        weights = range(1, len(recent) + 1)
        average = sum(s * w for s, w in zip(recent, weights)) / sum(weights) if recent else 0.0
        out[kind, done] = (speed, average)
    return out


@pytest.mark.parametrize("rows_per_range", [10**9, 60, 7])
def test_speeds_do_not_depend_on_ranges(spark, rows_per_range):
    rows = make_log(5)
    log = spark.createDataFrame(rows, LOG).repartition(5)
    want = plain_speeds(rows)
    got = P.average_speed(log, rows_per_range=rows_per_range).collect()
    assert len(got) == len(rows)
    for r in got:
        speed, average = want[r.data_type, r.processed]
        assert r.speed == (None if speed is None else pytest.approx(speed))
        assert r.avg_speed == pytest.approx(average)


def test_rows_without_a_key_and_thousands_of_keys_span_ranges(spark):
    """A third of the rows has no key, a third one key, and 5,000 keys share the rest; no range is larger than asked."""
    n = 60_000
    i = F.col("id")
    key = F.when(i % 3 == 1, "hot").when(i % 3 == 2, F.concat(F.lit("k"), (i % 15_000).cast("string")))
    rows = spark.range(n).select(key.alias("key"), i.alias("at"), (i * 7 % 11).alias("v")).repartition(6)
    ranges = into_ranges(rows, ["key"], ["at"], 3000)
    sizes = [r["count"] for r in ranges.rows.groupBy(RANGE).count().collect()]
    assert len(sizes) >= 18 and max(sizes) < 6000
    keys = ranges.rows.groupBy("key").agg(F.countDistinct(RANGE).alias("n")).where("n > 3").collect()
    assert {r.key for r in keys} == {None, "hot"}
    total = lambda w: F.sum("v").over(w.rowsBetween(-40, 0)).alias("total")
    got = with_carried(ranges, 40).select("key", "at", total(ranges.window), "_carried").where("not _carried").drop("_carried")
    want = rows.select("key", "at", total(Window.partitionBy("key").orderBy("at")))
    assert got.exceptAll(want).count() == 0 and got.count() == n


def test_ranges_smaller_than_what_is_carried(spark):
    rows = spark.createDataFrame([(k, i, i) for k in ("a", None, "b") for i in range(9)], "key string, at int, v int")
    ranges = into_ranges(rows, ["key"], ["at"], 2)
    carried = with_carried(ranges, 5, F.col("v") % 2 == 0).where("_carried")
    assert {r.v % 2 for r in carried.collect()} == {0}
    w = ranges.window.rowsBetween(-5, 0)
    got = with_carried(ranges, 5).withColumn("s", F.sum("v").over(w)).where("not _carried").select("key", "at", "s")
    want = rows.select("key", "at", F.sum("v").over(Window.partitionBy("key").orderBy("at").rowsBetween(-5, 0)).alias("s"))
    assert got.exceptAll(want).count() == 0 and got.count() == 27
    empty = into_ranges(rows.limit(0), ["key"], ["at"])
    assert with_carried(empty, 3).count() == 0


def test_small_ranges_share_tasks_and_files(spark):
    rows = spark.range(5000).select(F.lit("k").alias("key"), F.floor(F.col("id") / 3).alias("at"), "id")
    ranges = into_ranges(rows, ["key"], ["at"], 10)
    assert len(ranges.rows.inputFiles()) <= 4
    sizes = [r["count"] for r in ranges.rows.groupBy(RANGE).count().collect()]
    assert len(sizes) >= 400 and max(sizes) <= 12
    assert ranges.rows.groupBy("at").agg(F.countDistinct(RANGE).alias("n")).where("n > 1").count() == 0
    total = lambda w: F.sum("at").over(w.orderBy("at", "id").rowsBetween(-25, 0)).alias("s")
    ranges = into_ranges(rows, ["key"], ["at", "id"], 10)
    got = with_carried(ranges, 25).select("id", total(Window.partitionBy(RANGE)), "_carried").where("not _carried").drop("_carried")
    assert got.exceptAll(rows.select("id", total(Window.partitionBy("key")))).count() == 0 and got.count() == 5000


def test_eta_and_overall(spark):
    eta = lambda e, p, s: spark.range(1).select(P.eta_seconds(F.lit(e), F.lit(p), F.lit(s))).head()[0]
    assert (eta(100, 10, 4.0), eta(100, 100, 4.0), eta(100, 10, 0.0), eta(0, 1, 1.0)) == (22, 0, None, None)
    log = spark.createDataFrame(
        [("a", datetime(2024, 1, 1), 0, 0, 0, 100, "processing"), ("a", datetime(2024, 1, 1, 0, 0, 10), 50, 48, 2, 100, "processing"), ("b", datetime(2024, 1, 1), 7, 7, 0, None, "completed")],
        LOG,
    )
    r = P.overall_progress(log).head()
    assert (r.total_processed, r.total_imported, r.total_errors, r.overall_percent, r.overall_speed, r.overall_eta_seconds) == (57, 55, 2, 57.0, 5.0, 10)


def test_volumes(spark):
    row = spark.range(1).select(
        *[estimated_records(F.lit(k), F.lit(4500)) for k in ("dockets", "opinions", "citations", "courts", "people", "opinion_clusters")]
    ).head()
    assert tuple(row) == (4, 2, 20, 2000, 10000, None)
    lines = spark.range(1000)
    assert volume(lines, F.col("id") % 4 == 0).head().estimated_valid == 250
    totals = import_totals(spark.createDataFrame([("a", 3, 1), ("b", 4, 0)], "data_type string, imported int, errors int"))
    assert {r.data_type: (r.imported, r.errors) for r in totals.collect()} == {"a": (3, 1), "b": (4, 0), "(all)": (7, 1)}
    fields = indexed_fields(spark.sql("SELECT 1 AS id, CAST(NULL AS STRING) AS gone, 'x' AS here, 'd' AS date_created")).head()
    assert (fields.records, fields.fields) == (1, ["id", "here"])


HEADER = ["id", "court_id", "case_name", "docket_number"]


def test_ingest_resumes_and_keeps_rejects(spark, tmp_path):
    inbox, root = tmp_path / "in", str(tmp_path / "lake")
    inbox.mkdir()
    run = lambda: S.ingest(spark, str(inbox), "dockets", root, files_per_batch=1)
    (inbox / "1.csv").write_text(dump([("1", "c", "old\nname", "d"), ("2", "c", "", "d")], HEADER))
    run()
    run()  # nothing new
    (inbox / "2.csv").write_text(dump([("1", "c", "new, name", "d"), ("3", "c", "x", "d"), (" ", "", "", "")], HEADER))
    (inbox / "3.csv").write_text(dump([("4", "c", "y", "d"), ("4", "c", "z", "d")], HEADER))
    run()
    table = S.ingested(spark, root, "dockets")
    assert {r.id: r.case_name for r in table.collect()} == {1: "new, name", 3: "x", 4: "z"}
    assert not {"_seq", "batch_id"} & set(table.columns)
    assert read_table(spark, S.IngestPaths(root).table("dockets")) is None
    assert S.compact(spark, root, "dockets").count() == 3
    assert S.compact(spark, root, "dockets").count() == 3  # nothing left to fold
    (inbox / "4.csv").write_text(dump([("3", "c", "last", "d")], HEADER))
    run()
    assert {r.id: r.case_name for r in S.ingested(spark, root, "dockets").collect()} == {1: "new, name", 3: "last", 4: "z"}
    rejects = spark.read.parquet(S.IngestPaths(root).rejects("dockets"))
    assert [(r.id, r.errors) for r in rejects.collect()] == [(2, ["Case name is required"])]
    state = S.ingest_positions(S.ingest_state(spark, root)).head()
    assert (state.last_batch, state.processed, state.imported, state.errors, state.last_id) == (3, 7, 6, 1, "3")


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    write = S.batch_writer(S.IngestPaths(str(tmp_path)), "dockets", "backtick")
    lines = dump([("1", "c", "n", "d"), ("2", "c", "", "d")], HEADER).splitlines()
    batch = spark.createDataFrame([(v, "f", 0) for v in lines], "value string, file string, block bigint").coalesce(1)
    for _ in range(2):
        write(batch, 0)
    state = S.ingest_positions(S.ingest_state(spark, str(tmp_path))).head()
    assert (state.processed, state.imported, state.errors) == (2, 1, 1)
    assert S.ingested(spark, str(tmp_path), "dockets").count() == 1
    assert spark.read.parquet(S.IngestPaths(str(tmp_path)).rejects("dockets")).count() == 1


def test_columns_that_files_lack_are_written_but_not_kept(spark, tmp_path, monkeypatch):
    paths, kept = S.IngestPaths(str(tmp_path)), []
    lines = dump([("1", "c", "n", "d"), ("1", "c", "m", "d"), ("2", "c", "", "d")], HEADER).splitlines()
    batch = spark.createDataFrame([(v, "f", 0) for v in lines], "value string, file string, block bigint").coalesce(1)
    persist = type(batch).persist
    monkeypatch.setattr(type(batch), "persist", lambda df, *level: kept.append(df.columns) or persist(df, *level))
    S.batch_writer(paths, "dockets", "backtick")(batch, 0)
    assert [set(c) for c in kept] == [{"id", "court_id", "case_name", "docket_number", "errors", "_seq"}]
    good, bad = (spark.read.parquet(f"{p('dockets')}/batch_id=0") for p in (paths.changes, paths.rejects))
    assert good.columns == entity("dockets").columns and bad.columns == [*entity("dockets").columns, "errors"]
    assert dict(good.dtypes) == {f.name: f.dataType.simpleString() for f in entity("dockets").schema()}
    blank = {f.name: "" if f.kind == "string" else f.default for f in entity("dockets").fields}
    assert [r.asDict() for r in good.collect()] == [{**blank, "id": 1, "court_id": "c", "case_name": "m", "docket_number": "d"}]
    assert [r.asDict() for r in bad.collect()] == [
        {**blank, "id": 2, "court_id": "c", "docket_number": "d", "errors": ["Case name is required"]}
    ]


def test_stream_equals_batch(spark, tmp_path):
    from docketlake.operators.entities import project
    from docketlake.sources import read_bulk

    rows = [(str(i), "c", f"name\n{i}" if i % 3 else "", "d") for i in range(60)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text(dump(rows[:30], HEADER))
    (tmp_path / "in" / "b.csv").write_text(dump(rows[30:], HEADER))
    append = lambda df, _: project(S.batch_records(df, "dockets").drop("_file", "_record"), "dockets").write.mode("append").parquet(str(tmp_path / "out"))
    stream = S.stream_bulk(spark, str(tmp_path / "in")).writeStream.foreachBatch(append)
    stream.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    batch = project(read_bulk(spark, str(tmp_path / "in"), "dockets"), "dockets")
    key = lambda df: sorted(str(tuple(r)) for r in df.collect())
    assert key(spark.read.schema(batch.schema).parquet(str(tmp_path / "out"))) == key(batch)


def test_one_compressed_dump_is_streamed_by_many_tasks(spark, tmp_path):
    import bz2
    import random

    rng = random.Random(3)
    noise = lambda n: "".join(rng.choice("abcdefgh,\n \"") for _ in range(n))
    rows = [(str(i), "c", f"{i}\n{noise(800)}", "d") for i in range(1, 2500)] + [("7", "c", "last", "d")]
    (tmp_path / "in").mkdir()
    turned = [(r[3], r[0], r[2], r[1]) for r in rows[:50]]
    with bz2.open(tmp_path / "in" / "b.csv.bz2", "wt", newline="", compresslevel=1) as f:
        f.write(dump(rows, HEADER))
    (tmp_path / "in" / "a.csv").write_text(dump(turned, [HEADER[3], HEADER[0], HEADER[2], HEADER[1]]))
    tasks = []
    write = S.batch_writer(S.IngestPaths(str(tmp_path / "lake")), "dockets", "backtick")

    def watched(batch, batch_id):
        tasks.append(batch.where("file like '%.bz2'").select("block").distinct().count())
        write(batch, batch_id)

    spark.conf.set("spark.sql.files.maxPartitionBytes", "200000")
    try:
        stream = S.stream_bulk(spark, str(tmp_path / "in")).writeStream.foreachBatch(watched)
        stream.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert tasks[0] > 2
    got = {r.id: r.case_name for r in S.ingested(spark, str(tmp_path / "lake"), "dockets").collect()}
    assert got == {int(r[0]): r[2] for r in rows}  # the last row of a key in the last file counts


def test_files_without_required_columns_go_to_the_rejects(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text(dump([("1", "c", "n", "d")], HEADER))
    (tmp_path / "in" / "b.csv").write_text(dump([("c", "lost")], [HEADER[1], HEADER[2]]))
    S.ingest(spark, str(tmp_path / "in"), "dockets", str(tmp_path / "lake"), required=["id"])
    assert [r.id for r in S.ingested(spark, str(tmp_path / "lake"), "dockets").collect()] == [1]
    rejects = spark.read.parquet(S.IngestPaths(str(tmp_path / "lake")).rejects("dockets")).collect()
    assert [r.errors for r in rejects] == [["Malformed record"]]


def test_all_windows_and_counters_of_a_stream_come_out(spark, tmp_path):
    """Several micro-batches: open windows are there too, and counters of every batch."""
    at = datetime(2024, 1, 1)
    for k in range(4):
        rows = [(at + timedelta(minutes=30 * k + i), "a" if i % 3 else "error") for i in range(60)]
        spark.createDataFrame(rows, "ts timestamp_ntz, kind string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema("ts timestamp_ntz, kind string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    windows, counters = str(tmp_path / "windows"), str(tmp_path / "counters")
    S.run_keyed(S.throughput(stream(), "ts", "kind"), windows, str(tmp_path / "cp1"))
    got = S.read_keyed(spark, windows, ["window_start", "kind"])
    want = S.throughput(spark.read.parquet(str(tmp_path / "in")), "ts", "kind")
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect()))
    assert got.count() == 6
    S.run_counted(stream(), F.col("kind") != "error", str(tmp_path / "out"), counters, str(tmp_path / "cp2"))
    assert [tuple(r) for r in S.counters(spark, counters).orderBy("batch_id").collect()] == [(k, 60, 40, 20) for k in range(4)]
    assert spark.read.parquet(str(tmp_path / "out")).count() == 240


def test_a_repeated_batch_of_events_is_there_once(spark, tmp_path):
    from docketlake.streaming import audit

    requests = spark.createDataFrame([("a", "u1"), ("b", "u2")], "dataset_id string, download_url string")
    events = audit.download_events(requests, F.lit("2024-01-31").cast("timestamp_ntz"))
    path = str(tmp_path / "log")
    for number in (0, 0, 1):
        audit.append_events(events, path, number)
    log = audit.read_events(spark, path)
    assert log.count() == 4 and {r.event_type for r in log.collect()} == {audit.DOWNLOAD_REQUESTED}
