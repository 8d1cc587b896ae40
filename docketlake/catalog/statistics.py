"""Counts, storage figures, the inverted index and volumes."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketlake.catalog.registry import (
    CLUSTERS,
    COURTS,
    DOCKETS,
    IMPORT_LOG,
    MANIFEST,
    OPINIONS,
    clusters,
    courts,
    dockets,
    import_log,
    manifest,
    opinions,
    query,
    table,
)
from docketlake.operators import index as I
from docketlake.operators import stats as S
from docketlake.operators.progress import overall_progress
from docketlake.session import scratch_path
from docketlake.sources.files import file_manifest


def _tables(spark, folder):
    return {
        "courts": courts(spark, folder),
        "dockets": dockets(spark, folder),
        "opinion_clusters": clusters(spark, folder),
        "opinions": opinions(spark, folder),
    }


@query(
    "h1_entity_counts",
    f"""WITH {COURTS}, {DOCKETS}, {CLUSTERS}, {OPINIONS} SELECT 'courts' AS data_type, count(*) AS records FROM courts
        UNION ALL SELECT 'dockets', count(*) FROM dockets UNION ALL SELECT 'opinion_clusters', count(*) FROM clusters
        UNION ALL SELECT 'opinions', count(*) FROM opinions""",
)
def entity_counts(spark, folder):
    return S.entity_counts(_tables(spark, folder))


@query(
    "h2_storage_stats",
    f"""WITH {COURTS}, {DOCKETS}, {CLUSTERS}, {OPINIONS},
        sizes AS (
          SELECT 'courts' AS data_type, CAST(sum(strlen(id) + 1) AS BIGINT) AS bytes, count(*) AS records,
            'citation_string,full_name,id,jurisdiction,position,short_name' AS fields FROM courts
          UNION ALL SELECT 'dockets', CAST(sum(strlen(CAST(id AS VARCHAR)) + 1) AS BIGINT), count(*),
            'balance,case_name,court_id,docket_number,id,source' FROM dockets
          UNION ALL SELECT 'opinion_clusters', CAST(sum(strlen(CAST(id AS VARCHAR)) + 1) AS BIGINT), count(*),
            'amount,blocked,case_name,date_filed,docket_id,id,precedential_status' FROM clusters
          UNION ALL SELECT 'opinions', CAST(sum(strlen(CAST(id AS VARCHAR)) + 1) AS BIGINT), count(*),
            'cluster_id,id,pages,type' FROM opinions)
        SELECT * FROM sizes UNION ALL SELECT '(all)', CAST(sum(bytes) AS BIGINT), NULL, NULL FROM sizes""",
)
def storage_stats(spark, folder):
    """Sizes of files written from all ids of the four entities."""
    path, tables = scratch_path(spark, "stored"), _tables(spark, folder)
    for name, rows in tables.items():
        rows.select(F.col("id").cast("string").alias("value")).write.text(f"{path}/{name}")
    files = file_manifest(spark, path, "tables").withColumn("data_type", F.element_at(F.split("path", "/"), -2))
    rows = S.storage_stats(tables, files)
    return rows.select("data_type", "bytes", "records", F.array_join(F.array_sort("fields"), ",").alias("fields"))


@query("h2_storage_stats_of_files")
def storage_stats_of_files(spark, folder):
    files = file_manifest(spark, folder, "tables")
    return S.storage_stats({"courts": courts(spark, folder)}, files).select("data_type", "bytes", "records")


CLUSTER_CELLS = f"""{CLUSTERS}, cells AS (
  SELECT id, 'precedential_status' AS field, precedential_status AS value FROM clusters
  UNION ALL SELECT id, 'blocked', CASE WHEN blocked THEN 'True' ELSE 'False' END FROM clusters
  UNION ALL SELECT id, 'date_filed', CAST(date_filed AS VARCHAR) FROM clusters
  UNION ALL SELECT id, 'docket_id', CAST(docket_id AS VARCHAR) FROM clusters)"""
INDEX_FIELDS = ["precedential_status", "blocked", "date_filed", "docket_id"]


@query(
    "h3_inverted_index",
    f"""WITH {CLUSTER_CELLS} SELECT field, value, count(*) AS n_ids, min(id) AS first_id, max(id) AS last_id, CAST(sum(id) AS BIGINT) AS id_sum
        FROM cells GROUP BY field, value""",
)
def inverted_index(spark, folder):
    rows = I.inverted_index(clusters(spark, folder), "id", INDEX_FIELDS)
    total = F.aggregate("ids", F.lit(0).cast("bigint"), lambda s, v: s + v)
    return (
        rows.select("field", "value", "n_ids", F.array_min("ids").alias("lo"), F.array_max("ids").alias("hi"), total.alias("s"))
        .groupBy("field", "value")
        .agg(
            F.sum("n_ids").alias("n_ids"),
            F.min("lo").alias("first_id"),
            F.max("hi").alias("last_id"),
            F.sum("s").alias("id_sum"),
        )
    )


@query("h3_index_rows", f"WITH {CLUSTER_CELLS} SELECT field, value, id FROM cells")
def index_rows(spark, folder):
    return I.postings(clusters(spark, folder), "id", INDEX_FIELDS)


@query("h3_index_sizes", f"WITH {CLUSTER_CELLS} SELECT field, value, count(*) AS n_ids FROM cells GROUP BY field, value")
def index_sizes(spark, folder):
    return I.index_sizes(clusters(spark, folder), "id", INDEX_FIELDS)


@query(
    "h4_find_by_field",
    """SELECT 'short' AS kind, doc_id FROM documents WHERE source = 'src7'
       UNION ALL SELECT 'long', doc_id FROM documents WHERE text = (SELECT text FROM documents WHERE doc_id = 5)
       UNION ALL SELECT 'cut', doc_id FROM documents WHERE substr(text, 1, 100) = (SELECT substr(text, 1, 100) FROM documents WHERE doc_id = 5)
       UNION ALL SELECT 'number', doc_id FROM documents WHERE n_chars = 500""",
)
def find_by_field(spark, folder):
    docs = table(spark, folder, "documents")
    wanted = docs.where("doc_id = 5").select("text").head()[0]
    parts = [
        I.find_by_field(docs, field, value, length).select(F.lit(kind).alias("kind"), "doc_id")
        for kind, field, value, length in (
            ("short", "source", "src7", None),
            ("long", "text", wanted, None),
            ("cut", "text", wanted, 100),
            ("number", "n_chars", 500, None),
        )
    ]
    return reduce(DataFrame.unionByName, parts)


@query("h4_index_lookup", f"WITH {CLUSTERS} SELECT id FROM clusters WHERE precedential_status = 'Errata'")
def index_lookup(spark, folder):
    path = scratch_path(spark, "index")
    I.write_index(clusters(spark, folder), path, "id", INDEX_FIELDS)
    return I.index_lookup(spark.read.parquet(path), "precedential_status", "Errata")


@query(
    "h4_index_after_changes",
    f"""WITH {CLUSTERS}, now AS (SELECT id, CASE WHEN id % 3 = 0 THEN 'Errata' WHEN id % 3 = 1 AND id % 7 = 0 THEN 'Published' ELSE precedential_status END AS status
          FROM clusters UNION ALL SELECT -1, 'Errata')
        SELECT 'Errata' AS status, id FROM now WHERE status = 'Errata' UNION ALL SELECT 'Published', id FROM now WHERE status = 'Published'""",
)
def index_after_changes(spark, folder):
    """Lookups in an index that followed two batches of changes."""
    index, changes = scratch_path(spark, "index"), scratch_path(spark, "changes")
    rows = clusters(spark, folder).select("id", "case_name", "precedential_status")
    I.write_index(rows, index, "id")
    third = rows.where("id % 3 = 0").withColumn("precedential_status", F.lit("Errata"))
    added = spark.createDataFrame([(-1, "new", "Published")], rows.schema)
    third.unionByName(added).write.parquet(f"{changes}/batch_id=0")
    I.update_index(spark, index, changes, "id")
    later = rows.where("id % 7 = 0 AND id % 3 = 1").withColumn("precedential_status", F.lit("Published"))
    again = added.withColumn("precedential_status", F.lit("Errata"))
    later.unionByName(again).write.parquet(f"{changes}/batch_id=1")
    I.update_index(spark, index, changes, "id")
    found = [
        I.current_lookup(spark, index, changes, "precedential_status", s).select(F.lit(s).alias("status"), "id")
        for s in ("Errata", "Published")
    ]
    return found[0].unionByName(found[1])


@query(
    "h5_rebuild_index",
    f"""WITH {CLUSTERS} SELECT value, count(*) AS n_ids FROM (SELECT CASE WHEN blocked THEN 'Published' ELSE precedential_status END AS value FROM clusters) GROUP BY value""",
)
def rebuild_index(spark, folder):
    from docketlake.operators.tables import read_table, upsert

    path = scratch_path(spark, "clusters")
    rows = clusters(spark, folder)
    upsert(path, rows, ["id"], [F.col("date_filed")])
    upsert(path, rows.where("blocked").withColumn("precedential_status", F.lit("Published")), ["id"], [F.col("date_filed")])
    index = I.inverted_index(read_table(spark, path), "id", ["precedential_status"])
    return index.groupBy("value").agg(F.sum("n_ids").alias("n_ids"))


@query(
    "h6_import_totals",
    f"""WITH {IMPORT_LOG} SELECT coalesce(data_type, '(all)') AS data_type, CAST(sum(imported) AS BIGINT) AS imported, CAST(sum(errors) AS BIGINT) AS errors
        FROM import_log GROUP BY ROLLUP (data_type)""",
)
def import_totals(spark, folder):
    return S.import_totals(import_log(spark, folder))


SPEEDS = f"""{IMPORT_LOG}, steps AS (
  SELECT *, epoch_us(ts) - lag(epoch_us(ts)) OVER w AS us, processed - lag(processed) OVER w AS done
  FROM import_log WINDOW w AS (PARTITION BY data_type ORDER BY ts, processed)),
speeds AS (SELECT *, CASE WHEN us > 0 THEN done / (us / 1e6) END AS speed FROM steps),
averages AS (SELECT *, list(speed) FILTER (WHERE speed IS NOT NULL) OVER (PARTITION BY data_type ORDER BY ts, processed
    ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS s FROM speeds),
progress AS (SELECT *, CASE WHEN s IS NULL OR len(s) = 0 THEN 0.0
    ELSE list_sum(list_transform(s, lambda v, i: v * i)) / (len(s) * (len(s) + 1) / 2) END AS avg_speed FROM averages)"""


@query(
    "h7_overall_progress",
    f"""WITH {SPEEDS}, state AS (SELECT *, row_number() OVER (PARTITION BY data_type ORDER BY ts DESC, processed DESC) AS r FROM progress)
        SELECT CAST(sum(processed) AS BIGINT) AS total_processed, CAST(sum(imported) AS BIGINT) AS total_imported, CAST(sum(errors) AS BIGINT) AS total_errors,
          round(sum(processed) * 100.0 / sum(estimated_total), 6) AS overall_percent, round(sum(avg_speed), 6) AS overall_speed,
          CAST(sum(CASE WHEN status = 'processing' AND avg_speed > 0 THEN floor((estimated_total - processed) / avg_speed) END) AS BIGINT) AS overall_eta_seconds
        FROM state WHERE r = 1""",
)
def overall(spark, folder):
    rows = overall_progress(import_log(spark, folder))
    return rows.withColumns({c: F.round(c, 6) for c in ("overall_percent", "overall_speed")})


@query(
    "h8_volume_estimate",
    """SELECT doc_id, CASE lang WHEN 'en' THEN CAST(floor(n_chars / 1100.0) AS BIGINT) WHEN 'de' THEN CAST(floor(n_chars / 2100.0) AS BIGINT)
         WHEN 'fr' THEN CAST(floor(n_chars / 225.0) AS BIGINT) ELSE 2000 END AS estimate FROM documents""",
)
def volume_estimate(spark, folder):
    lang = F.col("lang")
    kind = F.when(lang == "en", "dockets").when(lang == "de", "opinions").when(lang == "fr", "citations").otherwise("courts")
    return table(spark, folder, "documents").select("doc_id", S.estimated_records(kind, F.col("n_chars")).alias("estimate"))


@query(
    "h9_volume_count",
    """SELECT count(*) AS data_lines, count(*) FILTER (WHERE lang = 'en') AS valid_rows, count(*) FILTER (WHERE lang = 'en') AS estimated_valid,
         round(count(*) FILTER (WHERE lang = 'en') / count(*), 6) AS valid_ratio FROM documents""",
)
def volume_count(spark, folder):
    rows = S.volume(table(spark, folder, "documents"), F.col("lang") == "en")
    return rows.select("data_lines", "valid_rows", "estimated_valid", F.round("valid_ratio", 6).alias("valid_ratio"))


@query(
    "h10_manifest_totals",
    f"WITH {MANIFEST} SELECT dataset_id, count(*) AS files, CAST(sum(size) AS BIGINT) AS total_size FROM manifest GROUP BY dataset_id",
)
def manifest_totals(spark, folder):
    return S.manifest_totals(manifest(spark, folder))


@query("h11_events_by_type", "SELECT event_type, count(*) AS n_events FROM events GROUP BY event_type")
def events_by_type(spark, folder):
    return S.events_by_type(table(spark, folder, "events"))


@query("h11_events_of", "SELECT event_id, event_type FROM events WHERE user_id = 8 AND event_type = 'error'")
def events_of(spark, folder):
    rows = table(spark, folder, "events").withColumn("aggregate_id", F.col("user_id").cast("string"))
    return S.events_of(rows, aggregate_id="8", event_type="error").select("event_id", "event_type")
