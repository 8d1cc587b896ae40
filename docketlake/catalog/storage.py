"""Keyed tables, JSON round trips and payloads."""

from pyspark.sql import functions as F

from docketlake.catalog.registry import CITATIONS, citations, courts, day, flag, query, table, text
from docketlake.operators import tables as T
from docketlake.session import scratch_path

ORDER_ROWS = "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders"


def _orders(spark, folder):
    return table(spark, folder, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")


@query(
    "b1_upsert",
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'done' ELSE o_orderstatus END AS o_orderstatus,
         CASE WHEN o_orderstatus = 'P' THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders""",
)
def upsert(spark, folder):
    path = scratch_path(spark, "orders")
    orders = _orders(spark, folder)
    T.upsert(path, orders, ["o_orderkey"], [F.col("o_totalprice")])
    pending = orders.where("o_orderstatus = 'P'").withColumn("o_orderstatus", F.lit("done"))
    # Two updates per key: the one with the larger price is the later one.
    changes = pending.unionByName(pending.withColumn("o_totalprice", F.col("o_totalprice") + 1))
    return T.upsert(path, changes, ["o_orderkey"], [F.col("o_totalprice").desc()])


@query(
    "b2_citation_key",
    f"""WITH {CITATIONS} SELECT CAST(citing_opinion_id AS VARCHAR) || '_' || CAST(cited_opinion_id AS VARCHAR) AS citation_key,
          max(depth) AS depth FROM citations GROUP BY citing_opinion_id, cited_opinion_id""",
)
def citation_key(spark, folder):
    rows = T.latest_rows(citations(spark, folder), ["citing_opinion_id", "cited_opinion_id"], [F.col("depth").desc()])
    return rows.select(T.citation_key().alias("citation_key"), "depth")


@query("b3_delete", ORDER_ROWS + " WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def delete(spark, folder):
    path = scratch_path(spark, "orders")
    T.upsert(path, _orders(spark, folder), ["o_orderkey"], [F.col("o_totalprice")])
    returned = table(spark, folder, "lineitem").where("l_returnflag = 'R'")
    return T.delete(path, returned.select(F.col("l_orderkey").alias("o_orderkey")))


@query(
    "b4_json_round_trip",
    """SELECT o_orderkey AS id, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS date_filed, o_totalprice AS amount,
         CAST(o_orderstatus = 'F' AS INTEGER) AS blocked,
         '{"id":' || CAST(o_orderkey AS VARCHAR) || ',"date_filed":"' || CAST(CAST(o_orderdate AS DATE) AS VARCHAR) || '","note":null}' AS json
       FROM orders""",
)
def json_round_trip(spark, folder):
    orders = table(spark, folder, "orders")
    rows = orders.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_orderdate").cast("date").alias("date_filed"),
        F.col("o_totalprice").alias("amount"),
        (F.col("o_orderstatus") == "F").alias("blocked"),
    )
    back = T.from_json_text(T.to_json_text(rows), rows.schema)
    short = T.to_json_text(rows.select("id", "date_filed", F.lit(None).cast("string").alias("note")))
    short = short.withColumn("id", F.get_json_object("json", "$.id").cast("bigint"))
    return back.join(short, "id").select(
        "id", day("date_filed").alias("date_filed"), "amount", flag(F.col("blocked")).alias("blocked"), "json"
    )


@query(
    "b4_json_defaults",
    "SELECT o_orderkey AS id, 0 AS blocked, 0 AS citation_count, 0 AS sub_opinions FROM orders",
)
def json_defaults(spark, folder):
    from docketlake.schemas import entity

    rows = table(spark, folder, "orders").select(F.col("o_orderkey").alias("id"))
    back = T.from_json_text(T.to_json_text(rows), entity("opinion_clusters").schema(), data_type="opinion_clusters")
    return back.select(
        "id", flag(F.col("blocked")).alias("blocked"), "citation_count", F.size("sub_opinions").alias("sub_opinions")
    )


@query("b5_write_json", ORDER_ROWS)
def write_json(spark, folder):
    path = scratch_path(spark, "orders-json")
    orders = _orders(spark, folder)
    T.write_json(orders, path)
    return spark.read.schema(orders.schema).json(path)


@query(
    "b6_payload_of_dataset",
    "SELECT doc_id, CASE WHEN source = 'src3' THEN 0 ELSE n_chars END AS n_chars, source AS dataset_id FROM documents WHERE source IN ('src3', 'src4')",
)
def payload(spark, folder):
    path = scratch_path(spark, "payloads")
    docs = table(spark, folder, "documents").select("doc_id", "n_chars", F.col("source").alias("dataset_id"))
    T.save_payload(docs, path)
    again = docs.where("dataset_id = 'src3'").withColumn("n_chars", F.lit(0).cast("bigint"))
    T.save_payload(again, path)
    rows = [T.load_payload(spark, path, d) for d in ("src3", "src4")]
    return rows[0].unionByName(rows[1]).withColumn("dataset_id", text("dataset_id"))


@query("b6_list_datasets", "SELECT DISTINCT source AS dataset_id FROM documents")
def list_datasets(spark, folder):
    path = scratch_path(spark, "payloads")
    T.save_payload(table(spark, folder, "documents").select("doc_id", F.col("source").alias("dataset_id")), path)
    return T.list_datasets(spark, path)


@query("b6_delete_payload", "SELECT doc_id, source AS dataset_id FROM documents WHERE source <> 'src3'")
def delete_payload(spark, folder):
    path = scratch_path(spark, "payloads")
    docs = table(spark, folder, "documents").select("doc_id", F.col("source").alias("dataset_id"))
    T.save_payload(docs, path)
    T.delete_payload(spark, path, "src3")
    return spark.read.schema(docs.schema).parquet(path)


@query(
    "b7_save_records_batch",
    "SELECT record_id, count(*) AS n FROM (SELECT CAST(o_custkey AS VARCHAR) AS record_id FROM orders GROUP BY o_custkey) GROUP BY record_id",
)
def save_records_batch(spark, folder):
    path = scratch_path(spark, "records")
    rows = table(spark, folder, "orders").select(text("o_custkey").alias("record_id"), "o_orderkey")
    stored = T.upsert(path, rows, ["record_id"], [F.col("o_orderkey").desc()])
    return stored.groupBy("record_id").agg(F.count("*").alias("n"))
