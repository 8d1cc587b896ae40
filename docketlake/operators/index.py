"""Inverted index: field, value and the ids that have it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketlake.functions.text import index_key

# Fields left out of the index.
UNINDEXED = ("date_created", "date_modified")

BLOCK_IDS = 1 << 20  # ids in one posting list


def postings(
    df: DataFrame, id_column: str = "id", fields: list[str] | None = None, key_length: int | None = None
) -> DataFrame:
    """Flat index rows ``field, value, id``; NULL values are not indexed.

    Values are whole; ``key_length`` cuts them, which older indexes did at 100.
    """
    names = [c for c in (fields or df.columns) if c not in UNINDEXED]
    cells = F.array(
        *[
            F.struct(F.lit(n).alias("field"), index_key(F.col(n), df.schema[n].dataType, key_length).alias("value"))
            for n in names
        ]
    )
    present = F.filter(cells, lambda c: c["value"].isNotNull())
    return df.select(F.col(id_column).alias("id"), F.explode(present).alias("cell")).select(
        "cell.field", "cell.value", "id"
    )


def _block(df: DataFrame, id_column: str) -> Column:
    """Number ids go to blocks of consecutive ids, others to as many hash blocks as the table's rows need."""
    if isinstance(df.schema[id_column].dataType, T.IntegralType):
        return F.floor(F.col("id") / BLOCK_IDS)
    return F.pmod(F.xxhash64("id"), F.lit(max(1, -(-df.count() // BLOCK_IDS))))


def inverted_index(
    df: DataFrame, id_column: str = "id", fields: list[str] | None = None, key_length: int | None = None
) -> DataFrame:
    """Sorted posting lists per field and value, one per block of ids.

    A value that a third of all rows share is spread over its id blocks, so no
    list grows with the table.
    """
    flat = postings(df, id_column, fields, key_length)
    return (
        flat.groupBy("field", "value", _block(df, id_column).alias("id_block"))
        .agg(F.sort_array(F.collect_set("id")).alias("ids"))
        .withColumn("n_ids", F.size("ids"))
    )


def write_index(
    df: DataFrame, path: str, id_column: str = "id", fields: list[str] | None = None, batch_id: int = -1
) -> None:
    """Store the index by field, sorted by value, so that a lookup reads one field's row groups around the value.

    ``batch_id`` -1 is the index of a whole table, others are those of its changes.
    """
    index = inverted_index(df, id_column, fields).withColumn("batch_id", F.lit(batch_id))
    order = ["field", "value", "id_block"]
    placed = index.repartitionByRange(*order).sortWithinPartitions(*order)
    writer = placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("batch_id", "field").parquet(path)


def update_index(
    spark: SparkSession, path: str, changes: str, id_column: str = "id", fields: list[str] | None = None
) -> list[int]:
    """Index the batches of a folder of changes (``batch_id=n``) that are not indexed yet, and return their numbers.

    Only the changed records are read.  A batch that was indexed half-way is indexed again.
    """
    done = {r[0] for r in spark.read.parquet(path).select("batch_id").distinct().collect()}
    there = {r[0] for r in spark.read.parquet(changes).select("batch_id").distinct().collect()}
    new = sorted(there - done)
    for number in new:
        write_index(spark.read.parquet(f"{changes}/batch_id={number}"), path, id_column, fields, number)
    return new


def current_lookup(
    spark: SparkSession, path: str, changes: str, field: str, value: str, id_column: str = "id"
) -> DataFrame:
    """Ids that have the value now: a posting counts unless a later batch changed its record."""
    hit = (F.col("field") == field) & (F.col("value") == value)
    hits = spark.read.parquet(path).where(hit).select("batch_id", F.explode("ids").alias("id"))
    changed = spark.read.parquet(changes).select(F.col(id_column).alias("id"), F.col("batch_id").alias("changed"))
    # Batches of changes only, and of those only the ids that were found.
    last = changed.join(hits.select("id").distinct(), "id", "left_semi").groupBy("id").agg(F.max("changed").alias("changed"))
    current = hits.join(last, "id", "left").where(F.col("changed").isNull() | (F.col("batch_id") == F.col("changed")))
    return current.select("id").distinct()


def index_sizes(df: DataFrame, id_column: str = "id", fields: list[str] | None = None) -> DataFrame:
    """Number of rows per field and value."""
    return postings(df, id_column, fields).groupBy("field", "value").agg(F.count(F.lit(1)).alias("n_ids"))


def index_lookup(index: DataFrame, field: str, value: str, key_length: int | None = None) -> DataFrame:
    """Ids from a stored index; ``key_length`` as the index was built with."""
    hit = (F.col("field") == field) & (F.col("value") == value[:key_length])
    return index.where(hit).select(F.explode("ids").alias("id"))


def find_by_field(df: DataFrame, field: str, value: object, key_length: int | None = None) -> DataFrame:
    """Rows whose value equals the given one, or does so in the first ``key_length`` characters.

    Plain equality wherever that is the same, because it reaches the scan.
    """
    if field not in df.columns:
        return df.limit(0)
    data_type = df.schema[field].dataType
    text = value if isinstance(value, str) else str(value)
    if isinstance(data_type, T.StringType) and (key_length is None or len(text) < key_length):
        return df.where(F.col(field) == text)
    if isinstance(data_type, T.IntegralType) and not isinstance(value, str):
        return df.where(F.col(field) == value)
    return df.where(index_key(F.col(field), data_type, key_length) == text[:key_length])


def courts_named(courts: DataFrame, query: str) -> DataFrame:
    """Courts whose full name or jurisdiction is the query, each once."""
    return find_by_field(courts, "full_name", query).unionByName(
        find_by_field(courts, "jurisdiction", query)
    ).dropDuplicates(["id"])


def dockets_named(dockets: DataFrame, case_name: str) -> DataFrame:
    return find_by_field(dockets, "case_name", case_name)
