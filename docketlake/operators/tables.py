"""Tables on plain Parquet, keyed and not, JSON records, and payloads by data set.

A table without a key is a folder of numbered versions: writing makes the next one,
readers take the newest complete one.  A keyed table is partitioned by a hash of its
key, and a change rewrites the buckets it touches by Spark's dynamic partition
overwrite, which swaps them in when the job is done.  A change that was interrupted is
repeated, which leaves the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketlake.schemas import entity
from docketlake.session import stored
from docketlake.sources.files import fill_defaults


def _versions(spark: SparkSession, path: str) -> tuple[list[int], list[int]]:
    """Numbers of all and of complete versions of a table."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return [], []
    seen, complete = [], []
    for status in fs.listStatus(root):
        name = status.getPath().getName()
        if name.startswith("v") and name[1:].isdigit():
            seen.append(int(name[1:]))
            if fs.exists(jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
                complete.append(int(name[1:]))
    return sorted(seen), sorted(complete)


def read_table(spark: SparkSession, path: str) -> DataFrame | None:
    """The rows of a keyed table, else the newest complete version; None for a table that does not exist."""
    if layout(spark, path):
        return _buckets(spark, path).drop(KEY, OF, BUCKET)
    _, complete = _versions(spark, path)
    return spark.read.parquet(f"{path}/v{complete[-1]}") if complete else None


def write_table(df: DataFrame, path: str, cluster_by: list[str] | None = None) -> DataFrame:
    """Write the next version; ``cluster_by`` orders it for point lookups."""
    spark = df.sparkSession
    seen, _ = _versions(spark, path)
    target = f"{path}/v{seen[-1] + 1 if seen else 1}"
    if cluster_by:
        df = df.repartitionByRange(*cluster_by).sortWithinPartitions(*cluster_by)
    df.write.mode("errorifexists").parquet(target)
    return spark.read.parquet(target)


def latest_rows(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The last row per key; each task keeps one row per key before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def merge(old: DataFrame | None, new: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """Old rows with the new ones put in their place; of several new ones the first in ``order`` counts."""
    fresh = latest_rows(new, key, order)
    if old is None:
        return fresh
    kept = old.join(fresh.select(*key), key, "left_anti")
    return kept.unionByName(fresh, allowMissingColumns=True)


# Keyed tables: folders _key=a+b/_of=16/_bucket=3, the key's columns, the number of buckets, and a bucket.
KEY, OF, BUCKET = "_key", "_of", "_bucket"
ROWS_PER_BUCKET = 1_000_000
LEAST_BUCKETS = 16


def layout(spark: SparkSession, path: str) -> tuple[list[str], int] | None:
    """Key columns and number of buckets of a keyed table, from its folders."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return None
    for keyed in fs.globStatus(jvm.org.apache.hadoop.fs.Path(path, f"{KEY}=*/{OF}=*")) or []:
        place = keyed.getPath()
        return place.getParent().getName().split("=", 1)[1].split("+"), int(place.getName().split("=", 1)[1])
    return None


def _buckets(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("mergeSchema", "true").parquet(path)


def _in_buckets(df: DataFrame, key: list[str], number: int) -> DataFrame:
    bucket = F.pmod(F.xxhash64(*key), F.lit(number)).cast("int")
    return df.withColumns({KEY: F.lit("+".join(key)), OF: F.lit(number), BUCKET: bucket})


def _write_buckets(df: DataFrame, path: str) -> None:
    writer = df.repartition(BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(KEY, OF, BUCKET).parquet(path)
    df.sparkSession.catalog.refreshByPath(path)


def upsert(
    path: str,
    new: DataFrame,
    key: list[str],
    order: list[Column],
    drop: tuple[str, ...] = (),
    buckets: int | None = None,
) -> DataFrame:
    """Insert or replace records by key and return the new table; ``order`` says which of several new ones counts.

    Only buckets that hold a new key are read and written, unless the new rows have a
    column the table lacks.  The number of ``buckets`` is set when the table is made: by
    the caller, else by the number of rows.
    """
    if not order:
        raise ValueError("An upsert needs an order: without one, which of several rows with a key counts is arbitrary")
    spark = new.sparkSession
    fresh = latest_rows(new, key, order).drop(*drop)
    known = layout(spark, path)
    if known is None:
        fresh = stored(fresh, "upsert")
        number = buckets or max(LEAST_BUCKETS, -(-fresh.count() // ROWS_PER_BUCKET))
        _write_buckets(_in_buckets(fresh, key, number), path)
        return read_table(spark, path)
    if known[0] != key:
        raise ValueError(f"The table at {path} is keyed by {known[0]}")
    table = _buckets(spark, path)
    types = {f.name: f.dataType for f in table.schema}
    fresh = fresh.select(*[F.col(f"`{c}`").cast(types[c]) if c in types else F.col(f"`{c}`") for c in fresh.columns])
    fresh = stored(_in_buckets(fresh, key, known[1]), "upsert")
    if set(fresh.columns) <= set(types):
        # At most one number per bucket reaches the driver.
        touched = [r[0] for r in fresh.select(BUCKET).distinct().collect()]
        table = table.where(F.col(BUCKET).isin(touched))
    kept = table.join(fresh.select(*key), key, "left_anti")
    _write_buckets(kept.unionByName(fresh, allowMissingColumns=True), path)
    return read_table(spark, path)


def delete(path: str, keys: DataFrame) -> DataFrame:
    """Remove the records whose columns occur in ``keys``; with the table's key, only buckets that hold one are written."""
    spark = keys.sparkSession
    known = layout(spark, path)
    if known is None:
        raise ValueError(f"No keyed table at {path}")
    key, number = known
    table = _buckets(spark, path)
    gone = keys.select(*[F.col(c).cast(table.schema[c].dataType).alias(c) for c in keys.columns]).distinct()
    gone = stored(gone, "delete")
    if set(keys.columns) == set(key):
        touched = [r[0] for r in _in_buckets(gone, key, number).select(BUCKET).distinct().collect()]
        table = table.where(F.col(BUCKET).isin(touched))
    else:
        touched = [r[0] for r in table.select(BUCKET).distinct().collect()]
    left = stored(without(table, gone), "left")
    _write_buckets(left, path)
    # A bucket without rows has nothing that could replace it.
    empty = set(touched) - {r[0] for r in left.select(BUCKET).distinct().collect()}
    jvm = spark.sparkContext._jvm
    for bucket in empty:
        place = jvm.org.apache.hadoop.fs.Path(path, f"{KEY}={'+'.join(key)}/{OF}={number}/{BUCKET}={bucket}")
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    spark.catalog.refreshByPath(path)
    return read_table(spark, path)


def without(table: DataFrame, keys: DataFrame) -> DataFrame:
    return table.join(keys.distinct(), keys.columns, "left_anti")


def citation_key() -> Column:
    """Text key of a citation: citing and cited opinion."""
    return F.concat_ws("_", "citing_opinion_id", "cited_opinion_id")


# JSON records -----------------------------------------------------------------

JSON_OPTIONS = {
    "dateFormat": "yyyy-MM-dd",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]",
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]",
}


def to_json_text(df: DataFrame, name: str = "json") -> DataFrame:
    """One JSON text per row, NULLs included."""
    return df.select(F.to_json(F.struct("*"), {**JSON_OPTIONS, "ignoreNullFields": "false"}).alias(name))


def from_json_text(df: DataFrame, schema: T.StructType, name: str = "json", data_type: str | None = None) -> DataFrame:
    """Rows from JSON texts; absent fields get the entity's defaults."""
    rows = df.select(F.from_json(name, schema, JSON_OPTIONS).alias("r")).select("r.*")
    return fill_defaults(rows, entity(data_type)) if data_type else rows


def write_json(df: DataFrame, path: str) -> None:
    """Gzipped JSON lines."""
    df.write.mode("overwrite").options(compression="gzip", ignoreNullFields="false", **JSON_OPTIONS).json(path)


# Payloads per data set --------------------------------------------------------


def save_payload(df: DataFrame, path: str, dataset_id: str | None = None) -> None:
    """Replace the payload of the data sets in ``df`` and leave the others alone."""
    if dataset_id is not None:
        df = df.withColumn("dataset_id", F.lit(dataset_id))
    (
        df.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("dataset_id")
        .parquet(path)
    )


def load_payload(spark: SparkSession, path: str, dataset_id: str) -> DataFrame:
    return spark.read.parquet(path).where(F.col("dataset_id") == dataset_id)


def delete_payload(spark: SparkSession, path: str, dataset_id: str) -> bool:
    """Remove the payload of one data set and leave the others alone; whether there was one."""
    jvm = spark.sparkContext._jvm
    name = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(dataset_id)
    place = jvm.org.apache.hadoop.fs.Path(path, f"dataset_id={name}")
    gone = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    spark.catalog.refreshByPath(path)
    return gone


def list_datasets(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select(F.col("dataset_id").cast("string")).distinct()
