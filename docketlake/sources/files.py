"""Directories of JSON records, and file listings as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketlake.functions.text import entity_of_file
from docketlake.schemas import Entity, entity


def read_json_records(
    spark: SparkSession, path: str | list[str], data_type: str | None = None, schema: T.StructType | None = None
) -> DataFrame:
    """One record per (optionally gzipped) JSON file; unreadable files are left to ``unreadable_files``.

    Absent fields get the entity's defaults, so that a partial record still
    comes back with False, 0 and empty lists where they belong.
    """
    e: Entity | None = entity(data_type) if data_type else None
    df = _json(spark, path, schema or e.schema(), "DROPMALFORMED")
    return fill_defaults(df, e) if e else df


def unreadable_files(
    spark: SparkSession, path: str | list[str], data_type: str | None = None, schema: T.StructType | None = None
) -> DataFrame:
    """``path, text`` of the JSON files that ``read_json_records`` cannot read."""
    wanted = T.StructType([*(schema or entity(data_type).schema()).fields, T.StructField("_text", T.StringType())])
    rows = _json(spark, path, wanted, "PERMISSIVE").select(F.col("_metadata.file_path").alias("path"), "*")
    # Which columns are read decides what is malformed, so all are, and stay needed.
    kept = F.to_json(F.struct(*[F.col(f"`{f.name}`") for f in wanted.fields[:-1]]))
    whole = rows.withColumn("_kept", F.length(F.coalesce(kept, F.lit(""))))
    return whole.where((F.col("_kept") >= 0) & F.col("_text").isNotNull()).select("path", F.col("_text").alias("text"))


def _json(spark: SparkSession, path: str | list[str], schema: T.StructType, mode: str) -> DataFrame:
    reader = spark.read.schema(schema).option("mode", mode).option("columnNameOfCorruptRecord", "_text")
    return reader.json(path, multiLine=True, dateFormat="yyyy-MM-dd")


def fill_defaults(df: DataFrame, e: Entity) -> DataFrame:
    filled = {}
    for f in e.fields:
        if f.kind == "longs":
            filled[f.name] = F.coalesce(f.name, F.array().cast("array<bigint>"))
        elif f.default is not None:
            filled[f.name] = F.coalesce(f.name, F.lit(f.default))
    return df.withColumns(filled) if filled else df


def file_manifest(
    spark: SparkSession, path: str | list[str], dataset_id: str, status: DataFrame | None = None
) -> DataFrame:
    """Files below a path: size, entity type, status and error text.

    Contents are not read.  ``status`` has ``path, status, error_message``; a
    file it does not name is pending.
    """
    listing = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(path)
        .select("path", F.col("length").alias("size"), "modificationTime")
    )
    if status is None:
        known = listing.withColumns({"status": F.lit("pending"), "error_message": F.lit(None).cast("string")})
    else:
        known = listing.join(status.select("path", "status", "error_message"), "path", "left").withColumn(
            "status", F.coalesce("status", F.lit("pending"))
        )
    return known.withColumns({"dataset_id": F.lit(dataset_id), "data_type": entity_of_file(F.col("path"))})
