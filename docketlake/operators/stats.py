"""Counts, storage statistics and volume figures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketlake.operators.index import UNINDEXED

# Bytes per record and record counts used for estimates.
BYTES_PER_RECORD = {"dockets": 1100, "opinions": 2100, "citations": 225}
USUAL_RECORDS = {"courts": 2000, "people": 10000}


def entity_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows per entity."""
    counts = [
        df.agg(F.count(F.lit(1)).alias("records")).select(F.lit(name).alias("data_type"), "records")
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, counts)


def indexed_fields(df: DataFrame) -> DataFrame:
    """One row: the number of records and the fields with any value in them."""
    names = [c for c in df.columns if c not in UNINDEXED]
    filled = df.agg(
        F.count(F.lit(1)).alias("records"),
        *[F.max(F.col(n).isNotNull()).alias(f"_has_{i}") for i, n in enumerate(names)],
    )
    present = F.array(*[F.when(F.col(f"_has_{i}"), F.lit(n)) for i, n in enumerate(names)])
    return filled.select("records", F.filter(present, lambda n: n.isNotNull()).alias("fields"))


def storage_stats(tables: dict[str, DataFrame], manifest: DataFrame) -> DataFrame:
    """Records, bytes and indexed fields per entity, and all bytes as ``(all)``.

    ``manifest`` has ``data_type, size``.
    """
    per = reduce(
        DataFrame.unionByName,
        [indexed_fields(df).select(F.lit(n).alias("data_type"), "*") for n, df in tables.items()],
    )
    sizes = manifest.rollup("data_type").agg(F.sum("size").alias("bytes")).withColumn(
        "data_type", F.coalesce("data_type", F.lit("(all)"))
    )
    return sizes.join(per, "data_type", "left")


def manifest_totals(manifest: DataFrame) -> DataFrame:
    return manifest.groupBy("dataset_id").agg(
        F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("total_size")
    )


def import_totals(log: DataFrame) -> DataFrame:
    """Imported and failed records per type, and over all types as ``(all)``.

    ``log`` has ``data_type, imported, errors`` per finished import.
    """
    return (
        log.rollup("data_type")
        .agg(F.sum("imported").alias("imported"), F.sum("errors").alias("errors"))
        .withColumn("data_type", F.coalesce("data_type", F.lit("(all)")))
    )


def estimated_records(data_type: Column, size: Column) -> Column:
    """Records to expect in a file of a type and compressed size."""
    out = F.lit(None).cast("bigint")
    for name, n in USUAL_RECORDS.items():
        out = F.when(data_type == name, F.lit(n).cast("bigint")).otherwise(out)
    for name, per in BYTES_PER_RECORD.items():
        out = F.when(data_type == name, F.floor(size / per)).otherwise(out)
    return out


def volume(lines: DataFrame, valid: Column) -> DataFrame:
    """Lines, valid ones and their ratio; all lines are counted, so the estimate is exact."""
    counts = lines.agg(F.count(F.lit(1)).alias("data_lines"), F.count_if(valid).alias("valid_rows"))
    ratio = F.when(F.col("data_lines") > 0, F.col("valid_rows") / F.col("data_lines")).otherwise(F.lit(0.0))
    return counts.withColumns({"valid_ratio": ratio, "estimated_valid": F.col("valid_rows")})


def events_by_type(events: DataFrame) -> DataFrame:
    return events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n_events"))


def events_of(events: DataFrame, aggregate_id: str | None = None, event_type: str | None = None) -> DataFrame:
    """Audit events of one record or data set, or of one type."""
    out = events
    if aggregate_id is not None:
        out = out.where(F.col("aggregate_id") == aggregate_id)
    return out.where(F.col("event_type") == event_type) if event_type is not None else out
