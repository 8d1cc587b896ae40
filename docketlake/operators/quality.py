"""Header checks, parse statistics, error reports and manifest checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docketlake.functions.text import present
from docketlake.schemas import entity
from docketlake.sources.bulk import file_headers, read_header

# Messages and limits of the checks.
NO_FILES = "Dataset must contain at least one data file"
TOO_LARGE = "Dataset size exceeds 1GB limit"  # the message names the limit the checks had first
EMPTY_PATH = "Data file path cannot be empty"
EMPTY_FILE = "Data file is empty"
NO_FILES_REASON = "No data files in dataset"
ERROR_FILES_REASON = "Dataset contains files with errors"
NOT_DOWNLOADED_REASON = "Not all files have been downloaded"
DISPLAY_CAP = 20.0


class TooManyErrors(RuntimeError):
    """Raised before anything is written when a load has too many rejects."""


def check_header(spark: SparkSession, path: str, data_type: str, quote: str = "`") -> DataFrame:
    """Expected and actual column names of a file, and how they differ."""
    expected = entity(data_type).columns
    actual = read_header(spark, path, quote)
    row = spark.createDataFrame(
        [(data_type, expected, actual)], "data_type string, expected array<string>, headers array<string>"
    )
    return row.transform(compare_headers)


def check_headers(spark: SparkSession, path: str | list[str], data_type: str, quote: str = "`") -> DataFrame:
    """The same for every file below a path, with the file's name; only first lines are read.

    ``read_bulk(..., required=...)`` is the guard that goes with it: records of files
    whose header lacks a required name are rejected, those of the others are read.
    """
    expected = F.array(*[F.lit(n) for n in entity(data_type).columns])
    files = file_headers(spark, path, quote).withColumns({"data_type": F.lit(data_type), "expected": expected})
    return files.transform(compare_headers)


def compare_headers(df: DataFrame) -> DataFrame:
    """Missing and extra names between ``expected`` and ``headers`` arrays."""
    return df.withColumns(
        {
            "missing_fields": F.array_sort(F.array_except("expected", "headers")),
            "extra_fields": F.array_sort(F.array_except("headers", "expected")),
        }
    ).withColumn("valid", F.size("missing_fields") == 0)


def parse_stats(projected: DataFrame, skipped: DataFrame | None = None) -> DataFrame:
    """One row: all, parsed, rejected and skipped rows and the success rate."""
    flags = projected.select(
        (F.size("errors") == 0).cast("int").alias("ok"),
        (F.size("errors") > 0).cast("int").alias("bad"),
        F.lit(0).alias("skip"),
    )
    if skipped is not None:
        none = F.lit(0)
        flags = flags.unionByName(skipped.select(none.alias("ok"), none.alias("bad"), F.lit(1).alias("skip")))
    sums = {"parsed_rows": "ok", "error_rows": "bad", "skipped_rows": "skip"}
    stats = flags.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(n) for n, c in sums.items()])
    total = F.col("parsed_rows") + F.col("error_rows") + F.col("skipped_rows")
    return stats.select(
        total.alias("total_rows"),
        "parsed_rows",
        "error_rows",
        "skipped_rows",
        F.when(total > 0, F.col("parsed_rows") * 100.0 / total).otherwise(F.lit(0.0)).alias("success_rate"),
    )


def stop_on_errors(projected: DataFrame, max_errors: int) -> DataFrame:
    """The rows unchanged, or an error when more than ``max_errors`` are rejected."""
    if projected.where(F.size("errors") > 0).count() > max_errors:
        raise TooManyErrors("Too many parsing errors")
    return projected


def error_summary(projected: DataFrame) -> DataFrame:
    """How often each error is the first one of a rejected row."""
    return (
        projected.where(F.size("errors") > 0)
        .groupBy(F.get("errors", F.lit(0)).alias("error"))
        .agg(F.count(F.lit(1)).alias("occurrences"))
    )


def error_category(message: Column) -> Column:
    return (
        F.when(message.contains("ID is required"), "missing_id")
        .when(message.contains("name is required") | message.contains("Name is required"), "missing_name")
        .otherwise("other")
    )


def error_categories(log: DataFrame, message: str = "error") -> DataFrame:
    """Errors per category with their share of all rows, and the share shown on a bar.

    ``log`` has one row per processed record; a NULL message is a success.
    """
    kinds = log.groupBy(F.when(F.col(message).isNotNull(), error_category(F.col(message))).alias("category")).agg(
        F.count(F.lit(1)).alias("occurrences")
    )
    # At most four rows from here on, successes included.
    total = F.sum("occurrences").over(Window.partitionBy(F.lit(1)))
    percent = F.col("occurrences") * 100.0 / F.col("total")
    return (
        kinds.withColumn("total", total)
        .where("category is not null")
        .select(
            "category",
            "occurrences",
            "total",
            percent.alias("percent"),
            F.least(percent, F.lit(DISPLAY_CAP)).alias("bar_percent"),
        )
    )


def error_samples(log: DataFrame, key: str, order: str, n: int, last: bool = False) -> DataFrame:
    """First (or last) n errors per key.

    The rank limit is applied before the shuffle, so each task sends at most n
    rows per key however many errors one key has.
    """
    by = F.col(order).desc() if last else F.col(order).asc()
    ranked = log.withColumn("sample_no", F.row_number().over(Window.partitionBy(key).orderBy(by)))
    return ranked.where(F.col("sample_no") <= n)


def reject_unknown_codes(df: DataFrame, column: str, codes: list[str]) -> DataFrame:
    """Rows whose code is not an allowed one, with the reason."""
    c = F.col(column)
    bad = c.isNotNull() & (c != "") & ~c.isin(*codes)
    return df.where(bad).withColumn("error", F.concat(F.lit("Unknown enum value: "), c))


# Manifests: dataset_id, path, size, status, error_message ---------------------


def file_errors() -> Column:
    """Messages of one manifest row."""
    blank = F.lit("")
    return present(
        F.when(F.coalesce("path", blank) == "", F.lit(EMPTY_PATH)),
        F.when(
            (F.col("status") == "error") & (F.coalesce("error_message", blank) != ""),
            F.concat(F.lit("File error: "), "error_message"),
        ),
        F.when(F.col("size") == 0, F.lit(EMPTY_FILE)),
    )


def file_error_rows(manifest: DataFrame) -> DataFrame:
    """One row per file problem; exploded, so a data set may have any number."""
    return manifest.select("dataset_id", "path", F.explode(file_errors()).alias("error"))


def dataset_checks(
    manifest: DataFrame, datasets: DataFrame | None = None, max_bytes: int | None = None
) -> DataFrame:
    """Per data set: totals, completion flags, problem counts and readiness.

    ``datasets`` (column ``dataset_id``) also lists data sets without any file.
    Data sets of more than ``max_bytes`` are not ready; without it, size does not matter.
    """
    has_problem = F.size(file_errors())
    status = lambda s: F.coalesce(F.col("status") == s, F.lit(False))
    per = manifest.groupBy("dataset_id").agg(
        F.count(F.lit(1)).alias("files"),
        F.coalesce(F.sum("size"), F.lit(0)).alias("total_size"),
        F.bool_and(status("downloaded")).alias("download_complete"),
        F.bool_and(status("parsed")).alias("parsing_complete"),
        F.bool_or(status("error")).alias("has_errors"),
        F.count_if(status("error")).alias("error_files"),
        F.sum(has_problem).cast("bigint").alias("file_problems"),
    )
    if datasets is not None:
        per = (
            datasets.select("dataset_id")
            .distinct()
            .join(per, "dataset_id", "left")
            .fillna(0, ["files", "total_size", "error_files", "file_problems"])
            .fillna(False, ["download_complete", "parsing_complete", "has_errors"])
        )
    no_files = F.col("files") == 0
    big = F.col("total_size") > max_bytes if max_bytes is not None else F.lit(False)
    messages = present(F.when(no_files, F.lit(NO_FILES)), F.when(big, F.lit(TOO_LARGE)))
    reason = (
        F.when(no_files, NO_FILES_REASON)
        .when(F.col("has_errors"), ERROR_FILES_REASON)
        .when(~F.col("download_complete"), NOT_DOWNLOADED_REASON)
        .when(big, TOO_LARGE)
    )
    return per.withColumns(
        {"dataset_errors": messages, "not_ready_reason": reason}
    ).withColumn("ready", F.col("not_ready_reason").isNull())


def files_with_status(manifest: DataFrame, status: str) -> DataFrame:
    return manifest.where(F.col("status") == status)
