"""The older tab-separated line format: no header, positions instead of names."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketlake.functions.parsing import SPACE_CLASS, literal_pattern, strip
from docketlake.functions.text import CONTROL_CHARACTERS, CleaningRule, clean_columns


def split_court_lines(
    lines: DataFrame, column: str = "value", delimiter: str = "\t", rule: CleaningRule = CleaningRule()
) -> DataFrame:
    """Strip lines, skip blank ones, split, and clean the troublesome positions.

    Stripping the line also removes empty columns at its end, as it always did.
    Undecodable bytes are dropped first.
    """
    decoded = F.when(F.is_valid_utf8(column), F.col(column)).otherwise(
        F.regexp_replace(F.make_valid_utf8(column), "\ufffd", "")
    )
    # Exploding an array of one evaluates its content once per line; filters and
    # later columns would otherwise repeat it.
    stripped = lines.withColumn(column, F.explode(F.array(strip(decoded)))).where(F.col(column) != "")
    pieces = F.split(column, literal_pattern(delimiter), -1)
    # One look at the line spares clean ones the work on every column.  The
    # encoding was repaired above, for the whole line.
    edge = f"\\Q{delimiter}\\E"
    dirty = F.col(column).rlike(rf"{CONTROL_CHARACTERS}|{edge}[{SPACE_CLASS}]|(?<=[{SPACE_CLASS}]){edge}")
    tidy = F.when(dirty, clean_columns(pieces, replace(rule, encoding_fix=False))).otherwise(pieces)
    standard = delimiter == "\t" and not (rule.remove_patterns or rule.replace_patterns)
    once = F.explode(F.array(tidy if standard else clean_columns(pieces, rule)))
    return stripped.withColumn("columns", once).drop(column)


def read_court_lines(spark: SparkSession, path: str | list[str], delimiter: str = "\t") -> DataFrame:
    """One row ``columns: array<string>`` per non-blank line."""
    return split_court_lines(spark.read.text(path), delimiter=delimiter)
