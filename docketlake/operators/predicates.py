"""Filter operators compiled to Column predicates.

A NULL field matches nothing but ``eq None``; that holds for ``not_in`` too.
A literal that does not convert to the column's type, and a pattern that does
not compile, match nothing.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import date, datetime
from functools import reduce
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark import SparkContext
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketlake.functions.text import display_text

# Operator names of filters and of simple record queries.
OPERATORS = (
    "eq contains starts_with ends_with gt lt gte lte between in not_in regex fuzzy".split()
)
RECORD_OPERATORS = "equals contains starts_with ends_with regex".split()

FUZZY_DISTANCE = 2


@dataclass(frozen=True)
class Filter:
    field: str
    operator: str
    value: Any
    case_sensitive: bool = True

    def __post_init__(self) -> None:
        if self.operator not in OPERATORS:
            raise ValueError(f"Unknown operator: {self.operator}")


# Parts of a pattern that stay as they are: an escaped character, or a whole class.
_KEPT = r"\\.|\[\^?\]?(?:\\.|[^\]\\])*\]"
_DIFFERENT = re.compile(rf"({_KEPT})|\(\?P<(\w+)>|\(\?P=(\w+)\)|\{{,(\d+)\}}", re.DOTALL)


def java_pattern(pattern: str, case_sensitive: bool = True) -> str | None:
    """A Python-style pattern in Java syntax, with its flags; None when one of the two does not compile it.

    Classes such as ``\\w`` and word boundaries are those of Unicode, as in Python.
    """
    try:
        re.compile(pattern)
    except re.error:
        return None

    def translated(m: re.Match) -> str:
        kept, name, reference, upto = m.groups()
        if kept is not None:
            return r"\z" if kept == r"\Z" else kept
        return f"(?<{name}>" if name else rf"\k<{reference}>" if reference else f"{{0,{upto}}}"

    java = ("(?U)" if case_sensitive else "(?iuU)") + _DIFFERENT.sub(translated, pattern)
    context = SparkContext._active_spark_context
    try:
        if context is not None:
            context._jvm.java.util.regex.Pattern.compile(java)
    except (IllegalArgumentException, Py4JJavaError):
        return None
    return java


def value_text(value: Any) -> str:
    return value if isinstance(value, str) else str(value)


def typed_literal(value: Any, data_type: T.DataType) -> Column:
    """A literal in the column's type; numbers compare as numbers of any kind."""
    numeric = isinstance(data_type, T.NumericType)
    if numeric and isinstance(value, (int, float)) and not isinstance(value, bool):
        return F.lit(value)
    if isinstance(value, (date, datetime)):
        value = value.isoformat(sep=" ") if isinstance(value, datetime) else value.isoformat()
    return F.lit(value).cast("string").try_cast(data_type)


def predicate(f: Filter, column: Column, data_type: T.DataType) -> Column:
    """The test of one filter; NULL, like false, is no match.

    Kept free of NULL handling so that comparisons reach the Parquet scan.
    """
    is_text = isinstance(data_type, T.StringType)
    fold = is_text and not f.case_sensitive

    def folded(c: Column) -> Column:
        return F.lower(c) if fold else c

    if f.value is None:
        return column.isNull() if f.operator == "eq" else F.lit(False)

    value, text = folded(column), folded(display_text(column, data_type))

    def literal(v: Any) -> Column:
        return folded(typed_literal(v, data_type))

    needle = value_text(f.value)
    needle = needle.lower() if fold else needle
    tests = {
        "eq": lambda: value == literal(f.value),
        "contains": lambda: text.contains(needle),
        "starts_with": lambda: text.startswith(needle),
        "ends_with": lambda: text.endswith(needle),
        "gt": lambda: value > literal(f.value),
        "lt": lambda: value < literal(f.value),
        "gte": lambda: value >= literal(f.value),
        "lte": lambda: value <= literal(f.value),
        "between": lambda: (value >= literal(f.value[0])) & (value <= literal(f.value[1])),
        "in": lambda: _is_in(value, [literal(v) for v in f.value if v is not None]),
        "not_in": lambda: _not_in(value, [literal(v) for v in f.value if v is not None]),
        "regex": lambda: _regex(display_text(column, data_type), f),
        "fuzzy": lambda: fuzzy_match(text, needle),
    }
    return tests[f.operator]()


def _is_in(value: Column, literals: list[Column]) -> Column:
    return value.isin(*literals) if literals else F.lit(False)


def _not_in(value: Column, literals: list[Column]) -> Column:
    """Literals that did not convert (NULL) exclude nothing."""
    hit = F.coalesce(value.isin(*literals), F.lit(False)) if literals else F.lit(False)
    return value.isNotNull() & ~hit


def _regex(text: Column, f: Filter) -> Column:
    pattern = java_pattern(value_text(f.value), f.case_sensitive)
    if pattern is None:
        return F.lit(False)
    return text.rlike(pattern)


def fuzzy_match(text: Column, pattern: str | Column, distance: int = FUZZY_DISTANCE) -> Column:
    """Edit distance of the whole value within the limit, lengths checked first."""
    p = F.lit(pattern) if isinstance(pattern, str) else pattern
    near = F.abs(F.length(text) - F.length(p)) <= distance
    return near & (F.levenshtein(text, p, distance) >= 0)


def compile_filter(f: Filter, schema: T.StructType) -> Column:
    if f.field not in schema.names:
        return F.lit(f.operator == "eq" and f.value is None)
    return predicate(f, F.col(f"`{f.field}`"), schema[f.field].dataType)


def compile_filters(filters: list[Filter], schema: T.StructType) -> Column:
    """All filters together, as a condition; no filter is true."""
    return reduce(lambda a, b: a & b, [compile_filter(f, schema) for f in filters], F.lit(True))


def apply_filters(df: DataFrame, filters: list[Filter]) -> DataFrame:
    """Filter rows; lists of any length are compared by the same rule, as one hashed set."""
    return df.where(compile_filters(filters, df.schema)) if filters else df


def full_text(text: Column, query: str | None) -> Column:
    """Every white-space separated term occurs in the text, in any case."""
    terms = (query or "").lower().split()
    lowered = F.lower(F.coalesce(text, F.lit("")))
    return reduce(lambda a, b: a & b, [lowered.contains(t) for t in terms], F.lit(True))


@dataclass(frozen=True)
class RecordQuery:
    """A simple query over the dictionaries of a court record."""

    field: str
    value: str
    operator: str = "contains"
    case_sensitive: bool = False

    def __post_init__(self) -> None:
        if not self.field:
            raise ValueError("Query field cannot be empty")
        if not self.value:
            raise ValueError("Query value cannot be empty")

    def test(self, value: Column) -> Column:
        """The operator applied to one text value; NULL (no such field) is false."""
        text = value if self.case_sensitive else F.lower(value)
        wanted = self.value if self.case_sensitive else self.value.lower()
        if self.operator == "equals":
            hit = text == wanted
        elif self.operator == "starts_with":
            hit = text.startswith(wanted)
        elif self.operator == "ends_with":
            hit = text.endswith(wanted)
        elif self.operator == "regex":
            pattern = java_pattern(self.value, self.case_sensitive)
            hit = F.lit(False) if pattern is None else value.rlike(pattern)
        else:
            hit = text.contains(wanted)
        return F.coalesce(hit, F.lit(False))

    def on_map(self, values: Column) -> Column:
        return self.test(F.try_element_at(values, F.lit(self.field)))


def build_record_query(field: str, value: str, operator: str = "contains") -> RecordQuery:
    """Operator by name; a name that is not known means contains."""
    return RecordQuery(field, value, operator if operator in RECORD_OPERATORS else "contains")


def text_record_query(text: str) -> RecordQuery:
    """A query over all searchable text of a record."""
    return RecordQuery("searchable_text", text)


# Entity state predicates -----------------------------------------------------


def court_is_active(today: Column) -> Column:
    return F.col("end_date").isNull() | (F.col("end_date") > today)


def docket_is_active() -> Column:
    return F.col("date_terminated").isNull()


def cluster_is_published() -> Column:
    return F.coalesce(F.col("precedential_status") == "Published", F.lit(False))


def cluster_is_blocked() -> Column:
    return F.coalesce(F.col("blocked"), F.lit(False))


def opinion_has_text() -> Column:
    return (F.coalesce("plain_text", F.lit("")) != "") | (F.coalesce("html", F.lit("")) != "")


def person_is_deceased() -> Column:
    return F.col("date_dod").isNotNull()
