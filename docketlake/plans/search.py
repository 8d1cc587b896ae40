"""Entity search: filters and full text, sorting, paging and page counts."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketlake.functions.text import search_text
from docketlake.operators.predicates import Filter, apply_filters, compile_filters, full_text
from docketlake.plans.paging import page, sort_columns
from docketlake.schemas import ENTITIES

# Text per entity; register another column to search something else.
TEXT_EXTRACTORS: dict[str, Any] = {name: search_text for name in ENTITIES}


def register_text(entity_name: str, build: Any) -> None:
    """Replace an entity's search text: ``build(entity, columns) -> Column``."""
    TEXT_EXTRACTORS[entity_name] = build


@dataclass(frozen=True)
class SearchQuery:
    filters: tuple[Filter, ...] = ()
    sort: tuple[tuple[str, str], ...] = ()
    limit: int | None = None
    offset: int = 0
    full_text: str | None = None
    reverse_all: bool = False

    def where(self, field_name: str, operator: str, value: Any, case_sensitive: bool = True) -> SearchQuery:
        return replace(self, filters=(*self.filters, Filter(field_name, operator, value, case_sensitive)))

    def order(self, field_name: str, order: str = "asc") -> SearchQuery:
        if order not in ("asc", "desc"):
            raise ValueError(f"Unknown sort order: {order}")
        return replace(self, sort=(*self.sort, (field_name, order)))

    def take(self, limit: int | None, offset: int = 0) -> SearchQuery:
        return replace(self, limit=limit, offset=offset)

    def text(self, query: str | None) -> SearchQuery:
        return replace(self, full_text=query)


@dataclass
class SearchResult:
    """A lazy page and, separately, the counts that go with it."""

    table: DataFrame
    matched: DataFrame
    query: SearchQuery
    id_columns: list[str] = field(default_factory=lambda: ["id"])
    condition: Column | None = None

    @property
    def rows(self) -> DataFrame:
        q = self.query
        return page(self.matched, sort_columns(list(q.sort), self.id_columns, q.reverse_all), q.limit, q.offset)

    @property
    def counts(self) -> DataFrame:
        """One row: total, filtered and returned rows, and whether more follow."""
        total, filtered = F.sum("total").alias("total_count"), F.sum("hit").alias("filtered_count")
        if self.condition is not None:
            # One pass: a predicate needs no second scan for the total.
            flags = self.table.select(F.lit(1).alias("total"), self.condition.cast("int").alias("hit"))
        else:
            flags = self.table.select(F.lit(1).alias("total"), F.lit(0).alias("hit")).unionByName(
                self.matched.select(F.lit(0).alias("total"), F.lit(1).alias("hit"))
            )
        base = flags.agg(total, filtered).fillna(0)
        left = F.greatest(F.col("filtered_count") - self.query.offset, F.lit(0))
        returned = F.least(left, F.lit(self.query.limit)) if self.query.limit else left
        more = F.lit(False)
        if self.query.limit is not None:
            more = F.lit(self.query.offset) + F.col("returned_count") < F.col("filtered_count")
        return base.withColumn("returned_count", returned.cast("bigint")).withColumn("has_more", more)


def search(df: DataFrame, query: SearchQuery, entity_name: str | None = None, text: Column | None = None) -> SearchResult:
    """Compile a query against a table of an entity (or any table with a text column)."""
    ids = list(ENTITIES[entity_name].key) if entity_name else [c for c in ("id",) if c in df.columns]
    if text is None and entity_name:
        text = TEXT_EXTRACTORS[entity_name](entity_name, df.columns)
    words = full_text(text if text is not None else F.lit(""), query.full_text)
    matched = apply_filters(df, list(query.filters)).where(words)
    condition = F.coalesce(compile_filters(list(query.filters), df.schema) & words, F.lit(False))
    return SearchResult(df, matched, query, ids, condition)


def query_from_spec(spec: dict[str, Any] | str) -> tuple[str, SearchQuery]:
    """Entity name and query from a dictionary or its JSON text."""
    spec = json.loads(spec) if isinstance(spec, str) else spec
    name = spec.get("type", "opinions")
    if name not in ENTITIES:
        raise ValueError(f"Unknown search type: {name}")
    q = SearchQuery()
    for f in spec.get("filters", []):
        q = q.where(f["field"], f["operator"], f["value"], f.get("case_sensitive", True))
    for s in spec.get("sort", []):
        q = q.order(s["field"], s.get("order", "asc"))
    if "limit" in spec:
        q = q.take(spec["limit"], spec.get("offset", 0))
    if "full_text" in spec:
        q = q.text(spec["full_text"])
    return name, q


class Searcher:
    """Searches over a set of entity tables."""

    def __init__(self, tables: dict[str, DataFrame]):
        self.tables = tables

    def _run(self, name: str, query: SearchQuery) -> SearchResult:
        return search(self.tables[name], query, name)

    def courts(self, query: SearchQuery) -> SearchResult:
        return self._run("courts", query)

    def dockets(self, query: SearchQuery) -> SearchResult:
        return self._run("dockets", query)

    def opinion_clusters(self, query: SearchQuery) -> SearchResult:
        return self._run("opinion_clusters", query)

    def opinions(self, query: SearchQuery) -> SearchResult:
        return self._run("opinions", query)

    def citations(self, query: SearchQuery) -> SearchResult:
        return self._run("citations", query)

    def people(self, query: SearchQuery) -> SearchResult:
        return self._run("people", query)

    def advanced(self, spec: dict[str, Any] | str) -> SearchResult:
        return self._run(*query_from_spec(spec))

    def court_by_name(self, name: str, exact: bool = False) -> DataFrame:
        return self.courts(SearchQuery().where("full_name", "eq" if exact else "contains", name, False)).rows

    def dockets_by_case_name(self, name: str, court_id: str | None = None) -> DataFrame:
        q = SearchQuery().where("case_name", "contains", name, False)
        return self.dockets(q.where("court_id", "eq", court_id) if court_id else q).rows

    def opinions_by_text(self, text: str, limit: int | None = None) -> DataFrame:
        return self.opinions(SearchQuery().text(text).take(limit)).rows

    def person_by_name(self, name: str, fuzzy: bool = False) -> DataFrame:
        q = SearchQuery().where("name_last", "fuzzy", name, False) if fuzzy else SearchQuery().text(name)
        return self.people(q).rows
