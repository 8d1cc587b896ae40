"""Foreign-key lookups, the case hierarchy, and records joined with their case data.

A docket, cluster or opinion may own a third of all rows below it.  Outer joins
from the parent side cannot be split on such a key, so parents are expanded with
an inner join (which adaptive skew handling splits) plus the childless parents.
Arrays of children are paged, so no group is ever collected whole.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketlake.functions.text import join_present
from docketlake.operators.court_records import UNKNOWN, record_text
from docketlake.operators.ranges import RANGE, ROWS_PER_RANGE, into_ranges

#: Parts of the records without a case number.
BLANK_PARTS = 256


def children_of(table: DataFrame, foreign_key: str, parent_ids: DataFrame | list) -> DataFrame:
    """Rows of a child table that belong to the given parents."""
    if isinstance(parent_ids, list):
        return table.where(F.col(foreign_key).isin(parent_ids))
    ids = parent_ids.select(F.col(parent_ids.columns[0]).alias("_id"))
    return table.join(ids, F.col(foreign_key) == F.col("_id"), "left_semi")


def dockets_of_court(dockets: DataFrame, courts: DataFrame | list) -> DataFrame:
    return children_of(dockets, "court_id", courts)


def clusters_of_docket(clusters: DataFrame, dockets: DataFrame | list) -> DataFrame:
    return children_of(clusters, "docket_id", dockets)


def opinions_of_cluster(opinions: DataFrame, clusters: DataFrame | list) -> DataFrame:
    return children_of(opinions, "cluster_id", clusters)


def load_batch(table: DataFrame, ids: DataFrame | list, key: str = "id") -> DataFrame:
    """Records with the given ids; ids that are not there are skipped."""
    return children_of(table, key, ids)


def lookup(table: DataFrame, value: object, key: str = "id") -> DataFrame:
    """One record by id; the equality reaches the Parquet scan."""
    return table.where(F.col(key) == F.lit(value))


def exists(table: DataFrame, value: object, key: str = "id") -> bool:
    return not lookup(table, value, key).isEmpty()


def exist(keys: DataFrame, table: DataFrame, key: str = "id") -> DataFrame:
    """``keys`` with ``found``: whether the table has a record with the value, for any number of them."""
    there = table.select(F.col(key).alias(keys.columns[0])).distinct().withColumn("found", F.lit(True))
    return keys.join(there, keys.columns[0], "left").withColumn("found", F.coalesce("found", F.lit(False)))


def expand(parent: DataFrame, child: DataFrame, key: str) -> DataFrame:
    """Parents with each of their children; childless ones once, with NULLs."""
    matched = child.join(parent, key)
    childless = parent.join(child.select(key).distinct(), key, "left_anti")
    return matched.unionByName(childless, allowMissingColumns=True)


def case_hierarchy(
    dockets: DataFrame, clusters: DataFrame, opinions: DataFrame, docket_ids: DataFrame | list | None = None
) -> DataFrame:
    """Flat docket - cluster - opinion rows for all or some dockets."""
    if docket_ids is not None:
        dockets = load_batch(dockets, docket_ids)
    d = dockets.select(F.col("id").alias("docket_id"), F.struct("*").alias("docket"))
    c = clusters.select("docket_id", F.col("id").alias("cluster_id"), F.struct("*").alias("cluster"))
    o = opinions.select("cluster_id", F.col("id").alias("opinion_id"), F.struct("*").alias("opinion"))
    return expand(expand(d, c, "docket_id"), o, "cluster_id")


def nest(
    parent: DataFrame, child: DataFrame, key: str, child_id: str, name: str, page_rows: int
) -> DataFrame:
    """Parents with an array of their children, in pages of about ``page_rows``.

    The caller chooses the page size, since a row has to fit into memory.  A
    parent with at most ``page_rows`` children has exactly one page (0); a
    larger one gets as many rows as it needs, its children spread by hash.
    Columns ``{name}_page`` and ``{name}_pages`` tell the rows apart.
    """
    page, pages = f"{name}_page", f"{name}_pages"
    large = (
        child.groupBy(key)
        .agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") > page_rows)
        .select(key, F.ceil(F.col("_n") / page_rows).cast("int").alias(pages))
    )
    members = (
        child.join(large, key, "left")
        .withColumn(pages, F.coalesce(pages, F.lit(1)))
        .withColumn(page, F.when(F.col(pages) == 1, 0).otherwise(F.pmod(F.xxhash64(child_id), F.col(pages))).cast("int"))
    )
    item = F.struct(child_id, *[c for c in child.columns if c not in (key, child_id)])
    collected = members.groupBy(key, page, pages).agg(F.sort_array(F.collect_list(item)).alias(name))
    empty = {name: F.coalesce(name, F.array().cast(collected.schema[name].dataType))}
    return (
        expand(parent, collected, key)
        .withColumns(empty)
        .fillna({page: 0, pages: 1})
    )


def nest_by_bytes(
    parent: DataFrame, child: DataFrame, key: str, child_id: str, name: str, page_bytes: int, rows_per_range: int = ROWS_PER_RANGE
) -> DataFrame:
    """Parents with an array of their children, in pages of at most ``page_bytes`` of JSON text and one more child.

    Children are dealt out by ranges of ``(key, child_id)``, so those of a large parent
    lie in several tasks, and a page takes what follows each other in a range.  Pages of
    a parent are numbered in the order of their children, and columns
    ``{name}_page`` and ``{name}_pages`` tell them apart; a parent without
    children has one empty page.
    """
    page, pages = f"{name}_page", f"{name}_pages"
    item = F.struct(child_id, *[c for c in child.columns if c not in (key, child_id)])
    sized = child.where(F.col(key).isNotNull()).withColumn("_bytes", F.octet_length(F.to_json(item)))
    ranges = into_ranges(sized, [key], [child_id], rows_per_range)
    filled = F.coalesce(F.sum("_bytes").over(ranges.window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    members = ranges.rows.withColumn("_part", F.floor(filled / page_bytes))
    collected = members.groupBy(key, RANGE, "_part").agg(F.sort_array(F.collect_list(item)).alias(name))
    # One row per page from here on.
    number = F.row_number().over(Window.partitionBy(key).orderBy(RANGE, "_part")) - 1
    collected = collected.withColumn(page, number).withColumn(pages, F.count("*").over(Window.partitionBy(key)).cast("int"))
    collected = collected.drop(RANGE, "_part")
    empty = {name: F.coalesce(name, F.array().cast(collected.schema[name].dataType))}
    return expand(parent, collected, key).withColumns(empty).fillna({page: 0, pages: 1})


def nested_hierarchy(
    dockets: DataFrame,
    clusters: DataFrame,
    opinions: DataFrame,
    docket_ids: DataFrame | list | None = None,
    *,
    page_rows: int | None = None,
    page_bytes: int | None = None,
) -> DataFrame:
    """Dockets with their clusters, and those with their opinions, as arrays in pages of so many rows or bytes.

    Rows are counted by :func:`nest`; bytes by :func:`nest_by_bytes`, where a
    cluster with a page of opinions is one child of its docket.  An unknown docket yields
    no row; a cluster without opinions an empty array.
    """
    if (page_rows is None) == (page_bytes is None):
        raise ValueError("Give the size of a page either in rows or in bytes")
    nested, size = (nest, page_rows) if page_bytes is None else (nest_by_bytes, page_bytes)
    if docket_ids is not None:
        dockets = load_batch(dockets, docket_ids)
        clusters = children_of(clusters, "docket_id", docket_ids)
        opinions = children_of(opinions, "cluster_id", clusters.select("id"))
    rename = lambda df, key: df.withColumnRenamed("id", key)
    with_opinions = nested(rename(clusters, "cluster_id"), rename(opinions, "opinion_id"), "cluster_id", "opinion_id", "opinions", size)
    return nested(rename(dockets, "docket_id"), with_opinions, "docket_id", "cluster_id", "clusters", size)


def citations_of_opinion(citations: DataFrame, opinion_ids: DataFrame | list) -> DataFrame:
    """Citations to and from opinions; a self-citation shows in both directions."""
    directions = (("incoming", "cited_opinion_id"), ("outgoing", "citing_opinion_id"))
    parts = [
        children_of(citations, key, opinion_ids).select(F.lit(name).alias("direction"), "*")
        for name, key in directions
    ]
    return reduce(DataFrame.unionByName, parts)


# Court records with the case data that belongs to them -----------------------


def attach_case_data(records: DataFrame, courts: DataFrame, dockets: DataFrame) -> DataFrame:
    """Records with ``court`` (by court code) and ``docket`` (by case number) structs.

    Several dockets may share a number; the one with the smallest id is taken.
    Many records have no number: those are dealt to ``BLANK_PARTS`` parts, each of
    which meets the one docket that a blank number may have.
    """
    court = courts.select(F.col("id").alias("_court"), F.struct("*").alias("court"))
    docket = dockets.groupBy(F.col("docket_number").alias("_number")).agg(
        F.min_by(F.struct("*"), "id").alias("docket")
    )
    blank = lambda number: F.coalesce(F.trim(number), F.lit("")).isin("", UNKNOWN)
    parts = F.when(blank("_number"), F.sequence(F.lit(0), F.lit(BLANK_PARTS - 1))).otherwise(F.array(F.lit(0)))
    docket = docket.withColumn("_docket_part", F.explode(parts))
    number = F.col("case_metadata.case_number")
    part = F.when(blank(number), F.pmod(F.xxhash64("record_id"), F.lit(BLANK_PARTS)).cast("int")).otherwise(0)
    return (
        records.join(court, F.col("court_identifier.court_code") == F.col("_court"), "left")
        .withColumn("_part", part)
        .join(docket, (number == F.col("_number")) & (F.col("_part") == F.col("_docket_part")), "left")
        .drop("_court", "_number", "_part", "_docket_part")
    )


def attach_dockets(records: DataFrame, dockets: DataFrame) -> DataFrame:
    """A row per record and docket with its case number, all of them; records without one once, with NULL."""
    docket = dockets.select(F.col("docket_number").alias("_number"), F.struct("*").alias("docket"))
    return records.join(docket, F.col("case_metadata.case_number") == F.col("_number"), "left").drop("_number")


def has_case_data(records: DataFrame, opinions: DataFrame) -> DataFrame:
    """Flag records that have a court, a docket or at least one opinion."""
    owners = opinions.select("record_id").distinct().withColumn("_owned", F.lit(True))
    known = F.col("court").isNotNull() | F.col("docket").isNotNull() | F.col("_owned").isNotNull()
    return records.join(owners, "record_id", "left").withColumn("has_case_data", known).drop("_owned")


def own_text() -> Column:
    """The search text of a record of :func:`attach_case_data`, without that of its opinions."""
    return join_present(
        record_text(),
        F.col("court.full_name"),
        F.col("court.jurisdiction"),
        F.col("court.citation_string"),
        F.col("docket.case_name"),
        F.col("docket.docket_number"),
        F.col("docket.case_name_full"),
    )


def enhanced_parts(records: DataFrame, opinions: DataFrame, prefix: int | None = None) -> DataFrame:
    """The search text of records in parts: the record's own, then its opinions'.

    ``records`` come from :func:`attach_case_data`; ``opinions`` has
    ``record_id, id, plain_text``.  Rows are ``record_id, part, text`` with the
    record's own text as part 0 and an opinion's whole text under the opinion's
    id, or its first ``prefix`` characters where that is asked for.
    """
    own = own_text()
    base = records.select("record_id", F.lit(0).cast("bigint").alias("part"), own.alias("text"))
    text = F.left("plain_text", F.lit(prefix)) if prefix else F.col("plain_text")
    theirs = opinions.where(F.coalesce("plain_text", F.lit("")) != "").select(
        "record_id", F.col("id").alias("part"), text.alias("text")
    )
    return base.unionByName(children_of(theirs, "record_id", records.select("record_id")))


def enhanced_search(records: DataFrame, opinions: DataFrame, query: str, prefix: int | None = None) -> DataFrame:
    """Records whose whole enhanced text has every term.

    Terms hold no spaces and parts are joined by one, so a term is in the text exactly
    when it is in some part.  A record's own text is tested where the record is; opinions
    leave one boolean per term and record before they are shuffled, and the two meet
    in the only join.  The text of a record is never assembled.
    """
    terms = query.lower().split()
    if not terms:
        return records
    text = F.left("plain_text", F.lit(prefix)) if prefix else F.col("plain_text")
    theirs = opinions.where(F.coalesce("plain_text", F.lit("")) != "").select("record_id", F.lower(text).alias("_text"))
    found = theirs.groupBy("record_id").agg(
        *[F.bool_or(F.col("_text").contains(t)).alias(f"_t{i}") for i, t in enumerate(terms)]
    )
    # Exploding an array of one builds the text once for all terms.
    own = records.withColumn("_text", F.explode(F.array(F.lower(own_text()))))
    own = own.withColumns({f"_own{i}": F.col("_text").contains(t) for i, t in enumerate(terms)}).drop("_text")
    known = lambda c: F.coalesce(F.col(c), F.lit(False))
    hit: Column = reduce(lambda a, b: a & b, [known(f"_own{i}") | known(f"_t{i}") for i in range(len(terms))])
    return own.join(found, "record_id", "left").where(hit).select(*records.columns)


def enhanced_text(records: DataFrame, opinions: DataFrame, page_rows: int, prefix: int | None = None) -> DataFrame:
    """The enhanced search text per record, in pages of at most that many opinions."""
    parts = enhanced_parts(records, opinions, prefix)
    paged = nest(records.select("record_id"), parts, "record_id", "part", "parts", page_rows)
    texts = F.col("parts")["text"]
    return paged.select(
        "record_id", "parts_page", "parts_pages", F.array_join(F.filter(texts, lambda t: t != ""), " ").alias("text")
    )
