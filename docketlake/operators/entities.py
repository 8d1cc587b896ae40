"""Typed projection of raw bulk rows, with rejected rows kept beside the good ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketlake.functions import parsing as P
from docketlake.functions.text import present
from docketlake.schemas import (
    KIND_TYPES,
    NEGATIVE_DEPTH_MESSAGE,
    OPINION_TYPE,
    PRECEDENTIAL_STATUS,
    UNKNOWN_OPINION_TYPE,
    Entity,
    Field,
    entity,
)
from docketlake.sources.bulk import CORRUPT, DIALECTS, Dialect

# Nouns of the conversion messages.
CONVERSION_NOUN = {
    "long": "integer",
    "int": "integer",
    "double": "float",
    "date": "date",
    "timestamp": "datetime",
}


def _source_column(f: Field, available: list[str]) -> Column:
    for name in (f.name, *f.aliases):
        if name in available:
            return F.col(name)
    return F.lit(None).cast("string")


def _lenient(f: Field, raw: Column, wrapped: bool) -> Column:
    raw = P.null_marker(raw) if f.kind != "string" else raw
    parsers = {
        "string": P.parse_string,
        "long": P.parse_integer,
        "int": lambda c, w: P.parse_integer(c, w).try_cast("int"),
        "double": P.parse_float,
        "bool": P.parse_boolean,
        "date": P.parse_date,
        "timestamp": P.parse_datetime,
        "longs": lambda c, w: P.parse_long_list(P.bare(c, w)),
        "status": lambda c, w: P.parse_code(P.bare(c, w), PRECEDENTIAL_STATUS),
        "opinion_type": lambda c, w: P.code_or(c, OPINION_TYPE, UNKNOWN_OPINION_TYPE, w),
    }
    return parsers[f.kind](raw, wrapped)


def _strict(f: Field, raw: Column) -> Column:
    """Blank becomes NULL; a value that does not convert becomes NULL as well."""
    raw = F.nullif(raw, F.lit(""))
    parsers = {
        "string": lambda c: c,
        "long": lambda c: P.parse_integer(c, False),
        "int": lambda c: P.parse_integer(c, False).try_cast("int"),
        "double": lambda c: P.parse_float(c, False),
        "bool": lambda c: P.parse_boolean(c, False),
        "date": lambda c: P.parse_date(c, False, times=True),
        "timestamp": lambda c: P.parse_datetime(c, False, offsets=False),
        "longs": P.parse_long_list,
        "status": lambda c: P.parse_code(c, PRECEDENTIAL_STATUS),
        "opinion_type": lambda c: P.parse_code(c, OPINION_TYPE),
    }
    return parsers[f.kind](raw)


def _conversion_error(f: Field, raw: Column, parsed: Column) -> Column | None:
    """Message when a required value is there but does not convert."""
    failed = (P.strip(F.coalesce(raw, F.lit(""))) != "") & parsed.isNull()
    if f.kind in CONVERSION_NOUN:
        reason = F.concat(F.lit(f"Unable to parse {CONVERSION_NOUN[f.kind]}: "), raw)
    elif f.kind in ("status", "opinion_type"):
        reason = F.concat(F.lit("Unknown enum value: "), raw)
    else:
        return None
    return F.when(failed, F.concat(F.lit(f"Error parsing required field {f.name}: "), reason))


def missing(c: Column, kind: str) -> Column:
    """NULL, '' and, for ids, 0 all count as missing."""
    if kind == "long":
        return F.coalesce(c, F.lit(0)) == 0
    if KIND_TYPES[kind].typeName() == "string":
        return F.coalesce(c, F.lit("")) == ""
    return c.isNull()


def required_errors(e: Entity, column: callable = F.col) -> list[Column]:
    """One message column per violated constraint of an entity."""
    checks = [F.when(missing(column(f.name), f.kind), F.lit(f.message)) for f in e.fields if f.required]
    if e.name == "citations":
        checks.append(F.when(column("depth") < 0, F.lit(NEGATIVE_DEPTH_MESSAGE)))
    return checks


def _parsed(f: Field, source: Column, d: Dialect) -> Column:
    return _strict(f, source) if d.strict else _lenient(f, source, d.wrapped)


def _typed(f: Field, parsed: Column, d: Dialect) -> Column:
    default_ok = not d.strict or f.kind == "bool" or f.name == "citation_count"
    if f.default is not None and default_ok:
        parsed = F.coalesce(parsed, F.lit(f.default))
    return parsed.cast(KIND_TYPES[f.kind])


def fixed_columns(data_type: str | Entity, available: list[str], dialect: str | Dialect = "backtick") -> dict[str, Column]:
    """What ``project`` puts into the columns that the input lacks, one value for all rows; keys are left out."""
    e = entity(data_type)
    d = DIALECTS[dialect] if isinstance(dialect, str) else dialect
    absent = [f for f in e.fields if f.name not in e.key and not {f.name, *f.aliases} & set(available)]
    return {f.name: _typed(f, _parsed(f, _source_column(f, available), d), d).alias(f.name) for f in absent}


def project(raw: DataFrame, data_type: str | Entity, dialect: str | Dialect = "backtick") -> DataFrame:
    """All typed columns of an entity plus ``errors``; no row is dropped.

    Expected columns that the input lacks come out as NULL or their default;
    columns the entity does not have are ignored.
    """
    e = entity(data_type)
    d = DIALECTS[dialect] if isinstance(dialect, str) else dialect
    available = raw.columns
    typed, conversions = {}, {}
    for f in e.fields:
        source = _source_column(f, available)
        parsed = _parsed(f, source, d)
        if d.strict and f.required:
            message = _conversion_error(f, source, parsed)
            if message is not None:
                conversions[f.name] = message
        typed[f.name] = _typed(f, parsed, d)
    extra = [c for c in available if c.startswith("_") and c != CORRUPT]
    conversion_errors = list(conversions.values())
    if CORRUPT in available:
        conversion_errors.append(F.when(F.col(CORRUPT).isNotNull(), F.lit("Malformed record")))
    out = raw.select(
        *[c.alias(n) for n, c in typed.items()],
        *extra,
        *[c.alias(f"_error_{i}") for i, c in enumerate(conversion_errors)],
    )
    names = [f"_error_{i}" for i in range(len(conversion_errors))]
    constraint = present(*required_errors(e))
    if not names:
        return out.withColumn("errors", constraint)
    # A value that failed to convert is reported once, not also as missing.
    failed = F.coalesce(*[F.col(n) for n in names]).isNotNull()
    errors = F.when(failed, present(*[F.col(n) for n in names])).otherwise(constraint)
    return out.withColumn("errors", errors).drop(*names)


def good(projected: DataFrame) -> DataFrame:
    return projected.where(F.size("errors") == 0).drop("errors")


def rejected(projected: DataFrame) -> DataFrame:
    return projected.where(F.size("errors") > 0)


def valid_opinion_row(id_: Column, type_: Column, cluster: Column, short: bool = False) -> Column:
    """Whether a raw backticked row looks like an opinion and not like debris.

    The id must be backticked digits.  Unless ``short``, the type must be
    backticked, non-empty and no markup, and the cluster id must not look like
    markup or run over 50 characters.
    """
    blank = F.lit("")
    the_id = P.strip(F.coalesce(id_, blank))
    ok = the_id.rlike("^`[0-9]+`$")
    if short:
        return ok
    the_type = P.strip(F.coalesce(type_, blank))
    the_cluster = P.strip(F.coalesce(cluster, blank))
    typed = the_type.rlike(r"^`[\s\S]+`$") & ~the_type.startswith("`<")
    digits = the_cluster.rlike("^`[0-9]+`$")
    debris = the_cluster.contains("<") | the_cluster.contains(">") | (F.length(the_cluster) > 50)
    return ok & typed & ((the_cluster == "") | digits | ~debris)
