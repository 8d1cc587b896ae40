"""Text columns: cleaning, joining, display forms and search text."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketlake.functions.parsing import strip
from docketlake.schemas import CLEANED_POSITIONS, entity

# Fixed value: control characters that cleaning removes (all but \n and \t).
CONTROL_CHARACTERS = r"[\x00-\x08\x0B-\x1F]"


@dataclass(frozen=True)
class CleaningRule:
    """What to remove from a text column, and where in a positional record."""

    start: int = CLEANED_POSITIONS[0]
    end: int = CLEANED_POSITIONS[1]
    remove_null_bytes: bool = True
    trim_whitespace: bool = True
    remove_control_chars: bool = True
    encoding_fix: bool = True
    remove_patterns: tuple[str, ...] = ()
    replace_patterns: dict[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.start < 0 or self.end < self.start:
            raise ValueError("a cleaning range needs 0 <= start <= end")

    @property
    def size(self) -> int:
        return self.end - self.start + 1

    @property
    def label(self) -> str:
        return f"{self.start}-{self.end}"

    def apply(self, c: Column) -> Column:
        out = F.coalesce(c, F.lit(""))
        if self.encoding_fix:
            repaired = F.regexp_replace(F.make_valid_utf8(out), "\ufffd", "")
            out = F.when(F.is_valid_utf8(out), out).otherwise(repaired)
        if self.remove_null_bytes and not self.remove_control_chars:
            out = F.regexp_replace(out, r"\x00", "")
        if self.remove_control_chars:
            keep_nul = "" if self.remove_null_bytes else r"&&[^\x00]"
            out = F.regexp_replace(out, CONTROL_CHARACTERS[:-1] + keep_nul + "]", "")
        for pattern in self.remove_patterns:
            out = F.regexp_replace(out, pattern, "")
        for pattern, replacement in self.replace_patterns.items():
            out = F.regexp_replace(out, pattern, replacement)
        return strip(out) if self.trim_whitespace else out


def clean_text(c: Column, rule: CleaningRule = CleaningRule()) -> Column:
    return rule.apply(c)


def clean_columns(columns: Column, rule: CleaningRule = CleaningRule(), compat: bool = False) -> Column:
    """Clean the positions of a positional record that the rule covers.

    ``compat`` leaves records alone that end inside the range, as updating a
    record in the original workflow did.
    """
    # The few cleaned positions are plain expressions, which run compiled; the others are copied in two slices.
    size = F.size(columns)
    inside = F.array(*[rule.apply(F.get(columns, F.lit(i))) for i in range(rule.start, rule.end + 1)])
    cleaned = F.concat(
        F.slice(columns, F.lit(1), F.lit(rule.start)),
        F.slice(inside, F.lit(1), F.least(F.greatest(size - rule.start, F.lit(0)), F.lit(rule.size))),
        F.slice(columns, F.lit(rule.end + 2), F.greatest(size - rule.end - 1, F.lit(0))),
    )
    return F.when(F.size(columns) > rule.end, cleaned).otherwise(columns) if compat else cleaned


def changed_positions(before: Column, after: Column, rule: CleaningRule | None = None) -> Column:
    """How many positions differ between two versions of a record; with ``rule`` only those it covers can."""
    if rule is not None:
        at = lambda c, i: F.get(c, F.lit(i))
        differs = [(~at(before, i).eqNullSafe(at(after, i))).cast("int") for i in range(rule.start, rule.end + 1)]
        return reduce(lambda a, b: a + b, differs)
    differing = F.filter(F.transform(before, lambda v, i: v.eqNullSafe(F.get(after, i))), lambda same: ~same)
    return F.when(before.eqNullSafe(after), F.lit(0)).otherwise(F.size(differing))


def present(*messages: Column) -> Column:
    """Array of the messages that are not NULL, without a lambda."""
    return F.array_except(F.array(*messages), F.array(F.lit(None).cast("string")))


def join_present(*parts: Column) -> Column:
    """Join with single spaces, leaving out NULL and empty parts."""
    return F.concat_ws(" ", *[F.nullif(p, F.lit("")) for p in parts])


def full_name(first: Column, middle: Column, last: Column, suffix: Column) -> Column:
    return join_present(first, middle, last, suffix)


def court_label(jurisdiction: Column, name: Column) -> Column:
    return F.concat(jurisdiction, F.lit(" - "), name)


def case_label(number: Column) -> Column:
    return F.concat(F.lit("Case "), number)


def plain_text_of(plain: Column, html: Column) -> Column:
    """Plain text where there is some, else the HTML."""
    return F.coalesce(F.nullif(plain, F.lit("")), html)


def parties(plaintiff: Column, defendant: Column, compat: bool = False) -> Column:
    """``A vs B``; one side alone when the other is empty, NULL when both are.

    ``compat`` trims the *characters* space, v and s from both ends instead, so
    that a lone "Jones" becomes "Jone".
    """
    a, b = F.nullif(plaintiff, F.lit("")), F.nullif(defendant, F.lit(""))
    either = a.isNotNull() | b.isNotNull()
    if compat:
        both = F.concat(F.coalesce(a, F.lit("")), F.lit(" vs "), F.coalesce(b, F.lit("")))
        return F.when(either, F.btrim(both, F.lit(" vs")))
    return F.when(either, F.concat_ws(" vs ", a, b))


def search_text(entity_name: str, available: list[str] | None = None) -> Column:
    """Full-text search text of an entity; columns the table lacks are left out."""
    names = entity(entity_name).text_columns
    if available is not None:
        names = [n for n in names if n in available]
    return join_present(*[F.col(n).cast("string") for n in names])


def display_text(c: Column, data_type: T.DataType) -> Column:
    """A value as text: True/False, ISO-like times, bracketed lists."""
    if isinstance(data_type, T.BooleanType):
        return F.initcap(c.cast("string"))
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType)):
        whole = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        fraction = F.date_format(c, "SSSSSS")
        return F.when(fraction == "000000", whole).otherwise(F.concat(whole, F.lit("."), fraction))
    if isinstance(data_type, T.ArrayType):
        return F.concat(F.lit("["), F.array_join(c.cast("array<string>"), ", "), F.lit("]"))
    return c.cast("string")


def iso_text(c: Column, data_type: T.DataType) -> Column:
    """ISO 8601 text of dates and times, with T between the two parts."""
    text = display_text(c, data_type)
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType)):
        return F.regexp_replace(text, " ", "T")
    return text


def index_key(c: Column, data_type: T.DataType, width: int | None = 100) -> Column:
    """Key of the inverted index: the display text, cut to ``width`` characters unless that is None."""
    shown = display_text(c, data_type)
    return shown if width is None else F.left(shown, F.lit(width))


def entity_of_file(path: Column) -> Column:
    """Entity type from a file name; clusters are tested before opinions."""
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    return (
        F.when(name.contains("courts"), "courts")
        .when(name.contains("dockets"), "dockets")
        .when(name.contains("cluster"), "opinion_clusters")
        .when(name.contains("opinions"), "opinions")
        .when(name.contains("citation"), "citations")
        .when(name.contains("people"), "people")
        .otherwise("courts")
    )


def micros(ts: Column) -> Column:
    """Microseconds of a wall-clock time since 1970, without time zone effects."""
    days = F.unix_date(ts.cast("date")).cast("bigint") * 86_400_000_000
    minutes = (F.hour(ts) * 60 + F.minute(ts)).cast("bigint") * 60_000_000
    seconds = (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("bigint")
    return days + minutes + seconds
