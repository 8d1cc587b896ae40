"""Column parsers for bulk CSV values.

A value that does not convert becomes NULL; callers that need an error compare
the raw and the parsed column.  ``wrapped`` says whether the value still has its
surrounding backticks (the bulk reader takes them off).  All parsers are built-in
expressions that stay inside whole-stage code generation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as white space around a value, and as true.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    + "".join(chr(c) for c in range(0x2000, 0x200B))
    + "\u2028\u2029\u202f\u205f\u3000"
)
TRUE_WORDS = ("true", "t", "1", "yes", "y")

# The same characters as a class of a regular expression, without the tab.
SPACE_CLASS = r"\n-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SPACE = rf"[\t{SPACE_CLASS}]*"
_DAY = r"\d{4}-\d{1,2}-\d{1,2}"
_TIME = r" \d{1,2}:\d{1,2}:\d{1,2}(?:\.\d{1,6})?"


def _between_spaces(pattern: str, tail: str = "") -> str:
    """Group 1 is the pattern alone; white space around it and the tail are not."""
    return f"^{_SPACE}({pattern}){tail}{_SPACE}\\z"


INTEGER = _between_spaces(r"[+-]?\d+")
FLOAT = "(?i)" + _between_spaces(r"[+-]?(?:(?:\d+\.?\d*|\.\d+)(?:e[+-]?\d+)?|inf|infinity|nan)")
DATE = _between_spaces(_DAY)
DATETIME = _between_spaces(f"{_DAY}(?:{_TIME})?")
OFFSET_DATETIME = _between_spaces(f"{_DAY}(?:{_TIME})?", r"(?:\+[\s\S]*|Z)?")


def _matched(c: Column, pattern: str) -> Column:
    """The value when it has the right form, else '', which converts to NULL."""
    return F.regexp_extract(c, pattern, 1)


def strip(c: Column) -> Column:
    """Remove white space, Unicode spaces included, from both ends."""
    return F.btrim(c, F.lit(WHITESPACE))


def null_marker(c: Column) -> Column:
    """The export's backslash-N marker becomes NULL."""
    return F.nullif(c, F.lit("\\N"))


def unwrap(c: Column) -> Column:
    """Drop one surrounding pair of backticks; a lone backtick leaves ''."""
    wrapped = c.startswith("`") & c.endswith("`")
    return F.when(wrapped, F.substring(c, F.lit(2), F.greatest(F.length(c) - 2, F.lit(0)))).otherwise(c)


def bare(c: Column, wrapped: bool = True) -> Column:
    """The value without its backticks, where it still has them."""
    return unwrap(c) if wrapped else c


def parse_string(c: Column, wrapped: bool = True) -> Column:
    """Text; NULL becomes '' and the NULL marker is kept as text."""
    return F.coalesce(bare(c, wrapped), F.lit(""))


def parse_integer(c: Column, wrapped: bool = True) -> Column:
    return _matched(bare(c, wrapped), INTEGER).try_cast("bigint")


def parse_float(c: Column, wrapped: bool = True) -> Column:
    return _matched(bare(c, wrapped), FLOAT).try_cast("double")


def parse_boolean(c: Column, wrapped: bool = True) -> Column:
    return F.coalesce(F.lower(strip(bare(c, wrapped))).isin(*TRUE_WORDS), F.lit(False))


def parse_date(c: Column, wrapped: bool = True, times: bool = False) -> Column:
    """Year-month-day; with ``times`` also a timestamp, whose time is dropped."""
    if times:
        return _matched(bare(c, wrapped), DATETIME).try_cast("timestamp_ntz").try_cast("date")
    return _matched(bare(c, wrapped), DATE).try_cast("date")


def parse_datetime(c: Column, wrapped: bool = True, offsets: bool = True) -> Column:
    """Local time; with ``offsets`` a ``+offset`` text or a final Z is discarded."""
    return _matched(bare(c, wrapped), OFFSET_DATETIME if offsets else DATETIME).try_cast("timestamp_ntz")


def literal_pattern(separator: str) -> str:
    """A regular expression for the text itself, short enough for the fast splitter."""
    if len(separator) == 1:
        return separator if separator not in ".$|()[{^?*+\\" else "\\" + separator
    return "\\Q" + separator + "\\E"


def parse_list(c: Column, separator: str = ",") -> Column:
    """Separated items, stripped, empty ones dropped; blank gives an empty array."""
    pieces = F.split(F.coalesce(c, F.lit("")), literal_pattern(separator), -1)
    return F.filter(F.transform(pieces, strip), lambda x: x != "")


def parse_long_list(c: Column) -> Column:
    """A list of ids; items that are no integers are dropped."""
    return F.filter(F.transform(parse_list(c), lambda x: x.try_cast("bigint")), lambda x: x.isNotNull())


def parse_code(c: Column, codes: dict[str, str]) -> Column:
    """A code by its value, else by its name in any case, else NULL."""
    v = strip(c)
    by_name = F.create_map(*[F.lit(x) for name, code in codes.items() for x in (name.lower(), code)])
    return F.when(v.isin(*codes.values()), v).otherwise(F.try_element_at(by_name, F.lower(v)))


def code_or(c: Column, codes: dict[str, str], default: str, wrapped: bool = True) -> Column:
    """The code where it is a known one, else the default."""
    v = bare(c, wrapped)
    return F.when(v.isin(*codes.values()), v).otherwise(F.lit(default))
