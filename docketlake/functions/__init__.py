from docketlake.functions.parsing import (
    parse_boolean,
    parse_code,
    parse_date,
    parse_datetime,
    parse_float,
    parse_integer,
    parse_list,
    parse_string,
    strip,
    unwrap,
)
from docketlake.functions.text import (
    CleaningRule,
    clean_columns,
    clean_text,
    full_name,
    index_key,
    join_present,
    micros,
    plain_text_of,
)

__all__ = [
    "CleaningRule",
    "clean_columns",
    "clean_text",
    "full_name",
    "index_key",
    "join_present",
    "micros",
    "parse_boolean",
    "parse_code",
    "parse_date",
    "parse_datetime",
    "parse_float",
    "parse_integer",
    "parse_list",
    "parse_string",
    "plain_text_of",
    "strip",
    "unwrap",
]
