from datetime import date, datetime

from pyspark.sql import functions as F

from docketlake.functions import parsing as P
from docketlake.functions import text as X
from docketlake.schemas import OPINION_TYPE, PRECEDENTIAL_STATUS



def test_unwrap_takes_one_pair_and_a_lone_backtick(one):
    assert one(["`a`", "`", "``", "``a``", "a", None, "`a"], P.unwrap(F.col("v"))) == ["a", "", "", "`a`", "a", None, "`a"]


def test_string_keeps_the_null_marker(one):
    assert one([None, "", "`\\N`", "`x `"], P.parse_string(F.col("v"))) == ["", "", "\\N", "x "]


def test_integer(one):
    values = ["`12`", " 12 ", "+5", "-7", "5.0", "abc", "", None, "99999999999999999999", "` `"]
    assert one(values, P.parse_integer(F.col("v"))) == [12, 12, 5, -7, None, None, None, None, None, None]


def test_float(one):
    values = ["`1.5`", "1e3", ".5", "5.", "1d", "1f", "x", ""]
    assert one(values, P.parse_float(F.col("v"))) == [1.5, 1000.0, 0.5, 5.0, None, None, None, None]


def test_boolean(one):
    values = ["`t`", "TRUE", "1", "Yes", "y", "f", "no", "", None, "` t `"]
    assert one(values, P.parse_boolean(F.col("v"))) == [True] * 5 + [False] * 4 + [True]


def test_date(one):
    values = ["`2020-01-02`", "2020-1-2", "2020-02-30", "2020-01-02 03:04:05", "02/01/2020", ""]
    assert one(values, P.parse_date(F.col("v"))) == [date(2020, 1, 2), date(2020, 1, 2), None, None, None, None]
    assert one(["2020-01-02 03:04:05.123", "2020-01-02"], P.parse_date(F.col("v"), False, times=True)) == [date(2020, 1, 2)] * 2


def test_datetime_discards_offset_text(one):
    values = [
        "`2021-01-29 06:20:24.011839+00`",
        "2021-01-29 06:20:24Z",
        "2021-01-29",
        "2021-01-29 06:20:24-05",
        "2021-01-29T06:20:24",
        "2021-01-29 06:20:24.0118391",
    ]
    assert one(values, P.parse_datetime(F.col("v"))) == [
        datetime(2021, 1, 29, 6, 20, 24, 11839),
        datetime(2021, 1, 29, 6, 20, 24),
        datetime(2021, 1, 29),
        None,
        None,
        None,
    ]
    assert one(["2021-01-29 06:20:24+00"], P.parse_datetime(F.col("v"), False, offsets=False)) == [None]


def test_list(one):
    assert one([" a, b ,,c", "", None, "  "], P.parse_list(F.col("v"))) == [["a", "b", "c"], [], [], []]
    assert one(["a.b", "a|b"], P.parse_list(F.col("v"), ".")) == [["a", "b"], ["a|b"]]
    assert one(["1, x,3"], P.parse_long_list(F.col("v"))) == [[1, 3]]


def test_codes(one):
    assert one([" Published", "in_chambers", "IN_CHAMBERS", "nope", ""], P.parse_code(F.col("v"), PRECEDENTIAL_STATUS)) == [
        "Published",
        "In-chambers",
        "In-chambers",
        None,
        None,
    ]
    assert one(["`020lead`", "LEAD", None], P.code_or(F.col("v"), OPINION_TYPE, "999unknown")) == [
        "020lead",
        "999unknown",
        "999unknown",
    ]


def test_strip_takes_unicode_spaces(one):
    assert one(["\u00a0 \u2003x y\x85\x1c"], P.strip(F.col("v"))) == ["x y"]


def test_clean_text(one):
    assert one(["  text with\x00null bytes  ", None, "a\tb\nc\rd\x07"], X.clean_text(F.col("v"))) == [
        "text withnull bytes",
        "",
        "a\tb\ncd",
    ]


def test_cleaning_rule_switches(one):
    keep_nul = X.CleaningRule(remove_null_bytes=False, trim_whitespace=False)
    assert one([" a\x00\x01 "], keep_nul.apply(F.col("v"))) == [" a\x00 "]
    only_nul = X.CleaningRule(remove_control_chars=False, trim_whitespace=False)
    assert one([" a\x00\x01 "], only_nul.apply(F.col("v"))) == [" a\x01 "]
    patterns = X.CleaningRule(remove_patterns=(r"\d+",), replace_patterns={"b": "B"})
    assert one(["a1b22"], patterns.apply(F.col("v"))) == ["aB"]


def test_invalid_utf8_is_dropped(spark):
    df = spark.sql("SELECT CAST(X'61FF62' AS STRING) AS v")
    assert df.select(X.clean_text(F.col("v"))).head()[0] == "ab"


def test_clean_columns_range_and_compat(one):
    columns = F.transform(F.sequence(F.lit(0), F.lit(20)), lambda i: F.lit(" x"))
    cleaned = one(["r"], X.clean_columns(columns))[0]
    assert [i for i, v in enumerate(cleaned) if v == "x"] == list(range(12, 19))
    short = F.slice(columns, 1, 15)
    assert one(["r"], X.changed_positions(short, X.clean_columns(short))) == [3]
    assert one(["r"], X.changed_positions(short, X.clean_columns(short, compat=True))) == [0]


def test_parties(one):
    p = lambda a, b, compat=False: one(["x"], X.parties(F.lit(a), F.lit(b), compat))[0]
    assert p("Smith", "Jones") == "Smith vs Jones"
    assert p("Jones", "") == "Jones"
    assert p("", "Roe") == "Roe"
    assert p("", "") is None
    assert p("Jones", "", True) == "Jone"
    assert p("vs", "", True) == ""


def test_names_and_labels(one):
    name = X.full_name(F.lit("Ruth"), F.lit(""), F.lit("Ginsburg"), F.lit(None).cast("string"))
    assert one(["x"], name) == ["Ruth Ginsburg"]
    assert one(["x"], X.court_label(F.lit("Federal"), F.lit("SCOTUS"))) == ["Federal - SCOTUS"]
    assert one(["12"], X.case_label(F.col("v"))) == ["Case 12"]


def test_entity_of_file(one):
    files = ["/x/opinions/Opinion-Clusters-2024.csv.bz2", "a/opinions.csv", "dockets.csv", "citation-map.csv", "zzz"]
    assert one(files, X.entity_of_file(F.col("v"))) == ["opinion_clusters", "opinions", "dockets", "citations", "courts"]


def test_display_and_iso_text(spark):
    row = spark.sql(
        "SELECT true AS b, TIMESTAMP_NTZ'2020-01-02 03:04:05' AS t, TIMESTAMP_NTZ'2020-01-02 03:04:05.0012' AS u, array(1, 2) AS a"
    )
    types = {f.name: f.dataType for f in row.schema}
    shown = row.select(*[X.display_text(F.col(c), types[c]) for c in types]).head()
    assert tuple(shown) == ("True", "2020-01-02 03:04:05", "2020-01-02 03:04:05.001200", "[1, 2]")
    assert row.select(X.iso_text(F.col("u"), types["u"])).head()[0] == "2020-01-02T03:04:05.001200"


def test_micros_has_no_time_zone(spark):
    df = spark.sql("SELECT TIMESTAMP_NTZ'1970-01-02 00:00:01.000005' AS t")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert df.select(X.micros(F.col("t"))).head()[0] == 86_401_000_005
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
