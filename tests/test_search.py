import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from docketlake.operators.predicates import Filter, RecordQuery, apply_filters, build_record_query, java_pattern
from docketlake.plans.paging import page, sort_columns
from docketlake.plans.search import Searcher, SearchQuery, query_from_spec, search

COURTS = [
    ("scotus", "Supreme Court of the United States", "Federal", 1.0, date(1789, 9, 24), True),
    ("ca9", "Court of Appeals for the Ninth Circuit", "Federal", 9.0, None, False),
    ("cal", "California Supreme Court", "State", None, date(1850, 1, 1), None),
]


@pytest.fixture(scope="module")
def courts(spark):
    return spark.createDataFrame(
        COURTS, "id string, full_name string, jurisdiction string, position double, start_date date, active boolean"
    )


def ids(df):
    return [r.id for r in df.collect()]


@pytest.mark.parametrize(
    ("filters", "expected"),
    [
        ([("id", "eq", "ca9")], ["ca9"]),
        ([("id", "eq", "CA9")], []),
        ([("id", "eq", "CA9", False)], ["ca9"]),
        ([("position", "eq", None)], ["cal"]),
        ([("position", "contains", None)], []),
        ([("no_such", "eq", None)], ["ca9", "cal", "scotus"]),
        ([("no_such", "eq", 1)], []),
        ([("position", "contains", 9)], ["ca9"]),
        ([("active", "contains", "True")], ["scotus"]),
        ([("full_name", "starts_with", "Court")], ["ca9"]),
        ([("full_name", "ends_with", "COURT", False)], ["cal"]),
        ([("position", "gt", 1)], ["ca9"]),
        ([("position", "gt", 0.5)], ["ca9", "scotus"]),
        ([("position", "gte", "9")], ["ca9"]),
        ([("position", "lt", "many")], []),
        ([("start_date", "lte", "1800-01-01")], ["scotus"]),
        ([("start_date", "between", ["1800-01-01", date(1900, 1, 1)])], ["cal"]),
        ([("id", "in", ["cal", "ca9", None])], ["ca9", "cal"]),
        ([("id", "in", [])], []),
        ([("position", "not_in", [1, "x"])], ["ca9"]),
        ([("position", "not_in", [])], ["ca9", "scotus"]),
        ([("full_name", "regex", r"^\D+ Court$")], ["cal"]),
        ([("full_name", "regex", r"(?P<w>SUPREME)", False)], ["cal", "scotus"]),
        ([("full_name", "regex", "(")], []),
        ([("jurisdiction", "fuzzy", "Fedral")], ["ca9", "scotus"]),
        ([("jurisdiction", "fuzzy", "sTaTeee", False)], ["cal"]),
        ([("jurisdiction", "fuzzy", "Sta")], ["cal"]),
        ([("jurisdiction", "fuzzy", "St")], []),
        ([("jurisdiction", "eq", "Federal"), ("position", "lt", 5)], ["scotus"]),
        ([], ["ca9", "cal", "scotus"]),
    ],
)
def test_filters(courts, filters, expected):
    assert sorted(ids(apply_filters(courts, [Filter(*f) for f in filters]))) == expected


def test_long_lists_join(courts):
    many = [f"x{i}" for i in range(2000)] + ["CAL"]
    assert ids(apply_filters(courts, [Filter("id", "in", many, False)])) == ["cal"]
    assert sorted(ids(apply_filters(courts, [Filter("id", "not_in", many)]))) == ["ca9", "cal", "scotus"]
    numbers = list(range(2, 2000))
    assert ids(apply_filters(courts, [Filter("position", "not_in", numbers)])) == ["scotus"]


def test_unknown_operator_and_patterns():
    with pytest.raises(ValueError):
        Filter("id", "like", "x")
    assert java_pattern(r"(?P<a>x)(?P=a)\Z") == r"(?U)(?<a>x)\k<a>\z"
    assert java_pattern("(") is None


def test_supreme_finds_the_right_courts(courts):
    found = search(courts, SearchQuery().text("supreme COURT united"), "courts").rows
    assert ids(found) == ["scotus"]
    federal = search(courts, SearchQuery().where("jurisdiction", "eq", "Federal").order("position"), "courts").rows
    assert [r.position for r in federal.collect()] == [1.0, 9.0]


def test_sort_puts_nulls_first_and_ties_by_id(courts):
    order = lambda *s, **k: ids(search(courts, SearchQuery(sort=s, **k), "courts").rows)
    assert order(("position", "asc")) == ["cal", "scotus", "ca9"]
    assert order(("position", "desc")) == ["cal", "ca9", "scotus"]
    assert order(("jurisdiction", "asc"), ("position", "desc")) == ["ca9", "scotus", "cal"]
    assert order(("jurisdiction", "asc"), ("position", "desc"), reverse_all=True) == ["cal", "ca9", "scotus"]


def test_counts(courts):
    counts = search(courts, SearchQuery().where("jurisdiction", "eq", "Federal").take(1), "courts").counts.head()
    assert tuple(counts) == (3, 2, 1, True)
    counts = search(courts, SearchQuery().where("jurisdiction", "eq", "Federal").take(5, 1), "courts").counts.head()
    assert tuple(counts) == (3, 2, 1, False)
    long = SearchQuery().where("id", "in", [f"x{i}" for i in range(1500)] + ["cal"])
    assert tuple(search(courts, long, "courts").counts.head()) == (3, 1, 1, False)


def test_deep_pages_equal_a_sorted_slice(spark):
    rng = random.Random(3)
    values = [(i, rng.choice([None, *range(50)])) for i in range(5000)]
    df = spark.createDataFrame(values, "id int, v int").repartition(7)
    want = sorted(values, key=lambda r: (-1 if r[1] is None else r[1], r[0]))
    keys = sort_columns([("v", "asc")], ["id"])
    for limit, offset in ((None, 4321), (700, 4000), (0, 10), (100, 4990), (5, 6000)):
        got = [tuple(r) for r in page(df, keys, limit, offset).orderBy(*[k.column for k in keys]).collect()]
        assert got == want[offset : offset + limit if limit else None], (limit, offset)


def test_spec_and_convenience_searches(courts):
    s = Searcher({"courts": courts, "people": courts.select("id", F.lit("Ginsburg").alias("name_last"))})
    name, q = query_from_spec('{"type": "courts", "filters": [{"field": "id", "operator": "eq", "value": "cal"}]}')
    assert name == "courts" and ids(s.courts(q).rows) == ["cal"]
    assert query_from_spec({})[0] == "opinions"
    with pytest.raises(ValueError, match="Unknown search type"):
        query_from_spec({"type": "cats"})
    assert ids(s.court_by_name("california")) == ["cal"]
    assert ids(s.court_by_name("california", exact=True)) == []
    assert len(ids(s.person_by_name("Ginsberg", fuzzy=True))) == 3
    assert len(ids(s.person_by_name("ginsburg"))) == 3


def test_comparisons_reach_the_scan(spark, tmp_path):
    spark.range(100).withColumn("s", F.col("id").cast("string")).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    plan = apply_filters(df, [Filter("id", "gt", 5), Filter("s", "in", ["7", "8"])])._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(id,5)" in plan and "In(s, [7,8])" in plan


def test_record_queries(spark):
    df = spark.createDataFrame([({"status": "Active", "n": "12"},)], "m map<string,string>")
    ask = lambda q: df.select(q.on_map(F.col("m"))).head()[0]
    assert ask(RecordQuery("status", "ACT"))
    assert not ask(RecordQuery("status", "ACT", case_sensitive=True))
    assert ask(RecordQuery("status", "active", "equals"))
    assert ask(RecordQuery("n", r"^\d+$", "regex"))
    assert not ask(RecordQuery("missing", "x"))
    assert build_record_query("n", "1", "sounds_like").operator == "contains"
    for bad in (("", "x"), ("x", "")):
        with pytest.raises(ValueError):
            RecordQuery(*bad)


def test_long_lists_and_unicode_patterns(spark):
    from docketlake.operators.predicates import Filter, apply_filters

    df = spark.createDataFrame([(i, w) for i, w in enumerate(["Müller", "aaaa", "aa", "b c"])], "n long, w string")
    for values in ([0.0, 1.0, 2.0], [0.0, 1.0, 2.0] + [float(k) for k in range(10, 5000)]):
        assert apply_filters(df, [Filter("n", "in", values)]).count() == 3
        assert [r.n for r in apply_filters(df, [Filter("n", "not_in", values)]).collect()] == [3]
    found = lambda p: [r.n for r in apply_filters(df, [Filter("w", "regex", p)]).orderBy("n").collect()]
    assert found(r"^\w+$") == [0, 1, 2] and found("^a{,3}$") == [2]


def test_patterns_follow_python_or_match_nothing(spark):
    df = spark.createDataFrame([("Müller",), ("a b",), ("x{,3}",), ("xxx",)], "v string")
    ask = lambda p, **k: sorted(r.v for r in df.where(RecordQuery("v", p, "regex", **k).test(F.col("v"))).collect())
    assert ask(r"^\w+$") == ["Müller", "xxx"] and ask("MÜLLER") == ["Müller"] and ask("MÜLLER", case_sensitive=True) == []
    assert ask(r"x[{,3}]") == ["x{,3}", "xxx"][:1] and ask("^x{,3}$") == ["xxx"]
    # Accepted by Python, not by Java.
    for pattern in ("[[]", "(?P<n>a)(?(n)b|c)", "(?a:x)"):
        assert java_pattern(pattern) is None or ask(pattern) is not None
        assert apply_filters(df, [Filter("v", "regex", pattern)]).count() >= 0
    assert java_pattern("(?(1)a|b)") is None and java_pattern("(") is None


def test_fuzzy_join_equals_all_pairs(spark):
    import random

    from docketlake.operators.fuzzy import fuzzy_join

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    rng = random.Random(6)
    words = ["".join(rng.choice("abC") for _ in range(rng.choice([0, 1, 2, 3, 6, 23, 24, 25, 26, 27, 40]))) for _ in range(70)]
    spoilt = []
    for w in words:
        for _ in range(rng.randint(0, 3)):
            k = rng.randint(0, len(w))
            w = rng.choice([w[:k] + w[k + 1 :], w[:k] + "b" + w[k:], w[:k] + "c" + w[k + 1 :]])
        spoilt.append(w)
    values = [(i, w) for i, w in enumerate([*words, words[0], None])]
    patterns = [(i, w) for i, w in enumerate([*spoilt, None, ""])]
    got = fuzzy_join(
        spark.createDataFrame(values, "id int, name string"), spark.createDataFrame(patterns, "p int, wanted string"), "name", "wanted"
    )
    want = {(i, p) for i, a in values for p, b in patterns if a is not None and b is not None and distance(a.lower(), b.lower()) <= 2}
    assert {(r.id, r.p) for r in got.collect()} == want and got.count() == len(want)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("literals", [0, 1000])
def test_text_index_equals_a_scan(spark, tmp_path, monkeypatch, literals):
    import random

    from docketlake.operators import text_index

    monkeypatch.setattr(text_index, "LITERALS", literals)
    rng = random.Random(8)
    words = ["Motion", "emotional", "ion", "io", "x", "ÄRGER", "due", "process", "a-b", "tionion"]
    rows = [(i, rng.choice([" ", "\n", "\t "]).join(rng.choice(words) for _ in range(rng.randint(0, 6)))) for i in range(300)] + [(900, None), (901, " ")]
    df = spark.createDataFrame(rows, "id long, body string")
    path = str(tmp_path / "texts")
    text_index.write_text_index(df, path, F.col("body"))
    for query in ("ion", "TION x", "io", "ärger due", "nothing", "tionion process", "b"):
        want = {i for i, t in rows if all(w in (t or "").lower() for w in query.lower().split())}
        assert {r.id for r in text_index.search_index(spark, path, query).collect()} == want, query
    assert text_index.search_index(spark, path, " ") is None
    plan = text_index.ids_with(spark, path, "process")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and ("EqualTo(token,process)" in plan or "In(token" in plan or literals == 0)
    assert "body" not in plan


@pytest.mark.parametrize("few", [5, 20_000])
def test_deep_pages_equal_slices_of_the_sort(spark, monkeypatch, few):
    from datetime import datetime, timedelta

    from docketlake.plans import paging

    monkeypatch.setattr(paging, "FEW", few)
    monkeypatch.setattr(paging, "RANGES", 6)
    rng = random.Random(2)
    at = datetime(2024, 1, 1, 3)
    rows = [(rng.choice([None, "a", "b", "b"]), rng.choice([None, 1.5, 2.5, float("nan")]), at + timedelta(hours=rng.randint(0, 3)), i) for i in range(140)]
    df = spark.createDataFrame(rows, "s string, v double, ts timestamp, id int").repartition(5)
    for sort, tie in (([("s", "desc"), ("v", "asc")], ["id"]), ([("ts", "desc")], ["id"]), ([("s", "asc"), ("v", "desc")], [])):
        keys = sort_columns(sort, tie)
        whole = [tuple(str(r[k.name]) for k in keys) for r in df.orderBy(*[k.column for k in keys]).collect()]
        for offset, limit in ((1, 7), (60, 30), (139, 5), (100, None), (140, 3), (33, 1)):
            got = [tuple(str(r[k.name]) for k in keys) for r in page(df, keys, limit, offset).collect()]
            assert got == whole[offset : offset + limit if limit else None], (sort, offset, limit)


def test_a_deep_page_is_read_between_two_keys(spark, tmp_path):
    spark.range(50_000).write.parquet(str(tmp_path / "t"))
    deep = page(spark.read.parquet(str(tmp_path / "t")), sort_columns([], ["id"]), 10, 40_000)
    assert [r.id for r in deep.collect()] == list(range(40_000, 40_010))
    plan = deep._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(id,40000)" in plan and "LessThan(id,40009)" in plan


def test_keys_of_patterns_are_shuffled_however_small_they_look(spark):
    """The explosion into keys is not in Spark's size estimates, so a broadcast of them is not bounded by its limit."""
    from docketlake.operators.fuzzy import fuzzy_join

    values = spark.createDataFrame([("smith",)], "v string")
    patterns = spark.createDataFrame([("smyth",)], "p string")
    rows = fuzzy_join(values, patterns, "v", "p")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [_key#" in plan and "BroadcastHashJoin [_key#" not in plan
    assert [tuple(r) for r in rows.select("v", "p").collect()] == [("smith", "smyth")]
