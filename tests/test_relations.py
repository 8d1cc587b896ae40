from collections import defaultdict, deque
import random

import pytest
from pyspark.sql import functions as F

from docketlake.operators import index as I
from docketlake.operators import joins as J
from docketlake.operators import tables as T
from docketlake.operators.network import citation_network


@pytest.fixture(scope="module")
def case_tables(spark):
    """Docket 1 owns most clusters and cluster 10 most opinions; some own nothing."""
    dockets = [(i, f"case {i}") for i in range(1, 6)]
    clusters = [(c, 1 if c < 40 else c % 4 + 1) for c in range(10, 50)] + [(90, 77)]
    opinions = [(o, 10 if o < 160 else o % 45) for o in range(100, 220)]
    return (
        spark.createDataFrame(dockets, "id long, case_name string"),
        spark.createDataFrame(clusters, "id long, docket_id long"),
        spark.createDataFrame(opinions, "id long, cluster_id long"),
        (dockets, clusters, opinions),
    )


def expected_rows(dockets, clusters, opinions):
    rows = []
    for d, _ in dockets:
        mine = [c for c, p in clusters if p == d]
        if not mine:
            rows.append((d, None, None))
        for c in mine:
            inside = [o for o, p in opinions if p == c]
            rows += [(d, c, o) for o in inside] or [(d, c, None)]
    return sorted(rows, key=str)


def test_flat_hierarchy(case_tables):
    d, c, o, plain = case_tables
    rows = J.case_hierarchy(d, c, o).select("docket_id", "cluster_id", "opinion_id").collect()
    assert sorted((tuple(r) for r in rows), key=str) == expected_rows(*plain)
    one = J.case_hierarchy(d, c, o, [2]).select("docket_id").distinct().collect()
    assert [r[0] for r in one] == [2]
    assert J.case_hierarchy(d, c, o, [999]).count() == 0


@pytest.mark.parametrize("page_rows", [3, 1000])
def test_nested_hierarchy_pages_hold_everything(case_tables, page_rows):
    d, c, o, plain = case_tables
    rows = J.nested_hierarchy(d, c, o, page_rows=page_rows).collect()
    flat = []
    for r in rows:
        if not r.clusters:
            flat.append((r.docket_id, None, None))
        for k in r.clusters:
            flat += [(r.docket_id, k.cluster_id, x.opinion_id) for x in k.opinions] or [(r.docket_id, k.cluster_id, None)]
    assert sorted(flat, key=str) == expected_rows(*plain)
    pages = defaultdict(set)
    for r in rows:
        pages[r.docket_id].add(r.clusters_pages)
    assert pages[1] == ({1} if page_rows == 1000 else {max(pages[1])}) and max(pages[1]) >= (1 if page_rows == 1000 else 10)


def test_lookups(case_tables):
    d, c, o, (_, _, plain) = case_tables
    assert J.clusters_of_docket(c, [2]).count() == J.clusters_of_docket(c, d.where("id = 2").select("id")).count() == 3
    assert J.load_batch(d, [1, 2, 999]).count() == 2
    assert J.exists(d, 1) and not J.exists(d, 999)
    assert J.opinions_of_cluster(o, [10]).count() == sum(p == 10 for _, p in plain)


def naive_network(edges, seed, depth):
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    found, queue = {seed: 0}, deque([seed])
    while queue:
        n = queue.popleft()
        if found[n] < depth:
            for m in near[n]:
                if m not in found:
                    found[m] = found[n] + 1
                    queue.append(m)
    return found


@pytest.mark.parametrize("depth", [0, 1, 2, 3])
def test_network_equals_a_plain_search(spark, depth):
    rng = random.Random(depth)
    # Opinion 1 is a hub with a third of all citations; there are cycles and self-citations.
    edges = [(1, rng.randint(2, 60)) for _ in range(40)] + [(rng.randint(1, 60), rng.randint(1, 60)) for _ in range(60)] + [(7, 7)]
    citations = spark.createDataFrame(
        [(a, b, 1, False) for a, b in edges], "citing_opinion_id long, cited_opinion_id long, depth int, quoted boolean"
    )
    seeds = spark.createDataFrame([(1,), (7,), (500,)], "id long")
    known = spark.createDataFrame([(i,) for i in range(0, 61, 2)], "id long")
    net = citation_network(citations, seeds, depth, known)
    visited = {(r.seed_id, r.node): r.depth for r in net.visited.collect()}
    balls = {s: naive_network(edges, s, depth) for s in (1, 7, 500)}
    assert visited == {(s, n): d for s, ball in balls.items() for n, d in ball.items()}
    assert {(r.seed_id, r.node) for r in net.nodes.collect()} == {k for k in visited if k[1] % 2 == 0 and k[1] <= 60}
    touching = {(s, a, b) for s, ball in balls.items() for a, b in edges if a in ball or b in ball}
    got = [(r.seed_id, r.citing_opinion_id, r.cited_opinion_id) for r in net.edges.collect()]
    assert len(got) == len(touching) and set(got) == touching


def test_citations_of_opinion_show_self_citation_twice(spark):
    c = spark.createDataFrame([(1, 2), (2, 1), (1, 1), (3, 4)], "citing_opinion_id long, cited_opinion_id long")
    rows = sorted(tuple(r) for r in J.citations_of_opinion(c, [1]).collect())
    assert rows == [("incoming", 1, 1), ("incoming", 2, 1), ("outgoing", 1, 1), ("outgoing", 1, 2)]


def files_of(path):
    return {p.parent.name: {q.name for q in p.parent.glob("*.parquet")} for p in path.rglob("*.parquet")}


def test_upsert_and_delete_write_the_buckets_they_touch(spark, tmp_path):
    path = str(tmp_path / "t")
    assert T.read_table(spark, path) is None
    df = lambda *rows: spark.createDataFrame(rows, "id long, v string, n int")
    T.upsert(path, df(*[(i, f"a{i}", 1) for i in range(200)]), ["id"], [F.col("n")])
    before = files_of(tmp_path / "t")
    assert len(before) == 16
    now = T.upsert(path, df((2, "x", 1), (2, "y", 2)), ["id"], [F.col("n").desc()])
    after = files_of(tmp_path / "t")
    assert len([b for b in after if before[b] != after[b]]) == 1  # one key, one bucket
    assert now.count() == 200 and [r.v for r in now.where("id = 2").collect()] == ["y"]
    assert now.columns == ["id", "v", "n"]
    more = T.upsert(path, spark.createDataFrame([(2, 3), (777, 4)], "id int, n int"), ["id"], [F.col("n")])
    assert {r.id: (r.v, r.n) for r in more.where("id in (2, 3, 777)").collect()} == {2: (None, 3), 3: ("a3", 1), 777: (None, 4)}
    before = files_of(tmp_path / "t")
    left = T.delete(path, spark.createDataFrame([(1,), (5000,)], "id long"))
    changed = [b for b, names in before.items() if files_of(tmp_path / "t").get(b) != names]
    assert left.count() == 200 and left.where("id = 1").count() == 0 and 1 <= len(changed) <= 2
    wider = T.upsert(path, df((3, "z", 9)).withColumn("w", F.lit(7)), ["id"], [F.col("n")])
    assert {r.id: r.w for r in wider.where("id in (3, 4)").collect()} == {3: 7, 4: None}
    with pytest.raises(ValueError, match="order"):
        T.upsert(path, df((1, "a", 1)), ["id"], [])
    with pytest.raises(ValueError, match="keyed by"):
        T.upsert(path, df((1, "a", 1)), ["v"], [F.col("n")])


def test_a_bucket_may_become_empty(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([(i, i % 3, "v") for i in range(6)], "a int, b int, v string")
    T.upsert(path, rows, ["a", "b"], [F.col("v")], buckets=64)
    assert T.layout(spark, path) == (["a", "b"], 64)
    left = T.delete(path, spark.createDataFrame([(0, 0), (4, 1)], "a int, b int"))
    assert sorted(r.a for r in left.collect()) == [1, 2, 3, 5]
    left = T.delete(path, spark.createDataFrame([(2,)], "b int"))  # not the whole key: all buckets
    assert sorted(r.a for r in left.collect()) == [1, 3]
    assert len(files_of(tmp_path / "t")) <= 2


def test_versions_of_tables_without_a_key(spark, tmp_path):
    path = str(tmp_path / "t")
    T.write_table(spark.range(3), path)
    now = T.write_table(spark.range(5), path)
    # A version without its success marker was never finished.
    now.write.parquet(f"{path}/v9")
    (tmp_path / "t" / "v9" / "_SUCCESS").unlink()
    assert T.read_table(spark, path).count() == 5
    T.write_table(spark.range(1), path)
    assert "v10" in {p.name for p in (tmp_path / "t").iterdir()}


def test_merge_accepts_new_columns(spark):
    old = spark.createDataFrame([(1, "a")], "id long, v string")
    new = spark.createDataFrame([(2, "b", 5)], "id long, v string, w int")
    assert sorted((r.id, r.w) for r in T.merge(old, new, ["id"], [F.col("w")]).collect()) == [(1, None), (2, 5)]


def test_lookups_in_a_stored_index_reach_the_scan(spark, tmp_path):
    path, changes = str(tmp_path / "index"), str(tmp_path / "changes")
    rows = spark.createDataFrame([(i, f"v{i % 10}", None if i % 2 else "x") for i in range(500)], "id long, a string, b string")
    I.write_index(rows, path)
    found = I.index_lookup(spark.read.parquet(path), "a", "v3")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(value,v3)" in plan and "(field" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert sorted(r.id for r in found.collect()) == list(range(3, 500, 10))
    spark.createDataFrame([(3, "v4", "x"), (13, "v3", "x"), (900, "v3", None)], rows.schema).write.parquet(f"{changes}/batch_id=0")
    assert I.update_index(spark, path, changes) == [0]
    spark.createDataFrame([(13, "v5", "x"), (4, "v3", "x")], rows.schema).write.parquet(f"{changes}/batch_id=1")
    assert I.update_index(spark, path, changes) == [1] and I.update_index(spark, path, changes) == []
    now = sorted(r.id for r in I.current_lookup(spark, path, changes, "a", "v3").collect())
    assert now == sorted({*range(23, 500, 10), 4, 900})
    assert 13 not in {r.id for r in I.current_lookup(spark, path, changes, "a", "v3").collect()}


def test_seeds_share_bitmaps(spark):
    """More seeds than a word has bits; a word of bits per node, whatever the number of seeds in it."""
    import networks_plain as plain

    rng = random.Random(4)
    rows = [(rng.randint(1, 150), rng.randint(1, 150), 1, False) for _ in range(260)]
    cites = spark.createDataFrame(rows, "citing_opinion_id long, cited_opinion_id long, depth int, quoted boolean")
    seeds = spark.createDataFrame([(i,) for i in range(1, 140)] + [(5,), (None,)], "id long")
    got = {(r.seed_id, r.node): r.depth for r in citation_network(cites, seeds, 3).visited.collect()}
    assert got == plain.distances(rows, range(1, 140), 3)


def test_json_text_round_trip(spark):
    from docketlake.schemas import entity

    df = spark.sql(
        "SELECT 1L AS id, DATE'2020-01-02' AS date_filed, TIMESTAMP_NTZ'2020-01-02 03:04:05.000600' AS date_created, array(1L, 2L) AS sub_opinions"
    )
    text = T.to_json_text(df)
    assert text.head()[0] == '{"id":1,"date_filed":"2020-01-02","date_created":"2020-01-02T03:04:05.000600","sub_opinions":[1,2]}'
    back = T.from_json_text(text, entity("opinion_clusters").schema(), data_type="opinion_clusters").head()
    assert (back.id, str(back.date_created), back.sub_opinions, back.blocked, back.citation_count) == (1, "2020-01-02 03:04:05.000600", [1, 2], False, 0)


def test_payloads_replace_only_their_data_set(spark, tmp_path):
    path = str(tmp_path / "p")
    T.save_payload(spark.createDataFrame([(1, "a"), (2, "b")], "x int, dataset_id string"), path)
    T.save_payload(spark.createDataFrame([(9,)], "x int"), path, "a")
    assert [r.x for r in T.load_payload(spark, path, "a").collect()] == [9]
    assert [r.x for r in T.load_payload(spark, path, "b").collect()] == [2]
    assert sorted(r[0] for r in T.list_datasets(spark, path).collect()) == ["a", "b"]


def test_index_splits_large_values_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(I, "BLOCK_IDS", 10)
    df = spark.createDataFrame([(i, i % 3 == 0, "x" * 150, None if i % 2 else "v") for i in range(100)], "id long, f boolean, long string, v string")
    index = I.inverted_index(df)
    assert index.agg(F.max("n_ids")).head()[0] <= 10
    assert sorted(r.id for r in I.index_lookup(index, "f", "True").collect()) == list(range(0, 100, 3))
    assert I.index_lookup(index, "long", "x" * 150).count() == 100
    assert I.index_lookup(index, "v", "v").count() == 50
    assert {r.field for r in index.collect()} == {"id", "f", "long", "v"}
    assert I.find_by_field(df, "f", True).count() == 34
    assert [I.find_by_field(df, "long", "x" * n).count() for n in (120, 150)] == [0, 100]
    assert I.find_by_field(df, "long", "x" * 120, key_length=100).count() == 100
    assert I.index_lookup(index, "long", "x" * 120).count() == 0
    assert I.index_lookup(I.inverted_index(df, key_length=100), "long", "x" * 120, 100).count() == 100
    assert I.find_by_field(df, "id", 5).count() == 1
    assert I.find_by_field(df, "none", 5).count() == 0


def test_courts_named_once(spark):
    courts = spark.createDataFrame([("a", "Federal", "Federal"), ("b", "X", "Federal"), ("c", "X", "Y")], "id string, full_name string, jurisdiction string")
    assert sorted(r.id for r in I.courts_named(courts, "Federal").collect()) == ["a", "b"]


def test_a_parent_with_many_children_nests_in_pages_of_bytes(spark):
    """One parent holds most children; no page is beyond the bound and one child, and pages follow the order of ids."""
    children = spark.range(100_000).select(
        F.when(F.col("id") % 10 == 0, F.col("id") % 7).otherwise(F.lit(3)).alias("docket_id"),
        F.col("id").alias("cluster_id"),
        F.repeat(F.lit("x"), (F.col("id") % 50).cast("int")).alias("text"),
    )
    children = children.unionByName(spark.createDataFrame([(None, 5, "lost")], children.schema))
    parents = spark.range(9).select(F.col("id").alias("docket_id"))
    rows = J.nest_by_bytes(parents, children, "docket_id", "cluster_id", "clusters", 20_000, rows_per_range=9000)
    size = F.aggregate("clusters", F.lit(0), lambda s, c: s + F.octet_length(F.to_json(c)))
    found = rows.select("docket_id", "clusters_page", "clusters_pages", size.alias("bytes"), F.col("clusters.cluster_id").alias("ids"))
    got = {}
    for r in found.orderBy("docket_id", "clusters_page").collect():
        assert r.bytes <= 20_000 + 100
        assert r.clusters_page == len([1 for k in got if k[0] == r.docket_id])
        got[r.docket_id, r.clusters_page] = r.ids
    ids = lambda d: [i for (k, _), page in got.items() if k == d for i in page]
    want = [i for i in range(100_000) if i % 10 or i % 7 == 3]
    assert ids(3) == want and len([k for k in got if k[0] == 3]) > 100
    assert ids(8) == [] and (8, 0) in got and sum(map(len, got.values())) == 100_000


@pytest.mark.parametrize("most", [1_000_000, 3])
def test_a_link_carries_one_row_for_all_its_seeds(spark, monkeypatch, most):
    """Packed rows hold sparse and dense words, hubs are united in parts, and the levels are those of a plain search."""
    from docketlake.operators import network as N

    monkeypatch.setattr(N, "HUB_LINKS", most)
    draw = random.Random(5)
    edges = {(draw.randrange(300), 300 + draw.randrange(60)) for _ in range(900)} | {(i, 300) for i in range(300)}
    citations = spark.createDataFrame([(a, b, 1, False) for a, b in edges], "citing_opinion_id long, cited_opinion_id long, depth int, quoted boolean")
    seeds = spark.createDataFrame([(i,) for i in range(300)], "id long")
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    want = set()
    for s in range(300):
        seen, queue = {s: 0}, deque([s])
        while queue:
            at = queue.popleft()
            for n in near[at] if seen[at] < 3 else ():
                if n not in seen:
                    seen[n] = seen[at] + 1
                    queue.append(n)
        want |= {(s, n, d) for n, d in seen.items()}
    got = [tuple(r) for r in N.reachable(citations, seeds, 3).select("seed_id", "node", "depth").collect()]
    assert len(got) == len(want) and set(got) == want
    level = N.numbered(seeds).groupBy(F.lit(7).alias("node"), "word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("mask"))
    packed = N._packed(level)
    assert packed.count() == packed.select("chunk").distinct().count()
    assert N._unpacked(packed).select("node", "word", "mask").exceptAll(level).count() == 0


@pytest.mark.parametrize("small", [False, True])
def test_distances_of_mixed_surroundings(spark, monkeypatch, small):
    """Ids of any size, hubs, repeated and missing ends, with and without tiles, rows and pieces of a few ids."""
    import networks_plain as plain
    from docketlake.operators import network as N
    from docketlake.operators import reach as R

    if small:
        for name, n in {"ROW": 3, "PIECE": 50, "TILE": 40, "HELD": 60, "CHUNK": 20, "LINK_TILES": 4}.items():
            monkeypatch.setattr(R, name, n)
    draw = random.Random(9)
    far = [-(2**63), 2**63 - 1, -5, 0, 2**40]
    ids = [*range(1, 60), *far]
    ends = [(draw.choice(ids), draw.choice(ids)) for _ in range(150)] + [(7, draw.choice(ids)) for _ in range(60)]
    ends += [(8, 8), (9000, 9001), (9000, 9001)]
    rows = [(a, b, 1, False) for a, b in ends] + [(None, 3, 1, False), (3, None, 1, False)]
    cites = spark.createDataFrame(rows, "citing_opinion_id long, cited_opinion_id long, depth int, quoted boolean")
    own = [*range(1, 40), *far, 8, 9001, 77777]
    seeds = spark.createDataFrame([(i,) for i in [*own, 5, None]], "id long")
    for depth in (0, 1, 3):
        want = plain.distances(ends, own, depth)
        got = [tuple(r) for r in N.reachable(cites, seeds, depth).select("seed_id", "node", "depth").collect()]
        assert len(got) == len(want) and {(s, n): d for s, n, d in got} == want
    nobody = [r for r in N.reachable(cites, seeds.where("id is null"), 2).collect()]
    assert nobody == [] and N.reachable(cites.where("false"), seeds, 2).count() == len(set(own))


def test_steps_over_links_are_no_rows(spark):
    """A tile gets a row per piece; a list goes once to the keys of a tile that share it, and no row is made per link."""
    from docketlake.operators import reach as R

    pairs = spark.range(40_000).select((F.col("id") % 200).alias("a"), F.expr("1000000 + id * 7919 % 3001").alias("b"))
    links = pairs.toDF("citing_opinion_id", "cited_opinion_id")
    near = R._neighbours(links)
    assert near.agg(F.sum("n")).head()[0] == 2 * pairs.distinct().count()
    steps = near.join(near.select("node", F.col("ids").alias("next")), "node").coalesce(1)
    n = near.select("node", "n").groupBy("node").agg(F.sum("n").alias("n")).agg(F.sum(F.col("n") * F.col("n"))).head()[0]
    dealt = R._dealt(steps, "ids", "next", (16, 1), 1)
    assert n > 1_000_000 and dealt.count() <= 16 * (1 + n // R.PIECE)
    assert dealt.agg(F.sum(F.length("sizes")) / 4).head()[0] <= 16 * near.count()
    found = R._by_tile(dealt).mapInArrow(R._unite(R._as_arrays), "seed_id long, depth int, nodes array<long>")
    got = found.select("seed_id", F.explode("nodes").alias("node"))
    ways = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    want = ways.toDF("x", "seed_id").join(ways.toDF("x", "node"), "x").select("seed_id", "node").distinct()
    assert got.count() == want.count() and got.exceptAll(want).count() == 0


@pytest.mark.parametrize("most", [1_000_000, 3])
def test_edges_of_hubs_in_parts(spark, monkeypatch, most):
    from docketlake.operators import network as N

    monkeypatch.setattr(N, "HUB_LINKS", most)
    draw = random.Random(6)
    edges = {(draw.randrange(90), 300 + draw.randrange(30)) for _ in range(150)} | {(i, 300) for i in range(40)}
    citations = spark.createDataFrame([(a, b, 1, False) for a, b in edges], "citing_opinion_id long, cited_opinion_id long, depth int, quoted boolean")
    net = citation_network(citations, spark.createDataFrame([(i,) for i in range(90)], "id long"), 2, spark.range(330))
    balls = {s: naive_network(edges, s, 2) for s in range(90)}
    nodes = [tuple(r) for r in net.nodes.select("seed_id", "node", "depth").collect()]
    assert sorted(nodes) == sorted((s, n, d) for s, ball in balls.items() for n, d in ball.items() if n < 330)
    got = [tuple(r)[:3] for r in net.edges.select("seed_id", "citing_opinion_id", "cited_opinion_id").collect()]
    assert sorted(got) == sorted((s, a, b) for s, ball in balls.items() for a, b in edges if a in ball or b in ball)
