"""The pipeline's stages keep clean rows, pass the documents' columns on, and end in packed pieces."""

from __future__ import annotations


def test_stages(spark):
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialise(stage(spark, docs, folder))
        assert docs.columns == columns and 0 < docs.count() <= before
        before = docs.count()
        assert docs.select("doc_id").distinct().count() == before
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert pieces.select("doc_id").distinct().count() == before
    assert corpus_pipeline.run(spark, folder).count() == pieces.count()


def odd_tables(spark, folder):
    """Documents with missing and repeated ids, missing, blank, long and copied texts, and labels that contradict each other."""
    import random

    rng = random.Random(21)
    words = [f"w{i}" for i in range(400)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared, copied = text(60), text(200)
    rows = [(i, text(rng.randint(60, 160)) + (f" {shared} " if i % 9 == 0 else ""), "en", f"s{i % 3}") for i in range(80)]
    rows += [(100 + i, copied + " x" * i, "de", None) for i in range(4)] + [(None, text(80), None, "s1"), (None, text(90), "en", "s1")]
    rows += [(200, None, "en", "s0"), (201, "", None, None), (202, " \n\t", "fr", "s0"), (203, text(9000), "fr", "s2"), (5, rows[5][1], "en", "s2"), (5, text(70), "en", "s2")]
    kinds = "doc_id long, text string, lang string, source string, n_chars long, n_words string, kept int, epoch string, _row int"
    made = [(*r, len(r[1] or ""), "more", 1, "e", 7) for r in rows]
    spark.createDataFrame(made, kinds).repartition(3).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, i % 4 > 0, 0) for i in range(60)] + [(5, False, 1), (None, True, 0), (999, True, 0)]
    spark.createDataFrame([(i, int(q), t) for i, q, t in labels], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return rows


def test_stages_of_odd_rows(spark, tmp_path):
    import corpus_pipeline

    rows = odd_tables(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    counts = [len(rows)]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialise(stage(spark, docs, str(tmp_path)))
        assert docs.columns == columns, name
        counts.append(docs.count())
        assert 0 < counts[-1] <= counts[-2], name
        kept = docs.collect()
        assert {(r.n_words, r.kept, r.epoch, r._row) for r in kept} == {("more", 1, "e", 7)}, name
        if name == "quality rules":
            assert not {200, 201, 202} & {r.doc_id for r in kept} and len(kept) > 40
        if name == "n-gram Jaccard join":
            assert len({(r.doc_id, r.text) for r in kept}) == len(kept)
    whole = spark.read.parquet(f"{tmp_path}/documents.parquet")
    distinct = corpus_pipeline.distinct_documents(spark, whole, str(tmp_path)).collect()
    assert [r.doc_id for r in distinct if r.doc_id in range(100, 104)] == [100]
    assert len([r for r in distinct if r.doc_id is None]) == 2 and {200, 201, 202, 203} <= {r.doc_id for r in distinct}
    assert len(distinct) == len({(r[0], r[1]) for r in rows}) - 3
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    check_places(spark, [(r.doc_id, r.text) for r in docs.collect()], pieces)
    again = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((str(r.doc_id), r.piece, r.ids_crc32) for r in again) == sorted((str(r.doc_id), r.piece, r.ids_crc32) for r in pieces)
    # Nothing in, nothing out.
    none = spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, str(tmp_path)).count() == 0, name


def check_places(spark, docs, pieces, capacity=1024):
    """Pieces are the documents' ids in order, and fill their sequences from 0 without gap or overlap."""
    import zlib
    from array import array
    from collections import defaultdict

    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for key, text in docs:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        first = (len(ids) - 1) % capacity + 1
        edges = [0, *range(first, len(ids) + 1, capacity)]
        for piece, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
            want.append((str(key), piece, a, b - a, zlib.crc32(array("I", ids[a:b]).tobytes())))
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in pieces) == sorted(want)
    filled = defaultdict(list)
    for r in pieces:
        filled[r.sequence_id].append((r.offset, r.length))
    for places in filled.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    total = sum(r.length for r in pieces)
    assert len(filled) >= -(-total // capacity)
    # No two sequences would fit into one, as best fit leaves them.
    sizes = sorted(sum(n for _, n in places) for places in filled.values())
    assert len(sizes) < 2 or sizes[0] + sizes[1] > capacity


def test_places_of_pieces(spark):
    import random

    from docketlake.llm.packing import pack

    rng = random.Random(7)
    docs = [(i, " ".join(rng.choice(["a", "the", "word", "é"]) for _ in range(rng.choice([0, 3, 200, 511, 512, 700, 1500])))) for i in range(120)]
    docs += [(None, None), (7, "x"), (7, "x")]
    check_places(spark, docs, pack(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect())


def test_prefixes_of_leaves(spark):
    """Which documents a leaf takes, summed up one after the other in the order of the seeded epoch."""
    import random
    from collections import defaultdict

    from pyspark.sql import functions as F

    from docketlake.llm.mixing import Targets, leaf_budgets, mix_sources

    rng = random.Random(3)
    rows = [(i, "w " * rng.choice([0, 1, 5, 40]), rng.choice(["en", "de", None]), rng.choice(["a", "b"])) for i in range(400)]
    rows += [(7, "w w w", "en", "a"), (7, "w w w w", "en", "a"), (None, "w " * 9, "de", "b"), (None, "w " * 4, "de", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(4)
    domain = F.when(F.col("source") == "a", "x").otherwise("y")
    for share, epochs in ((0.5, 1), (0.95, 1), (1.6, 2)):
        got = defaultdict(int)
        for r in mix_sources(docs, domain, share=share, max_epochs=epochs).collect():
            got[r.doc_id, r.text, r.lang, r.source] = max(got[r.doc_id, r.text, r.lang, r.source], r.epoch + 1)
        supply, leaves = defaultdict(float), defaultdict(list)
        for i, t, lang, source in rows:
            leaf = {"a": "x", "b": "y"}[source], lang or "", source
            supply[leaf] += len(t.split())
            leaves[leaf].append((i, t, lang, source))
        budgets = leaf_budgets(dict(supply), share * sum(supply.values()), Targets(), epochs)
        want = defaultdict(int)
        for leaf, members in leaves.items():
            n = supply[leaf]
            whole = min(epochs, int((budgets[leaf] + 0.5) // n))
            rest = max(0, int(budgets[leaf] - whole * n + 0.5)) if whole < epochs else 0
            named = spark.createDataFrame([(k, None if m[0] is None else str(m[0])) for k, m in enumerate(members)], "k int, name string")
            hashed = named.select("k", F.xxhash64(F.lit(1), F.lit(whole), F.coalesce("name", F.lit(""))).alias("h")).collect()
            order = sorted((r.h, r.k) for r in hashed)
            spent, taken = 0, set()
            for h in sorted({h for h, _ in order}):
                group = [members[k] for g, k in order if g == h]
                spent += sum(len(m[1].split()) for m in group)
                if rest == 0 or spent > rest:
                    break
                taken |= set(group)
            for m in members:
                if times := whole + (m in taken):
                    want[m] = times
        assert dict(got) == dict(want), (share, epochs)
