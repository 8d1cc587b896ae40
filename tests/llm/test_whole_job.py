"""Rows with repeated or missing ids, and inputs beyond former bounds."""

from __future__ import annotations

import random

import numpy as np
import pytest


@pytest.mark.parametrize("most", [1, 5000])
def test_substrings_of_shared_ids(spark, most):
    from docketlake.llm.substring_dedup import remove_repeats

    rng = random.Random(4)
    passage = lambda n: " ".join(rng.choice("abcdefghij") * rng.randint(1, 3) for _ in range(n))
    alone, common, again, other = passage(90), passage(90), passage(80), passage(70)
    rows = [(7, alone), (7, alone), (None, passage(20) + common), (None, common + passage(150) + common), (None, passage(60))]
    rows += [(8, passage(10) + again), (8, again + passage(30) + again), (9, passage(5) + again + passage(5)), (10, common[3:]), (3, other), (3, other), (3, other + "x"), (11, other)]
    want = []
    low: dict[bytes, int] = {}
    data = [(-1 if i is None else i, t.encode()) for i, t in rows]
    for i, text in data:
        for p in range(len(text) - 99):
            low[text[p : p + 100]] = min(i, low.get(text[p : p + 100], i))
    for i, text in data:
        gone, seen = np.zeros(len(text), bool), set()
        for p in range(len(text) - 99):
            window = text[p : p + 100]
            if low[window] < i or window in seen:
                gone[p : p + 100] = True
            seen.add(window)
        want.append((i, text, bytes(np.frombuffer(text, np.uint8)[~gone])))
    cut = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), most_contexts=most).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.text.encode(), bytes(r.kept)) for r in cut) == sorted(want)
    assert {bytes(r.kept) for r in cut if r.doc_id == 7} == {alone.encode()}


@pytest.mark.parametrize("cells", [1, 1 << 18])
def test_near_copies_without_ids(spark, cells, monkeypatch):
    from docketlake.llm import common
    from docketlake.llm.jaccard_join import drop_near_copies

    monkeypatch.setattr(common, "ID_CELLS", cells)
    text = lambda n, *more: " ".join([f"{n}w{i}" for i in range(60)] + list(more))
    rows = [(1, text("a")), (2, text("a", "x")), (None, text("a", "y")), (None, text("b")), (None, text("c")), (None, text("c", "z"))]
    rows += [(5, text("d")), (5, text("e")), (6, text("f")), (6, text("f")), (7, text("g")), (7, text("g", "x")), (None, None), (None, ""), (8, "")]
    out = drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    named = sorted((r.doc_id or 0, (r.text or "")[:1], r.text is None) for r in out)
    assert named == sorted([(1, "a", False), (0, "b", False), (0, "c", False), (5, "d", False), (5, "e", False), (6, "f", False), (7, "g", False), (0, "", True), (0, "", False), (8, "", False)])


def test_quality_takes_all_labels(spark):
    from docketlake.llm.quality import quality_rules

    n = 40_600
    rows = [(i, "aa bb" if i < n - 600 else "cc dd") for i in range(n)] + [(None, "aa bb"), (n + 5, "ee ff")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, int(i % 2 == 0 or i >= n - 600)) for i in range(n)], "doc_id long, quality int")
    out = {r.text: r.llr for r in quality_rules(docs, labels).select("text", "llr").distinct().collect()}
    # Three grams a text: two tokens and their pair.
    total = np.log((65536 + 3 * (n + 2)) / (65536 + 3 * (20_000 + 600)))
    raw, good = {"aa bb": n - 600 + 1, "cc dd": 600, "ee ff": 1}, {"aa bb": 20_000, "cc dd": 600, "ee ff": 0}
    for text, llr in out.items():
        assert llr == pytest.approx(np.log((good[text] + 1) / (raw[text] + 1)) + total, abs=1e-3)


def test_quality_against_plain_python(spark):
    """Counts, score, threshold and verdict of every row, computed one row at a time; bucket numbers are Spark's hashes."""
    import math
    import re
    from collections import Counter

    import regex
    from pyspark.sql import functions as F

    from docketlake.llm.quality import quality_rules

    rng = random.Random(9)
    good_words, bad_words = [f"good{i}" for i in range(60)], [f"bad{i}" for i in range(25)]
    make = lambda words, n: rng.choice([" ", "\n", "\t"]).join(rng.choice(words) for _ in range(n))
    texts = [make(good_words, rng.randint(20, 120)) for _ in range(60)] + [make(bad_words, rng.randint(60, 90)) for _ in range(40)]
    texts += [make(good_words[:30] + bad_words, 80) for _ in range(40)]
    texts += [None, "", " \n ", "one", "a b c " * 40, "x\nx\n#y|%\n\nx", "é ² 日本 " * 30]
    rows = list(enumerate(texts)) + [(None, texts[0]), (3, texts[70]), (3, texts[3])]
    labels = [(i, int(i < 60 or i % 7 == 0)) for i in range(100)] + [(5, 0), (None, 1), (900, 1), (101, None)]
    kind = {}
    for i, q in labels:
        if i is not None and q is not None:
            kind[i] = min(q, kind.get(i, 1))
    token = regex.compile(r"[\p{L}\p{N}]+|[^\p{L}\p{N}\x20\x09-\x0D]+")
    grams = []
    for _, t in rows:
        tokens = token.findall(t or "")
        grams.append([(x,) for x in tokens] + list(zip(tokens, tokens[1:], strict=False)))
    names = sorted({g for row in grams for g in row})
    hashed = spark.createDataFrame([(g[0], g[1] if len(g) > 1 else None) for g in names], "x string, y string")
    value = F.when(F.col("y").isNull(), F.xxhash64("x")).otherwise(F.xxhash64("x", "y"))
    bucket = dict(zip(names, [r[0] for r in hashed.coalesce(1).select(F.pmod(value, F.lit(65536))).collect()], strict=True))
    raw, trusted = Counter(), Counter()
    for (i, _), row in zip(rows, grams, strict=True):
        raw.update(bucket[g] for g in row)
        if i is not None and kind.get(i) == 1:
            trusted.update(bucket[g] for g in row)
    shift = math.log((65536 + sum(raw.values())) / (65536 + sum(trusted.values())))
    weight = {b: round(math.log((trusted[b] + 1) / (raw[b] + 1)) + shift, 4) for b in raw}
    scores = [sum(weight[bucket[g]] for g in row) / len(row) if row else None for row in grams]
    mean = lambda q: np.mean([s for (i, _), s in zip(rows, scores, strict=True) if s is not None and i is not None and kind.get(i) == q])
    limit = (mean(1) + mean(0)) / 2
    want = []
    for (i, t), s in zip(rows, scores, strict=True):
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        windows = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
        again = {k + d for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for d in range(3)}
        lines = [x for x in (t or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        failed = len(words) < 50 or 100 * len(again) > 50 * len(words)
        numbers = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(again))
        want.append((str(i), numbers, failed, not failed and (s is None or s >= limit)))
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, good string, llr int").repartition(4)
    found = quality_rules(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    got = [(str(r.doc_id), (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words), r.base_failed, r.kept) for r in found]
    assert sorted(got) == sorted(want)
    assert {True, False} == {r.kept for r in found if not r.base_failed}


@pytest.mark.parametrize(("block", "short"), [(7, 64), (2048, 2), (2048, 64)])
def test_documents_that_share_most_of_a_template(spark, block, short, monkeypatch):
    """Pairs around the threshold in lists of many: about three quarters of the words are common to all."""
    import re

    from docketlake.llm import jaccard_join

    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    monkeypatch.setattr(jaccard_join, "SHORT", short)
    monkeypatch.setattr(jaccard_join, "PAIRS_AT_ONCE", 500)
    rng = random.Random(12)
    template = [f"t{i}" for i in range(90)]
    rows = []
    for i in range(160):
        words = template[: rng.choice([88, 89, 90])] + [f"own{rng.randint(0, 9 if i % 4 else 10**6)}x{k}" for k in range(rng.choice([8, 11, 14]))]
        if i % 5 == 0:
            words[rng.randint(0, 80)] = f"swap{rng.randint(0, 5)}"
        rows.append((i, " ".join(words)))

    def shingles(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", text.lower())
        return {tuple(words[k : k + 5]) for k in range(len(words) - 4)}

    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    want = {i: find(i) for i in range(len(rows))}
    found = jaccard_join.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert {r.doc_id: r.component_id for r in found} == want
    assert 1 < len(set(want.values())) < len(rows)


def test_pages_with_copies(spark):
    from docketlake.llm.html_extraction import extract_text

    run = lambda name, n: " ".join(f"{name}{i}" for i in range(n))
    menu, quote, body = run("menu", 12), run("quote", 10), run("body", 200)
    rows = [(i, f"http://h/{i}", f"<div>{menu}</div><p>{run(f'own{i}x', 20)}{' ' + quote if i < 2 else ''}</p>") for i in range(6)]
    rows += [(10 + i, f"http://h/10?page={i}", f"<div>{menu}</div><p>{body}{' more' * (i // 2)}</p>") for i in range(4)]
    rows += [(20 + i, f"http://mirror/{i}", f"<p>{body} print{i}</p>") for i in range(2)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for host_tokens in (10, 10**6):
        got = {r.page_id: r.text for r in extract_text(df, host_tokens=host_tokens).collect()}
        assert got[0] == f"{run('own0x', 20)} {quote}" and got[1] == f"{run('own1x', 20)} {quote}" and got[5] == run("own5x", 20)
        assert all(got[10 + i] == body + " more" * (i // 2) for i in range(4))
        assert all(got[20 + i] == f"{body} print{i}" for i in range(2))


def test_lists_leave_out_what_cannot_link():
    """Sets of one list whose sizes are too far apart are no candidates; the rest is, and bits of a size are no part of a list's name."""
    import numpy as np
    import pyarrow as pa

    from docketlake.llm.jaccard_join import _FILED, _file, _lists

    class Hot:
        value = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    texts = [" ".join(f"w{k}" for k in range(n)) for n in (4, 4, 104, 105, 106, 204)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    filed = np.concatenate([np.frombuffer(b, _FILED) for out in _file(Hot, 1)([batch]) for b in out.column("rows").to_pylist()])
    size = {c: len(set(filed["sig"][filed["cls"] == c] & np.uint64(255))) for c in set(filed["cls"].tolist())}
    assert len(size) == 5 and set(size.values()) == {1}
    step = [0, 3, 6, 7, 20, 21]
    rows = np.zeros(6, _FILED)
    rows["sig"], rows["cls"] = (9 << 8) + np.array(step), np.arange(6) + 10
    found = _lists(pa.table({"rows": [rows.tobytes()]})).to_pylist()
    assert {(r["u"], r["v"]) for r in found if r["list"] is None} == {(10, 11), (10, 12), (14, 15)}
    assert sorted(r["u"] for r in found if r["list"] is not None) == [11, 12, 13]


def test_small_tables_are_written_by_few_tasks(spark):
    from docketlake.llm.common import ROWS_A_FILE, materialise
    from docketlake.llm.components import components

    rows = spark.range(200).repartition(16)
    assert len(materialise(rows, most_rows=200).inputFiles()) == 1
    assert len(materialise(rows, most_rows=3 * ROWS_A_FILE).inputFiles()) == 3
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 60, 2)] + [(1, 2), (3, 5)], "u long, v long").repartition(16)
    found = components(edges, 32)
    assert len(found.inputFiles()) == 1
    assert {r.id: r.component for r in found.where("id < 8").collect()} == {0: 0, 1: 0, 2: 0, 3: 0, 4: 0, 5: 0, 6: 6, 7: 6}


def test_articles_lose_blocks_that_their_host_repeats(spark):
    """Blocks of an article that are boilerplate of the host outside articles go as a whole; what articles share stays."""
    from docketlake.llm.html_extraction import extract_text

    run = lambda name, n: " ".join(f"{name}{i}" for i in range(n))
    notice, shared = run("notice", 20), run("shared", 30)
    end = f"<div class='notice'>{notice}</div>"
    page = lambda i, more, foot="": f"<article><p>{run(f'own{i}x', 20)}</p>{more}</article>{foot}"
    rows = [(i, f"http://h/{i}", page(i, f"<p>{shared}</p>", end)) for i in range(4)]
    rows += [(4, "http://h/4", page(4, f"<p>{notice}</p><p>last</p>")), (5, "http://h/5", page(5, f"<p>{notice} and more</p>"))]
    rows += [(6, "http://h/6", page(6, f"<p>{run('notice', 7)}</p>")), (7, "http://h/7", page(7, f"<p>{run('notice', 9)} {notice}</p>"))]
    rows += [(8, "http://other/8", page(8, f"<p>{notice}</p>")), (9, "http://h/9", page(9, f"<p>{notice}</p>")), (9, "http://h/9", page(9, f"<p>{notice}</p>"))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = {i: [run(f"own{i}x", 20), shared] for i in range(4)} | {i: [run(f"own{i}x", 20)] for i in (4, 7, 9)}
    want |= {4: [run("own4x", 20), "last"], 5: [run("own5x", 20), f"{notice} and more"]}
    want |= {6: [run("own6x", 20), run("notice", 7)], 8: [run("own8x", 20), notice]}
    for host_tokens in (10, 10**6):
        got = extract_text(df, host_tokens=host_tokens).collect()
        assert len(got) == len(rows) and {r.page_id: r.text for r in got} == {i: "\n\n".join(b) for i, b in want.items()}
