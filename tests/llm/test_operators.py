"""Every training-data operator against the library or a brute-force version, with odd rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "a<|endoftext|>b  c'll <|startoftext|>"), (5, "日本語 😀 x² İ ΑΣ"), (6, "w " * 3000), (7, "w " * 3000), (None, "no id")]


@pytest.fixture
def odd(spark):
    rows = [(i, t, "n", 1, 2) for i, t in ODD] + [(7, "w " * 3000, "n", 1, 2)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, `piece` int, score int")


def corpus(seed: int, n: int) -> list[tuple[int, str]]:
    rng = random.Random(seed)
    parts = [" ".join(rng.choice("abcdefghij") * rng.randint(1, 3) for _ in range(rng.randint(3, 90))) for _ in range(12)]
    rows = []
    for i in range(n):
        text = ""
        for _ in range(rng.randint(0, 4)):
            part = rng.choice(parts)
            cut = rng.randint(0, len(part))
            text += rng.choice([part, part[cut:], part[:cut], "ab" * rng.randint(0, 120), "é-" * rng.randint(0, 90)])
        rows.append((i, text))
    return rows


def test_token_counts(spark, odd):
    import public_tokenizers
    from tokenizers import Tokenizer

    from docketlake.llm.token_counts import token_counts

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = sorted((len((t or "").encode()), len(tokenizer.encode(t or "", add_special_tokens=False).ids)) for _, t in [*ODD, ODD[6]])
    for head in (2, 1000):
        rows = token_counts(odd, head=head).collect()
        assert sorted((r.n_bytes, r.n_tokens) for r in rows) == want
    assert token_counts(odd.limit(0)).count() == 0


@pytest.mark.parametrize("most", [2, 5000])
def test_substrings(spark, most):
    from docketlake.llm.substring_dedup import remove_repeats

    rows, seen, want = corpus(3, 90), set(), {}
    for i, text in rows:
        data = text.encode()
        edge = np.zeros(len(data) + 1, int)
        for p in range(len(data) - 99):
            if data[p : p + 100] in seen:
                edge[p] += 1
                edge[p + 100] -= 1
            seen.add(data[p : p + 100])
        gone = np.cumsum(edge)[:-1] > 0
        kept = bytes(np.frombuffer(data, np.uint8)[~gone])
        want[i] = (len(data), int(gone.sum()), hashlib.sha256(kept).hexdigest())
    cut = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), most_contexts=most)
    assert {r.doc_id: (r.n_bytes, r.n_removed, hashlib.sha256(r.kept).hexdigest()) for r in cut.collect()} == want


def test_substrings_of_odd_rows(odd):
    from docketlake.llm.substring_dedup import remove_repeats

    rows = remove_repeats(odd, as_text=True).collect()
    assert len(rows) == 9 and {r.n_removed for r in rows if r.doc_id in (1, 2, 3, 4, 5)} == {0}
    assert all(r.n_removed == 6000 for r in rows if r.doc_id == 7)
    assert remove_repeats(odd.limit(0)).count() == 0


def test_vectors(spark):
    from docketlake.llm.embedding_dedup import near_duplicates

    rng = np.random.default_rng(1)
    base = rng.standard_normal((40, 24))
    x = np.concatenate([base + rng.standard_normal((40, 24)) * s for s in (0, 0.1, 0.25, 0.3)]).astype(np.float32)
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    odd = [(900, None), (901, []), (902, [0.0, 0.0]), (903, [1.0, None]), (904, [1.0, float("nan")]), (905, [1.0])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>")
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    link = u @ u.T >= 0.95
    np.fill_diagonal(link, False)
    label = np.arange(len(x))
    for _ in range(len(x)):
        label = np.array([min([label[i], *label[link[i]]]) for i in range(len(x))])
    for tile in (30, 8192):
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_duplicates(df, tile=tile).collect()}
        assert all(got[i] == (link[i].sum(), label[i], label[i] == i) for i in range(len(x)))
        assert all(got[i] == (0, i, True) for i, _ in odd)
    assert near_duplicates(df.limit(0)).count() == 0


def shingles(text: str | None) -> set:
    upper = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(upper))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) > 4 else {tuple(words)} if words else set()


def test_jaccard_groups(spark, odd):
    from docketlake.llm.jaccard_join import jaccard_groups

    rng, rows = random.Random(2), [(1000, None), (1001, ""), (1002, "A b"), (1003, "a  B")]
    names = [f"w{i}" for i in range(300)]
    for _ in range(40):
        words = [rng.choice(names) for _ in range(rng.choice([5, 6, 7, 8, 9, 10, 12, 15, 30, 80, 300]))]
        for _ in range(rng.randint(1, 7)):
            own = list(words)
            for _ in range(rng.randint(0, max(1, len(own) // 12))):
                own[rng.randrange(len(own))] = rng.choice(names)
            rows.append((len(rows), " ".join(own)))
    sets = {i: shingles(t) for i, t in rows}
    label = {i: i for i in sets}
    pairs = [(i, j) for i in sets for j in sets if i < j and sets[i] and 4 * len(sets[i] & sets[j]) >= 3 * len(sets[i] | sets[j])]
    for _ in range(len(rows)):
        before = dict(label)
        for i, j in pairs:
            label[i] = label[j] = min(label[i], label[j])
        if label == before:
            break
    got = jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {i: (len(sets[i]), label[i]) for i in sets}
    found = jaccard_groups(odd).collect()
    assert len(found) == 9 and {r.component_id for r in found if r.doc_id in (6, 7)} == {6}
    assert jaccard_groups(odd.limit(0)).count() == 0


def test_pages(spark):
    from docketlake.llm.html_extraction import extract_text

    menu, foot = " ".join(f"menu{i}" for i in range(12)), " ".join(f"foot{i}" for i in range(9))
    rows = [(i, f"http://h/{i}", f"<div>{menu}</div><p>{i} own words of p{i}</p><div>{foot}</div>") for i in range(5)]
    page = "<nav>x</nav><article><h1>a&amp;b</h1><div class='ad'>no</div><script>'</p>'</script><p>c\n <b>d</b>e<br>f</article><footer>y"
    df = spark.createDataFrame([*rows, (9, None, None), (None, "x", ""), (11, "http://h/11", page)], "page_id long, url string, html string")
    for host_tokens in (10, 10**6):
        got = {r.page_id: (r.text, r.n_chars) for r in extract_text(df, host_tokens=host_tokens).collect()}
        assert got[9] == got[None] == ("", 0) and got[11][0] == "a&b\n\nc de f"
        assert all(got[i][0] == f"{i} own words of p{i}" for i in range(5))
    assert extract_text(df.limit(0)).count() == 0


def test_packing(spark, odd):
    import public_tokenizers
    from tokenizers import Tokenizer

    from docketlake.llm.packing import pack, plan_sequences

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for i, text in [*ODD, ODD[6]]:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        borders = [0, *range((len(ids) - 1) % 1024 + 1, len(ids) + 1, 1024)]
        for k, (low, high) in enumerate(zip(borders, borders[1:], strict=False)):
            want.append((str(i), k, low, high - low, zlib.crc32(np.array(ids[low:high], "<u4").tobytes())))
    rows = pack(odd).orderBy("sequence_id", "offset").collect()
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    at: dict[int, int] = {}
    for r in rows:
        assert r.offset == at.get(r.sequence_id, 0)
        at[r.sequence_id] = r.offset + r.length
    assert max(at.values()) <= 1024 and pack(odd.limit(0)).count() == 0
    rng = np.random.default_rng(4)
    counts = {int(k): int(v) for k, v in zip(range(1, 1025), rng.integers(0, 400, 1024), strict=True)}
    plan = plan_sequences(counts)
    used: dict[int, int] = {}
    for lengths, times in plan:
        assert sum(lengths) <= 1024
        for length in lengths:
            used[length] = used.get(length, 0) + times
    assert used == {k: v for k, v in counts.items() if v}
    assert sum(t for _, t in plan) <= 1.01 * sum(k * v for k, v in counts.items()) / 1024


def test_mixing(spark):
    from docketlake.llm.mixing import Targets, leaf_budgets, mix_sources

    supply = {("a", "x", "1"): 100.0, ("a", "x", "2"): 10.0, ("a", "y", "3"): 50.0, ("b", "x", "4"): 1000.0}
    even = Targets(domain={"a": 1, "b": 1}, lang={"x": 1, "y": 1}, source={k: 1 for k in "1234"})
    got = leaf_budgets(supply, 100, even, 1)
    assert got == pytest.approx({("a", "x", "1"): 15, ("a", "x", "2"): 10, ("a", "y", "3"): 25, ("b", "x", "4"): 50})
    rows = [(i, "w " * (i % 7 + 1), None if i % 5 == 0 else "en", "s1" if i % 3 else "s2", "clash") for i in range(300)]
    df = spark.createDataFrame([*rows, (None, None, None, None, None)], "doc_id long, text string, lang string, source string, epoch string")
    for share, epochs in ((0.5, 1), (1.0, 2), (2.0, 2)):
        out = mix_sources(df, F.lit("d"), share, max_epochs=epochs).collect()
        total = sum(i % 7 + 1 for i in range(300))
        assert share * total - 40 <= sum(r.n_tokens for r in out) <= share * total + 1
        assert max(r.epoch for r in out) < epochs
    assert mix_sources(df.limit(0), F.lit("d")).count() == 0


def base(text: str | None) -> tuple[int, ...]:
    text = text or ""
    words, lines = re.findall(r"[^\x20\x09-\x0D]+", text), [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = list(zip(words, words[1:], words[2:], strict=False))
    again = {p + k for p, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(again)


def test_quality(spark, odd):
    from docketlake.llm.quality import quality_rules

    rows = [(i, t[:1500] + ("\n" + t[:60]) * (i % 3) + " ## x | y" * (i % 2)) for i, t in corpus(5, 60)] + [(1000, None), (1001, "a b c"), (1002, "a b c a b c")]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(None, 1), (5, None)], "doc_id long, quality int")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    plan = quality_rules(docs, labels)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert {r.doc_id: tuple(r[n] for n in names) for r in plan.collect()} == {i: base(t) for i, t in rows}
    assert "Python" not in plan._jdf.queryExecution().executedPlan().toString()
    assert quality_rules(odd, labels.limit(0)).count() == 9 and quality_rules(odd.limit(0), labels).count() == 0


def test_segments_and_toxicity(spark, odd):
    from docketlake.llm.toxicity import maximal_segments, score_toxicity

    rng = random.Random(9)
    for _ in range(200):
        scores = [rng.choice([-1.0, 2.0, 0.5]) for _ in range(rng.randint(0, 12))]
        best = max([0.0, *(sum(scores[a:b]) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1))])
        found = maximal_segments(((i, s) for i, s in enumerate(scores) if s > 0), -1.0)
        assert max((s for *_, s in found), default=0.0) == pytest.approx(best)
        assert all(a < b for a, b, _ in found) and all(x[1] <= y[0] for x, y in zip(found, found[1:], strict=False))
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(400)]
    rows = [(i, " ".join([rng.choice(words) for _ in range(60)] + ["vile", rng.choice(words), "vilest"] * (i % 4 == 0) * 2)) for i in range(500)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(500)], "doc_id long, toxic int")
    out = score_toxicity(spark.createDataFrame(rows, "doc_id long, text string"), labels).collect()
    assert sum(r.predicted != (r.doc_id % 4 == 0) for r in out if r.held_out) == 0
    assert {r.held_out for r in out} == {True, False} and all(0 <= r.score <= 1 for r in out)
    assert score_toxicity(odd, labels.limit(0)).count() == 9 and score_toxicity(odd.limit(0), labels).count() == 0


def test_language(spark, odd):
    from docketlake.llm.language_id import identify_language

    rng = random.Random(8)
    sound = {"xx": "ka to mi re", "yy": "schl ung ein", "zz": "ción que os"}
    rows = [(i, " ".join(rng.choice(sound[n].split()) + rng.choice("aeiou") for _ in range(40)), n) for i in range(240) for n in [list(sound)[i % 3]]]
    docs = spark.createDataFrame([*rows, (900, None, "xx"), (901, "123 --", None)], "doc_id long, text string, lang string")
    out = {r.doc_id: r for r in identify_language(docs).collect()}
    assert all(out[i].lang_pred == n for i, _, n in rows) and out[900].lang_pred == out[901].lang_pred == "und"
    empty = identify_language(odd.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in empty.collect()} == {"und"} and empty.count() == 9
