"""Token alignment, top-k search and resampling against brute-force versions, with odd rows."""

from __future__ import annotations

import hashlib
import math
import os
import random
import re
import subprocess
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

TEXTS = [
    None, "", " ", "\n", " \n\t x", "a▁b", "<|endoftext|>b  c'll <s></s><0x41>", "x;\r\n\ry = f();\r\n  z\r", "w " * 3000,
    "w " * 3000, "\x00\x1c\x1fa\x85b\xa0c", "  lead  and   many    spaces     \n\n\n  x\r\n\ty", "é" * 500 + " " * 700 + "\t" * 50,
    "don't we'RE it's 's", "𐍈" * 30, "日本語 😀 x² İ ΑΣ", "a　b c", "the cat sat on the mat, the dog did not.",
]


def brute_alignment(rows):
    import public_tokenizers as P
    import sentencepiece
    from tokenizers import Tokenizer

    left = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    left.encode_special_tokens = True
    right = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    piece = lambda x: bytes([int(right.id_to_piece(x)[3:5], 16)]) if right.is_byte(x) else right.id_to_piece(x).replace("▁", " ").encode()
    found, holders = [], defaultdict(set)
    for number, (key, text) in enumerate(rows):
        a = left.encode(" " + text, add_special_tokens=False).ids if text else []
        b = right.encode(text) if text else []
        sides = [[bytes(byte[c] for c in left.id_to_token(x)) for x in a], [piece(x) for x in b]]
        if not text or any(b"".join(s) != (" " + text).encode() for s in sides):
            found.append((key, 0, 0, 0, Counter(), ""))
            continue
        ends = [np.cumsum([len(x) for x in s]) for s in sides]
        both = sorted(set(ends[0].tolist()) & set(ends[1].tolist()))
        groups = [([], []) for _ in both]
        for side, ids in enumerate((a, b)):
            for g, x in zip(np.searchsorted(both, ends[side]), ids, strict=True):
                groups[g][side].append(x)
        links = Counter((x, y) for p, q in groups for x in p for y in q)
        for pair in links:
            holders[pair].add(number)
        name = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups)
        found.append((key, len(a), len(b), len(both), links, hashlib.sha256(name.encode()).hexdigest()))
    top = defaultdict(int)
    for (a, _), held in holders.items():
        top[a] = max(top[a], len(held))
    out = []
    for key, n_a, n_b, n_groups, links, digest in found:
        best = sum(n for p, n in links.items() if len(holders[p]) == top[p[0]])
        total = sum(n * len(holders[p]) for p, n in links.items())
        out.append((key, n_a, n_b, n_groups, sum(links.values()), best, total, digest))
    return out, {p: len(held) for p, held in holders.items()}


@pytest.mark.parametrize(("documents", "postings"), [(1 << 15, 1 << 20), (7, 1 << 20), (1 << 15, 40)])
def test_alignment(spark, documents, postings):
    from docketlake.llm.token_alignment import align_tokenizers

    rng = random.Random(1)
    words = "the of and cat, dogs; naïve Straße 12345 x=y() don't ñandú 日本 ... ---".split()
    rows = list(enumerate(TEXTS)) + [(None, "no id"), (8, "w " * 3000)]
    rows += [(100 + i, rng.choice([" ", "\n", "  "]).join(rng.choice(words) for _ in range(rng.randint(1, 60)))) for i in range(60)]
    docs = spark.createDataFrame([(*r, "kept", 1) for r in rows], "doc_id long, text string, n_a string, pair int").repartition(3)
    out, pairs = align_tokenizers(docs, most_documents=documents, most_postings=postings)
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    want, counts = brute_alignment(rows)
    assert sorted(map(tuple, out.select(columns).collect()), key=str) == sorted(want, key=str)
    assert {(r.a, r.b): r.n_docs for r in pairs.collect()} == counts
    assert sum(r[4] for r in want) == pairs.agg(F.sum("n_links")).first()[0]
    empty, none = align_tokenizers(docs.limit(0))
    assert empty.count() == 0 and none.count() == 0


def test_bitmaps_and_lists_of_a_chunk():
    from docketlake.llm.token_alignment import containers, inverted

    places = np.concatenate([np.arange(0, 3000, 2), [5], np.arange(4000)])
    sets = containers(places, np.array([1500, 1, 4000]), 4096)
    assert [len(x.as_py()) % 2 for x in sets] == [1, 0, 1]
    assert np.flatnonzero(np.unpackbits(np.frombuffer(sets[0].as_py(), np.uint8))).tolist() == list(range(0, 3000, 2))
    made = inverted(np.array([7, 9, 9, 9]), np.array([0, 1, 1, 2]), np.array([5, 2, 1, 4]), 3).to_pylist()
    assert [(r["pair"], r["docs"], r["links"]) for r in made] == [(7, 1, 5), (9, 2, 7)]
    # Planes of 5 in document 0: bits 0 and 2; of 3 in document 1 and 4 in document 2: bits 0, 1 and 2.
    lists = [[np.frombuffer(p, "<u2").tolist() if len(p) % 2 == 0 else np.flatnonzero(np.unpackbits(np.frombuffer(p, np.uint8))).tolist() for p in r["planes"]] for r in made]
    assert lists == [[[0], [], [0]], [[1], [1], [2]]]


def brute_top(rows, best, scale):
    sound = [(i, [math.floor(scale * x) if abs(x) < 2**53 else int(x) * scale for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for at, (q, v) in enumerate(sound):
        if q is None or q % 20:
            continue
        scored = [(max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(v, w)))), i, k) for k, (i, w) in enumerate(sound) if k != at]  # noqa: B905
        scored.sort(key=lambda s: (-s[0], s[1] is None, s[1] or 0, s[2]))
        out += [(q, n + 1, i, s) for n, (s, i, _) in enumerate(scored[:best])]
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [16384, 13])
def test_top_k(spark, block):
    from docketlake.llm.topk_search import top_k

    rng = random.Random(2)
    rows = [(i, [rng.choice([0.0, 0.0, rng.uniform(-1, 1)]) for _ in range(8)]) for i in range(120)]
    rows += [(200 + i, [0.5] * 8) for i in range(30)] + [(220, [0.5] * 8), (None, [0.5] * 8)]
    rows += [(300, None), (320, [None] * 8), (340, [float("nan")] * 8), (360, [float("inf")] * 8), (380, []), (400, [1.0, -0.3]), (401, [0.1] * 11)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, rank int").repartition(3)
    got = top_k(df, F.col("vec_id") % 20 == 0, best=7, block=block)
    assert sorted(map(tuple, got.collect()), key=str) == brute_top(rows, 7, 64)
    assert top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    few = spark.createDataFrame([(20, [1.0]), (21, [0.5])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in top_k(few, F.col("vec_id") % 20 == 0).collect()] == [(20, 1, 21, 2048)]


def test_top_k_of_large_components(spark):
    from docketlake.llm.topk_search import top_k

    rows = [(0, [1e15, 3.0]), (1, [1e15, 1.0]), (2, [1e200, 0.0]), (3, [-1e200, 5.0]), (4, [1e15, 1.0]), (5, [1e308, 1e308]), (6, [0.015625, 1e7])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, top_k(df, F.col("vec_id") % 20 == 0).collect()), key=str) == brute_top(rows, 20, 64)
    small = df.where("vec_id in (0, 1, 4, 6)")
    want = brute_top([r for r in rows if r[0] in (0, 1, 4, 6)], 20, 64)
    assert sorted(map(tuple, top_k(small, F.col("vec_id") % 20 == 0).collect()), key=str) == want


def brute_draw(rows, target, percent, least):
    def features(text):
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
        return words, [zlib.crc32(" ".join(words[i : i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(words) - n + 1)]

    found = [(i, *features(t)) for i, t in rows]
    s, t = Counter(b for _, _, f in found for b in f), Counter(b for x in target for b in features(x)[1])
    high, low = sum(s.values()) + 10000.0, sum(t.values()) + 10000.0
    gain = {b: math.floor(1000 * math.log((t[b] + 1.0) * high / ((s[b] + 1.0) * low))) for b in s}
    out = []
    for i, words, f in found:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words)])
    able = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    rank = {id(r): k + 1 for k, r in enumerate(able[: percent * len(able) // 100])}
    return sorted([(*r[:4], rank.get(id(r))) for r in out], key=str)


@pytest.mark.parametrize(("percent", "least"), [(5, 20), (50, 3), (100, 0)])
def test_resampling(spark, percent, least):
    from docketlake.llm.resampling import resample

    rng = random.Random(5)
    words = [*"the quick Brown fox Straße ÑANDÚ 日本語 x_y-z 3.14 don't".split(), "a" * 40]
    make = lambda n: rng.choice([" ", "\t\n", "--"]).join(rng.choice(words) for _ in range(n))
    rows = [(i, make(rng.randint(0, 90))) for i in range(150)] + [(500 + i, t) for i, t in enumerate(TEXTS)]
    rows += [(501, ""), (None, make(30)), (900, rows[0][1]), (901, rows[0][1])]
    target = [make(40) for _ in range(5)] + [None, "", "one", "one two"]
    docs = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, score int").repartition(5)
    made = spark.createDataFrame([(t,) for t in target], "text string")
    got = resample(docs, made, percent, least).select("doc_id", "n_features", "weight", "score", "rank")
    assert sorted(map(tuple, got.collect()), key=str) == brute_draw(rows, target, percent, least)
    assert resample(docs.limit(0), made).count() == 0
    again = resample(docs.unionByName(docs), made.limit(0), 100, 1).select("rank").where("rank is not null").collect()
    assert sorted(r[0] for r in again) == list(range(1, len(again) + 1))


def test_features_of_long_words_are_linear():
    from docketlake.llm.resampling import feature_hashes, pack_buckets, unpack_buckets, words_of

    assert len(feature_hashes(b"a" * 3_000_000 + b" b")) == 3
    assert [words_of(n) for n in (0, 1, 3, 6, 9)] == [0, 1, 2, 3, 4]
    buckets = np.array([9999, 3, 3, 70_000])
    assert unpack_buckets(pack_buckets(buckets)).tolist() == [3, 3, 9999, 70_000]


def test_operators_run_where_workers_cannot_import_them(tmp_path):
    """Workers started in another folder have the operators' functions by value only."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    code = f"""
import sys
sys.path.insert(0, {root!r})
import __spark_entry__ as entry
sys.path.remove({root!r})
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4")
    .config("spark.sql.warehouse.dir", {str(tmp_path / "w")!r}).config("spark.driver.memory", "3g").getOrCreate())
spark.sparkContext.setLogLevel("OFF")
for name in ("op1_token_counts", "op6_best_fit_packing", "op9_toxicity", "op11_token_alignment", "op12_topk_search", "op13_resampling"):
    print(name, entry.queries()[name](spark, "/root/testdata/sf0.001").count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600, check=False)
    assert out.returncode == 0 and len(out.stdout.splitlines()) >= 6, out.stderr[-2000:]
