"""Toxic passages as maximal scoring segments of token log-odds.

Token scores are log-odds ratios of toxic to other labelled text under a
Dirichlet prior, for words and for word beginnings, which share evidence among
inflected forms.  A linear scan finds all maximal scoring segments of a text.
The best segment is set against the extreme value distribution of best segments
in clean text of that length, and a logistic curve through labelled rows turns
this into a score from 0 to 1.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketlake.llm.common import bound_batches, materialise

#: Labelled rows of each kind that the model is fitted on, the first by hash.
LABELLED = 8_000
#: Features of the model, the most significant ones.
FEATURES = 50_000
#: Weight of the Dirichlet prior, as a share of the labelled tokens; the prior's means are their frequencies.
PRIOR = 0.1
#: Least likelihood ratio statistic, and least log-odds, of a feature.
SIGNIFICANT = 30.0
LEAST_WEIGHT = 1.5
BEGINNINGS = (4, 5, 6)
WORD = re.compile(r"[^\W\d_]+")


def held_out(doc_id: Column) -> Column:
    """Rows that nothing is learned from; a null id counts as the empty string."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


@dataclass
class ToxicityModel:
    weights: dict[str, float]
    other: float = -0.05
    decay: float = 1.0
    slope: float = 1.0
    shift: float = 0.0

    def token(self, word: str) -> float:
        """The strongest weight among a word and its beginnings, or the one of other words."""
        found = [self.weights.get(word), *(self.weights.get(word[:n] + "*") for n in BEGINNINGS if len(word) > n)]
        return max((w for w in found if w is not None), default=self.other)

    def evidence(self, segments: list[tuple[int, int, float]], n_words: int) -> float:
        best = max((s for _, _, s in segments), default=0.0)
        return self.decay * best - math.log(n_words + 1)

    def probability(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, self.slope * evidence + self.shift))))


def maximal_segments(scores: Iterator[tuple[int, float]], other: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments ``(first, last + 1, score)`` in one pass (Ruzzo and Tompa's scan).

    ``scores`` holds the positive tokens as position and score; every other
    token scores ``other``, which is negative.
    """
    found: list[tuple[int, int, float, float]] = []  # first, end, sum before, sum up to the end
    lower: list[int] = []  # for each of them the last one before it with a smaller sum before
    total, at = 0.0, 0
    for place, score in scores:
        total += other * (place - at)
        new = (place, place + 1, total, total + score)
        total, at = total + score, place + 1
        j = len(found) - 1
        while True:
            while j >= 0 and found[j][2] >= new[2]:
                j = lower[j]
            if j < 0 or found[j][3] >= new[3]:
                found.append(new)
                lower.append(j)
                break
            new = (found[j][0], new[1], found[j][2], new[3])
            before = lower[j]
            del found[j:], lower[j:]
            j = before
    return [(a, b, high - low) for a, b, low, high in found]


def _scorer(model: ToxicityModel):
    class Scores(dict):
        def __missing__(self, word: str) -> float:
            score = model.token(word)
            if len(self) < 300_000:
                self[word] = score
            return score

    known = Scores()

    def run(text: str | None) -> tuple[int, list[tuple[int, int, float]]]:
        words = WORD.findall((text or "").lower())
        hot = ((i, s) for i, s in enumerate(map(known.__getitem__, words)) if s > 0)
        return len(words), maximal_segments(hot, model.other)

    return run


_FOUND = "evidence double, score double, passages array<struct<first: int, last: int, score: double>>"


def _score_batches(model: ToxicityModel):
    kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = _scorer(model)
        for batch in batches:
            evidence, passages = [], []
            for text in batch.column("text").to_pylist():
                n, segments = scan(text)
                evidence.append(model.evidence(segments, n))
                passages.append([{"first": a, "last": b - 1, "score": s} for a, b, s in segments])
            names = [n for n in batch.schema.names if n != "text"]
            made = [pa.array(evidence, pa.float64()), pa.array(map(model.probability, evidence), pa.float64()), pa.array(passages, kind)]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *made], [*names, "evidence", "score", "passages"])

    return run


def _scored(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    rest = docs.drop("evidence", "score", "passages")
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rest.schema if f.name != "text")
    return rest.mapInArrow(_score_batches(model), kinds + _FOUND)


def _labelled(labels: DataFrame, bound: int) -> DataFrame:
    rows = labels.where("doc_id is not null and toxic in (0, 1)").where(~held_out(F.col("doc_id")))
    rows = rows.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    return rows.where("toxic = 1").orderBy(*order).limit(bound).unionByName(rows.where("toxic = 0").orderBy(*order).limit(bound))


def fit(docs: DataFrame, labels: DataFrame, bound: int = LABELLED) -> ToxicityModel:
    """A model of the first ``bound`` labelled rows of each kind that are not held out."""
    sample = docs.select("doc_id", "text").join(F.broadcast(_labelled(labels, bound)), "doc_id")
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}]+"), 0)
    # A use counts once with the same neighbours: copies of a passage are one piece of evidence.
    context = lambda w, i: F.xxhash64(F.get("_w", i - 1), w, F.get("_w", i + 1))
    placed = F.transform("_w", lambda w, i: F.struct(w.alias("word"), context(w, i).alias("c")))
    placed = sample.select("toxic", words.alias("_w")).select("toxic", F.explode(placed).alias("p"))
    placed = placed.groupBy("p.word", "p.c").agg(F.max("toxic").alias("t"), F.max(1 - F.col("toxic")).alias("o"))
    uses = materialise(placed.groupBy("word").agg(F.sum("t").alias("t"), F.sum("o").alias("o")))
    begin = [F.when(F.length("word") > n, F.concat(F.substring("word", 1, n), F.lit("*"))) for n in BEGINNINGS]
    features = uses.select(F.explode(F.array_compact(F.array("word", *begin))).alias("f"), "t", "o").groupBy("f")
    features = features.agg(F.sum("t").alias("t"), F.sum("o").alias("o"))
    total = uses.agg(F.sum("t").alias("t"), F.sum("o").alias("o")).first()
    if not total["t"] or not total["o"]:
        return ToxicityModel({}, shift=-1.0 if not total["t"] else 1.0)
    n_t, n_o = float(total["t"]), float(total["o"])
    t, o, share = F.col("t"), F.col("o"), n_t / (n_t + n_o)
    expected = (t + o) / (n_t + n_o)
    delta = F.log((t / n_t + PRIOR * expected) / (o / n_o + PRIOR * expected))
    part = lambda seen, p: F.when(seen > 0, seen * F.log(seen / ((t + o) * p))).otherwise(0.0)
    surprise = 2 * (part(t, share) + part(o, 1 - share))
    rated = features.select("f", "t", delta.alias("d"), surprise.alias("z"))
    rated = rated.where((F.col("z") >= SIGNIFICANT) & (F.col("d") >= LEAST_WEIGHT))
    top = rated.orderBy(F.desc("z"), "f").limit(FEATURES).collect()
    model = ToxicityModel({r.f: r.d for r in top})
    if not top:
        return ToxicityModel({}, shift=-1.0)

    # Shares of positive tokens: a whole word counts once, whichever of its features is in the model.
    known = F.array_compact(F.array("word", *begin))
    weighted = uses.select("t", "o", known.alias("f")).mapInArrow(_best_weights(model), "t long, o long, w double")
    by_weight = weighted.groupBy(F.round("w", 1).alias("w")).agg(F.sum("t").alias("t"), F.sum("o").alias("o")).collect()
    hot_t, hot_o = sum(r.t for r in by_weight), sum(r.o for r in by_weight)
    model.other = min(-1e-3, math.log((1 - hot_t / n_t + 1e-9) / (1 - hot_o / n_o + 1e-9)))
    model.decay = _decay([(r.w, (r.o + 0.5) / (n_o + 1)) for r in by_weight], model.other)

    points = _scored(sample, model).select("toxic", "evidence").collect()  # two bounded kinds of rows
    x, y = np.array([p.evidence for p in points]), np.array([p.toxic for p in points], float)
    model.slope, model.shift = _logistic(x, y)
    return model


def _best_weights(model: ToxicityModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            best = [max((model.weights.get(f, 0.0) for f in fs), default=0.0) for fs in b.column("f").to_pylist()]
            out = pa.RecordBatch.from_arrays([b.column("t"), b.column("o"), pa.array(best, pa.float64())], ["t", "o", "w"])
            yield out.filter(pa.compute.greater(out.column("w"), 0.0))

    import pyarrow.compute  # noqa: F401

    return run


def _decay(chances: list[tuple[float, float]], other: float) -> float:
    """The positive root of the moment equation: the rate at which best scores of clean text thin out."""
    rest = 1 - sum(p for _, p in chances)
    low, high = 1e-6, 10.0
    for _ in range(60):
        mid = (low + high) / 2
        moment = rest * math.exp(mid * other) + sum(p * math.exp(mid * w) for w, p in chances)
        low, high = (mid, high) if moment < 1 else (low, mid)
    return max(low, 0.05)


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a balanced logistic curve, by Newton steps with a small ridge."""
    centre, scale = x.mean(), x.std() + 1e-9
    z = (x - centre) / scale
    weight = np.where(y > 0, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    b = np.zeros(2)
    design = np.stack([z, np.ones_like(z)], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ b, -30, 30)))
        slope = design.T @ (weight * (y - p)) - 1e-4 * b
        curve = design.T @ (design * (weight * p * (1 - p))[:, None]) + 1e-4 * np.eye(2)
        step = np.linalg.solve(curve, slope)
        b += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(b[0] / scale), float(b[1] - b[0] * centre / scale)


def score_toxicity(docs: DataFrame, labels: DataFrame, bound: int = LABELLED) -> DataFrame:
    """``docs`` without ``text``, with ``held_out, evidence, score, predicted`` and the toxic ``passages``.

    Passages are word positions of every maximal scoring segment, with its
    score.  ``predicted`` is 1 from a score of 0.5.  Null and empty texts have no
    passage and a low score; without labels of both kinds every row gets one
    score.  A row labelled both ways is toxic.  Repeated rows are scored alike,
    columns named like new ones are replaced.
    """
    bound_batches(docs.sparkSession)
    docs = docs.drop("held_out", "predicted")
    out = _scored(docs, fit(docs, labels, bound)).withColumn("held_out", held_out(F.col("doc_id")))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
