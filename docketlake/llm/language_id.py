"""Language of texts: sparse multinomial logistic regression on hashed character n-grams.

Features are TF-IDF weights of character one- to three-grams in ``BUCKETS``
hash buckets.  The model is trained online by follow-the-regularised-leader
with an elastic net penalty, and its probabilities are calibrated by one
temperature on rows kept from training.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docketlake.llm.common import bound_batches
from docketlake.llm.toxicity import held_out

BUCKETS = 1 << 14
#: Rows of a language that the model is fitted on, the first by hash; every fifth sets the temperature.
PER_LANGUAGE = 1_500
LANGUAGES = 1_000
EPOCHS = 2
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.01
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")


def ngram_counts(text: str, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the text's one- to three-grams, and how often each occurs."""
    c = np.frombuffer(f" {' '.join(text.lower().split())} ".encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    a, b, d = c * np.uint64(0x9E3779B97F4A7C15), c * np.uint64(0xC2B2AE3D27D4EB4F), c * np.uint64(0x165667B19E3779F9)
    shift = np.uint64(64 - (buckets.bit_length() - 1))
    grams = np.concatenate([a, a[:-1] + b[1:], a[:-2] + b[1:-1] + d[2:]])
    counts = np.bincount((grams * np.uint64(0xD6E8FEB86659FD93) >> shift).astype(np.int64), minlength=buckets)
    at = np.flatnonzero(counts)
    return at, counts[at]


class LanguageModel:
    def __init__(self, languages: list[str], idf: np.ndarray) -> None:
        self.languages, self.idf = languages, idf.astype(np.float32)
        self.weights = np.zeros((len(idf), len(languages)), np.float32)
        self.bias = np.zeros(len(languages), np.float32)
        self.temperature = 1.0

    def vector(self, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        x = (1 + np.log(counts)) * self.idf[at]
        return x / max(1e-12, float(np.sqrt(x @ x)))

    def logits(self, at: np.ndarray, x: np.ndarray) -> np.ndarray:
        return x @ self.weights[at] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.languages or not _LETTER.search(text):
            return UNKNOWN, 0.0
        at, counts = ngram_counts(text, len(self.idf))
        p = _softmax(self.logits(at, self.vector(at, counts)) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(min(1.0, p[best]))


def _softmax(v: np.ndarray) -> np.ndarray:
    e = np.exp(v - v.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(model: LanguageModel, rows: list[tuple[np.ndarray, np.ndarray, int]]) -> None:
    """FTRL-proximal with elastic net; weights stay at zero until their gradients outweigh the L1 penalty."""
    z, n = np.zeros(model.weights.shape), np.zeros(model.weights.shape)
    zb, nb = np.zeros(len(model.languages)), np.zeros(len(model.languages))

    def solve(z: np.ndarray, n: np.ndarray, l1: float) -> np.ndarray:
        shrunk = np.sign(z) * np.maximum(0, np.abs(z) - l1)
        return -shrunk / ((BETA + np.sqrt(n)) / ALPHA + L2)

    for epoch in range(EPOCHS):
        for k in np.random.default_rng(epoch).permutation(len(rows)):
            at, x, y = rows[k]
            w, b = solve(z[at], n[at], L1), solve(zb, nb, 0.0)
            slope = _softmax(x @ w + b)
            slope[y] -= 1
            g = x[:, None] * slope
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA * w
            n[at] += g * g
            zb += slope - (np.sqrt(nb + slope * slope) - np.sqrt(nb)) / ALPHA * b
            nb += slope * slope
    model.weights, model.bias = solve(z, n, L1).astype(np.float32), solve(zb, nb, 0.0).astype(np.float32)


def calibrate(model: LanguageModel, rows: list[tuple[np.ndarray, np.ndarray, int]]) -> None:
    """The temperature, on a fixed grid, with the least log loss on ``rows``."""
    if rows:
        logits = np.stack([model.logits(at, x) for at, x, _ in rows])
        right = np.array([y for _, _, y in rows])
        loss = lambda t: -np.log(_softmax(logits / t)[np.arange(len(right)), right] + 1e-12).mean()
        model.temperature = float(min(np.geomspace(0.02, 5, 60), key=loss))


def _document_frequencies(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(buckets, np.int64), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    df[ngram_counts(text, buckets)[0]] += 1
                    n += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[at, -1]), pa.array(np.r_[df[at], n])], ["b", "n"])

    return run


def _features(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [ngram_counts(t or "", buckets) for t in batch.column("text").to_pylist()]
            lists = [pa.array([f[i] for f in found], pa.list_(pa.int32())) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), *lists], ["lang", "at", "counts"])

    return run


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, buckets: int = BUCKETS) -> LanguageModel:
    """A model of rows that are not held out and have a language and text.

    Document frequencies cover all of them; the weights are fitted on the first
    ``per_language`` rows of each of the ``LANGUAGES`` most frequent languages.
    """
    rows = docs.where(~held_out(F.col("doc_id"))).where("lang is not null and text is not null and text <> ''")
    counts = rows.select("text").mapInArrow(_document_frequencies(buckets), "b long, n long")
    counts = {r.b: r.n for r in counts.groupBy("b").agg(F.sum("n").alias("n")).collect()}  # a row per bucket
    frequency = np.array([counts.get(b, 0) for b in range(buckets)], float)
    idf = np.log((1 + counts.get(-1, 0)) / (1 + frequency)) + 1

    names = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).select("lang")
    slices = Window.partitionBy("lang", "_slice").orderBy("_h", "doc_id")
    ids = rows.select("doc_id", "lang").join(F.broadcast(names), "lang").withColumn("_h", F.xxhash64("doc_id"))
    # The first rows of hash slices first, so that a frequent language is not sorted in one task.
    ids = ids.withColumn("_slice", F.pmod("_h", F.lit(256))).withColumn("_n", F.row_number().over(slices))
    ids = ids.where(F.col("_n") <= per_language)
    ids = ids.withColumn("_n", F.row_number().over(Window.partitionBy("lang").orderBy("_h", "doc_id")))
    ids = ids.where(F.col("_n") <= per_language).select("doc_id").distinct()
    sample = rows.select("doc_id", "lang", "text").join(F.broadcast(ids), "doc_id")
    found = sample.mapInArrow(_features(buckets), "lang string, at array<int>, counts array<int>").collect()

    model = LanguageModel(sorted({r.lang for r in found}), idf)
    number = {name: i for i, name in enumerate(model.languages)}
    examples = []
    for r in sorted(found, key=lambda r: (r.lang, r.at, r.counts)):
        at = np.array(r.at)
        examples.append((at, model.vector(at, np.array(r.counts)), number[r.lang]))
    train(model, [e for k, e in enumerate(examples) if k % 5] or examples)
    calibrate(model, examples[::5])
    return model


def _predict(model: LanguageModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.predict(t) for t in batch.column("text").to_pylist()]
            names = [n for n in batch.schema.names if n != "text"]
            made = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *made], [*names, "lang_pred", "score"])

    return run


def identify_language(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """``docs`` without ``text``, with ``held_out, lang_pred, score`` for every row.

    A text that is null, empty or without letters is ``und`` with score 0, as is
    every text if no row with a language can be learned from.  Only ``text``
    enters a prediction.  Repeated rows are predicted alike; columns named like
    new ones are replaced.
    """
    bound_batches(docs.sparkSession)
    docs = docs.drop("lang_pred", "score", "held_out")
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema if f.name != "text")
    model = fit(docs.select("doc_id", "lang", "text"), per_language)
    out = docs.mapInArrow(_predict(model), f"{kinds}lang_pred string, score double")
    return out.withColumn("held_out", held_out(F.col("doc_id")))
