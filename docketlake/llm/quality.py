"""Quality rules: plain text statistics, then a hashed n-gram likelihood ratio.

Two multinomials over hashed n-grams are counted: one of trusted documents, one
of the whole corpus.  A document's score is the mean log ratio of its n-grams
under the two, so length does not matter; text that trusted documents do not
contain scores low.  One threshold, set from all labelled rows, decides every
document.  Everything is a column expression; no Python runs on executors.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 16
SMOOTHING = 1.0
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

# White space between words, symbols, and the tokens of the n-grams.
_SPACES = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"
_TOKEN = r"[\p{L}\p{N}]+|[^\p{L}\p{N}\x20\x09-\x0D]+"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, _SPACES, " " * len(_SPACES)), " "), "")


def repeated_words(parts: Column) -> Column:
    """Words inside a three-word window that the text has twice or more."""

    def spread(windows: Column) -> Column:
        last = F.size(windows) - 1
        placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def found(p: Column) -> Column:
            same = lambda k, other: (other >= 0) & (other <= last) & (F.get(p, other)["h"] == p[k]["h"])
            hits = F.filter(F.sequence(F.lit(0), last), lambda k: same(k, k - 1) | same(k, k + 1))
            return F.sort_array(F.transform(hits, lambda k: p[k]["i"]))

        def covered(at: Column) -> Column:
            steps = F.sequence(F.lit(1), F.size(at) - 1)
            more = F.aggregate(steps, F.lit(3), lambda n, k: n + F.least(F.lit(3), at[k] - at[k - 1]))
            return F.when(F.size(at) > 1, more).otherwise(0)

        return _let(placed, lambda p: _let(found(p), covered))

    def counted(w: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2]))
        return F.when(
            F.size(w) > 3,
            _let(windows, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), spread(h)).otherwise(0)),
        ).otherwise(0)

    return _let(parts, counted)


def text_statistics(text: Column) -> dict[str, Column]:
    """``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` of a text; null is empty."""
    text = F.coalesce(text, F.lit(""))
    bare = lambda c: F.translate(c, _SPACES, "")
    lines = F.filter(F.split(text, "\n"), lambda line: bare(line) != "")
    found = _let(words(text), lambda w: F.struct(F.size(w).alias("n"), repeated_words(w).alias("again")))
    repeats = _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))
    columns = {
        "_words": found,
        "word_chars": F.length(bare(text)),
        "n_symbols": F.length(text) - F.length(F.translate(text, _SYMBOLS, "")),
        "n_dup_lines": repeats,
    }
    return {k: c if k == "_words" else c.cast("long") for k, c in columns.items()}


def _bucket(buckets: int, *tokens: Column) -> Column:
    return F.pmod(F.xxhash64(*tokens), F.lit(buckets)).cast("int")


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_TOKEN), 0)


def ngram_buckets(text: Column, buckets: int = BUCKETS) -> Column:
    """Hash buckets of the text's tokens and of its pairs of neighbouring tokens."""

    def both(t: Column) -> Column:
        single = F.transform(t, lambda x: _bucket(buckets, x))
        pairs = F.transform(F.sequence(F.lit(1), F.size(t) - 1), lambda i: _bucket(buckets, t[i - 1], t[i]))
        return F.when(F.size(t) > 1, F.concat(single, pairs)).otherwise(single)

    return _let(tokens(text), both)


def labelled_rows(labels: DataFrame) -> DataFrame:
    """``doc_id, good`` of all good and bad rows."""
    rows = labels.where("doc_id is not null and quality in (0, 1)").select("doc_id", (F.col("quality") == 1).alias("good"))
    return rows.groupBy("doc_id").agg(F.min("good").alias("good"))


def ratio_weights(
    docs: DataFrame, labelled: DataFrame, buckets: int = BUCKETS, smoothing: float = SMOOTHING
) -> tuple[list[float], dict[bool, float]]:
    """Log ratio of trusted to raw probability of every bucket, smoothed, and the mean scores of good and bad rows.

    A mean of scores is linear in the weights: a bucket's weight enters it with the sum,
    over the rows, of its share in their n-grams.  So counts and shares come from one pass,
    in which the texts meet their labels by one shuffle, whatever their number.
    """
    docs = docs.select("doc_id", "text")
    known = docs.where("doc_id is not null").join(labelled.hint("shuffle_hash"), "doc_id", "left")
    marked = known.unionByName(docs.where("doc_id is null").withColumn("good", F.lit(None).cast("boolean")))
    grams = marked.select("good", ngram_buckets(F.col("text"), buckets).alias("all"))
    # An outer explode: of the other kind, the optimizer would infer a filter on the n-grams below the shuffle.
    share = F.try_divide(F.lit(1), F.size("all"))
    grams = grams.select("good", share.alias("share"), F.explode_outer("all").alias("b"))
    counts = grams.groupBy("b").agg(
        F.count("*").alias("raw"),
        F.count_if("good").alias("trusted"),
        F.sum(F.when(F.col("good"), F.col("share"))).alias("in_good"),
        F.sum(F.when(~F.col("good"), F.col("share"))).alias("in_bad"),
    )
    raw, good, shares = [smoothing] * buckets, [smoothing] * buckets, {}
    for r in counts.where("b is not null").collect():  # one row for each bucket at most
        raw[r.b] += r.raw
        good[r.b] += r.trusted
        shares[r.b] = (r.in_good or 0.0, r.in_bad or 0.0)
    shift = math.log(sum(raw) / sum(good))
    weights = [round(math.log(g / r) + shift, 4) for g, r in zip(good, raw, strict=True)]
    means = {}
    for kind in (0, 1):
        rows = math.fsum(share[kind] for share in shares.values())  # the shares of a row add up to 1
        if rows > 0:
            means[kind == 0] = math.fsum(share[kind] * weights[b] for b, share in shares.items()) / rows
    return weights, means


def constant_array(values: list[float]) -> Column:
    """A constant array of a bounded number of values, to four decimals; folded to one literal by the optimizer."""
    return F.split(F.lit(",".join(f"{v:.4f}" for v in values)), ",").cast("array<double>")


def score(text: Column, weights: Column, buckets: int = BUCKETS) -> Column:
    """Mean weight of the text's n-grams, NULL without any; they are added up as they are hashed."""

    def mean(t: Column) -> Column:
        weight = lambda *x: weights[_bucket(buckets, *x)]
        step = lambda s, i: s + weight(t[i]) + weight(t[i - 1], t[i])
        more = F.aggregate(F.sequence(F.lit(1), F.size(t) - 1), weight(t[0]), step) / (2 * F.size(t) - 1)
        return F.when(F.size(t) > 1, more).when(F.size(t) == 1, weight(t[0]))

    return _let(tokens(text), mean)


def quality_rules(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``docs`` (any columns, among them ``doc_id, text``) with its statistics, ``llr``, ``base_failed`` and ``kept``.

    A document fails the base rules with fewer than ``MIN_WORDS`` words, or with
    more than ``MAX_REPEAT_PERCENT`` percent of them in repeated three-word
    windows.  The others are kept if their score reaches the threshold, which
    lies half-way between the mean scores of good and bad labelled rows; without
    rows of both kinds the base rules decide alone.  Null and empty texts have no
    words and fail.  Labels that contradict each other count as bad; repeated
    rows get the same verdict; columns named like new ones are replaced.
    """
    weights, means = ratio_weights(docs, labelled_rows(labels), buckets)
    llr = score(F.col("text"), constant_array(weights), buckets)
    limit = (means[True] + means[False]) / 2 if len(means) == 2 and means[True] > means[False] else -math.inf

    found = docs.withColumns({**text_statistics(F.col("text")), "llr": llr})
    n, again = F.col("_words.n").cast("long"), F.col("_words.again").cast("long")
    found = found.withColumns({"n_words": n, "n_repeat_words": again}).drop("_words")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    found = found.withColumn("base_failed", failed)
    return found.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("llr") >= limit, F.lit(True)))
