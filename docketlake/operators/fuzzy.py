"""Joining texts with many patterns within an edit distance of two.

Two texts that differ by two edits at most have a text in common that each reaches
by deleting two characters at most.  Those deletion neighbours are join keys; the
edit distance of the pairs that share one is then computed exactly.  Only the first
characters of long texts make keys: an alignment of two texts also aligns a beginning of
one with a beginning of the other whose length differs by two at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DISTANCE = 2  # fixed value: the edit distance that counts as similar
#: Characters of a text that make keys; a text has some 300 keys at most.
HEAD = 24


def deletions(text: Column) -> Column:
    """Hashes of the text and of all that is left after one or two deletions, each once."""

    def without(t: Column, i: Column) -> Column:
        return F.concat(F.substring(t, F.lit(1), i - 1), F.substring(t, i + 1, F.length(t)))

    places = F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)))
    once = F.transform(places, lambda i: without(text, i))
    # Behind the first deletion only, so that a pair of places is taken once.
    behind = lambda i: F.sequence(i + 1, F.greatest(F.length(text) - 1, i + 1))
    twice = F.flatten(F.transform(once, lambda t, i: F.transform(behind(i), lambda j: without(t, j))))
    return F.array_distinct(F.transform(F.concat(F.array(text), once, twice), lambda t: F.xxhash64(t)))


def fuzzy_join(values: DataFrame, patterns: DataFrame, value: str, pattern: str, case_sensitive: bool = False) -> DataFrame:
    """Rows of ``values`` with every row of ``patterns`` whose text is within two edits.

    Distinct texts are compared, so repeated ones cost nothing, and no text is compared
    with a pattern it shares no key with.  NULL matches nothing, an empty text those of
    up to two characters.  Columns of both sides have to differ in name.
    """
    fold = (lambda c: F.col(c)) if case_sensitive else (lambda c: F.lower(F.col(c)))
    left = values.select(fold(value).alias("_value")).where("_value is not null").distinct()
    right = patterns.select(fold(pattern).alias("_pattern")).where("_pattern is not null").distinct()
    near = range(-DISTANCE, DISTANCE + 1)
    keyed = left.select("_value", F.explode(deletions(F.substring("_value", 1, HEAD))).alias("_key"))
    heads = F.array_distinct(F.array(*[F.substring("_pattern", 1, HEAD + n) for n in near]))
    asked = right.select("_pattern", F.explode(heads).alias("_head"))
    asked = asked.select("_pattern", F.explode(deletions(F.col("_head"))).alias("_key")).distinct()
    # Sizes are estimated without the explosion, which would send the keys of all patterns through the driver.
    pairs = keyed.join(asked.hint("merge"), "_key").select("_value", "_pattern").distinct()
    pairs = pairs.where(F.levenshtein("_value", "_pattern", DISTANCE) >= 0)
    found = values.withColumn("_value", fold(value)).join(pairs, "_value")
    return found.join(patterns.withColumn("_pattern", fold(pattern)), "_pattern").drop("_value", "_pattern")
