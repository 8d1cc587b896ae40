"""Substring search without reading texts.

A search term has no white space, so a text contains it if one of the text's tokens
does.  The index therefore holds the distinct tokens with the ids of their records, and
for each trigram the tokens that have it.  A term's trigrams are intersected to the few
tokens that may contain it, those are tested, and their ids are the answer.  What a
search reads depends on the vocabulary and the hits, not on the texts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketlake.operators.index import BLOCK_IDS

#: Tokens of a term that are looked up as literals, which reach the scan; more are joined.
LITERALS = 1_000
_BREAK = r"[ \t\n\r\f\x0B]+"


def _grams(token: Column) -> Column:
    last = F.greatest(F.length(token) - 2, F.lit(1))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(token, i, F.lit(3))))


def write_text_index(df: DataFrame, path: str, text: Column, id_column: str = "id") -> None:
    """Store the index of a text per record; ids are numbers, their lists are cut into blocks."""
    tokens = F.array_distinct(F.split(F.lower(F.coalesce(text, F.lit(""))), _BREAK))
    rows = df.select(F.col(id_column).alias("id"), F.explode(tokens).alias("token")).where("token <> ''")
    lists = rows.groupBy("token", F.floor(F.col("id") / BLOCK_IDS).alias("id_block")).agg(
        F.sort_array(F.collect_set("id")).alias("ids")
    )
    lists.repartitionByRange("token", "id_block").sortWithinPartitions("token", "id_block").write.mode("overwrite").parquet(
        f"{path}/tokens"
    )
    words = df.sparkSession.read.parquet(f"{path}/tokens").select("token").distinct().where(F.length("token") >= 3)
    grams = words.select(F.explode(_grams(F.col("token"))).alias("gram"), "token")
    grams.repartitionByRange("gram", "token").sortWithinPartitions("gram", "token").write.mode("overwrite").parquet(
        f"{path}/grams"
    )


def tokens_with(spark: SparkSession, path: str, term: str) -> DataFrame:
    """Indexed tokens that contain a lower-case term."""
    if len(term) < 3:
        tokens = spark.read.parquet(f"{path}/tokens").select("token").distinct()
    else:
        wanted = sorted({term[i : i + 3] for i in range(len(term) - 2)})
        grams = spark.read.parquet(f"{path}/grams").where(F.col("gram").isin(wanted))
        tokens = grams.groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") == len(wanted)).select("token")
    return tokens.where(F.col("token").contains(term))


def ids_with(spark: SparkSession, path: str, term: str) -> DataFrame:
    """Ids of records whose text contains a lower-case term, each once."""
    tokens = tokens_with(spark, path, term)
    lists = spark.read.parquet(f"{path}/tokens")
    known = [r[0] for r in tokens.limit(LITERALS + 1).collect()]
    hits = lists.where(F.col("token").isin(known)) if len(known) <= LITERALS else lists.join(tokens, "token", "left_semi")
    return hits.select(F.explode("ids").alias("id")).distinct()


def search_index(spark: SparkSession, path: str, query: str) -> DataFrame | None:
    """Ids of records whose text contains every term of the query; None for a query without terms, which all match."""
    terms = sorted(set((query or "").lower().split()))
    if not terms:
        return None
    return reduce(lambda a, b: a.join(b, "id", "left_semi"), [ids_with(spark, path, t) for t in terms])
