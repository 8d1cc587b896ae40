"""The operators as registered queries over the driver tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketlake.llm.embedding_dedup import near_duplicates
from docketlake.llm.html_extraction import extract_text
from docketlake.llm.jaccard_join import jaccard_groups
from docketlake.llm.language_id import identify_language
from docketlake.llm.mixing import mix_sources
from docketlake.llm.packing import pack
from docketlake.llm.quality import quality_rules
from docketlake.llm.resampling import resample
from docketlake.llm.substring_dedup import remove_repeats
from docketlake.llm.token_alignment import align_tokenizers
from docketlake.llm.token_counts import token_counts
from docketlake.llm.topk_search import top_k
from docketlake.llm.toxicity import score_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet").select(*columns)


@query
def op1_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    counted = token_counts(table(spark, folder, "documents", "doc_id", "text"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))


@query
def op3_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "embeddings", "vec_id", "embedding"))


@query
def op5_html_text(spark: SparkSession, folder: str) -> DataFrame:
    return extract_text(table(spark, folder, "pages", "page_id", "url", "html"))


@query
def op6_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack(table(spark, folder, "documents", "doc_id", "text"))


@query
def op8_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents", "doc_id", "text")
    found = quality_rules(docs, table(spark, folder, "labels", "doc_id", "quality"))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return found.select("doc_id", *counts, "base_failed", "kept", "llr")


@query
def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents", "doc_id", "text")
    found = score_toxicity(docs, table(spark, folder, "labels", "doc_id", "toxic"))
    return found.select("doc_id", "held_out", "score", "predicted")


@query
def op10_language_id(spark: SparkSession, folder: str) -> DataFrame:
    found = identify_language(table(spark, folder, "documents", "doc_id", "lang", "text"))
    return found.select("doc_id", "held_out", "lang_pred", "score")


@query
def op2_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    cut = remove_repeats(table(spark, folder, "documents", "doc_id", "text"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op4_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_groups(table(spark, folder, "documents", "doc_id", "text"))


def domain_of(source: str) -> Column:
    """The tables name no domain; this puts each source into one of three."""
    number = F.pmod(F.crc32(F.col(source).cast("binary")), F.lit(3))
    return F.element_at(F.array(F.lit("books"), F.lit("reference"), F.lit("web")), (number + 1).cast("int"))


@query
def op7_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents", "doc_id", "text", "lang", "source")
    mixed = mix_sources(docs, domain_of("source"))
    return mixed.select("doc_id", "domain", "lang", "source", "n_tokens", "epoch")


@query
def op11_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    aligned, _ = align_tokenizers(table(spark, folder, "documents", "doc_id", "text"))
    return aligned.select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"
    )


@query
def op12_topk_search(spark: SparkSession, folder: str) -> DataFrame:
    return top_k(table(spark, folder, "embeddings", "vec_id", "embedding"), F.col("vec_id") % 20 == 0)


ORACLES["op12_topk_search"] = """
WITH vectors AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS weights
    FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.weights, c.weights)::BIGINT AS score
    FROM vectors q JOIN vectors c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""


@query
def op13_resampling(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents", "doc_id", "text")
    drawn = resample(docs, table(spark, folder, "benchmark", "text"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


# CRC-32 is not a function of the other engine; it goes byte by byte over the distinct n-grams.
ORACLES["op13_resampling"] = r"""
WITH RECURSIVE texts AS (
    SELECT 0 AS target, doc_id AS id, text FROM documents
    UNION ALL SELECT 1, item_id, text FROM benchmark
), words AS (
    SELECT target, id, unnest(list) AS word, unnest(range(len(list))) AS pos
    FROM (
        SELECT target, id, regexp_extract_all(
            translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'
        ) AS list
        FROM texts
    )
), runs AS (
    SELECT target, id, word AS one,
        word || ' ' || lead(word, 1) OVER behind AS two,
        word || ' ' || lead(word, 1) OVER behind || ' ' || lead(word, 2) OVER behind AS three
    FROM words WINDOW behind AS (PARTITION BY target, id ORDER BY pos)
), grams AS (
    SELECT target, id, gram FROM (
        SELECT target, id, unnest([one, two, three]) AS gram FROM runs
    ) WHERE gram IS NOT NULL
), distinct_grams AS MATERIALIZED (
    SELECT row_number() OVER () AS number, gram, hex(encode(gram)) AS bytes FROM (SELECT DISTINCT gram FROM grams)
), steps AS MATERIALIZED (
    SELECT byte, list_reduce([byte, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, x:
        xor(a >> 1, (a & 1) * 3988292384)) AS value
    FROM (SELECT range::BIGINT AS byte FROM range(256))
), crc AS (
    SELECT number, bytes, 1 AS pos, 4294967295::BIGINT AS value FROM distinct_grams
    UNION ALL
    SELECT c.number, c.bytes, c.pos + 2, xor(c.value >> 8, s.value)
    FROM crc c JOIN steps s ON s.byte = xor(c.value & 255, ('0x' || substr(c.bytes, c.pos, 2))::BIGINT)
    WHERE c.pos < length(c.bytes)
), buckets AS MATERIALIZED (
    SELECT gram, xor(value, 4294967295) % 10000 AS bucket
    FROM crc JOIN distinct_grams USING (number) WHERE pos > length(crc.bytes)
), hashed AS MATERIALIZED (
    SELECT target, id, bucket FROM grams JOIN buckets USING (gram)
), counts AS (
    SELECT bucket, count(*) FILTER (target = 0)::DOUBLE AS s, count(*) FILTER (target = 1)::DOUBLE AS t
    FROM hashed GROUP BY bucket
), gains AS (
    SELECT bucket, floor(1000 * ln((t + 1) * (sum(s) OVER () + 10000) / ((s + 1) * (sum(t) OVER () + 10000)))) AS gain
    FROM counts
), weights AS (
    SELECT id, count(*) AS n_features, sum(gain)::BIGINT AS weight
    FROM hashed JOIN gains USING (bucket) WHERE target = 0 GROUP BY id
), scored AS (
    SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
        coalesce(weight, 0) + floor(-1000 * ln(-ln(
            (('0x' || substr(sha256('42:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE
        )))::BIGINT AS score
    FROM documents LEFT JOIN weights ON id = doc_id
), placed AS (
    SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n
    FROM scored WHERE n_features >= 57
)
SELECT s.doc_id, n_features, weight, score, CASE WHEN place <= 5 * n // 100 THEN place END AS rank
FROM scored s LEFT JOIN placed p ON p.doc_id = s.doc_id
"""
