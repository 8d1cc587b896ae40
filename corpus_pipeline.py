"""From raw documents to packed training sequences, in five stages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketlake.llm.common import materialise
from docketlake.llm.jaccard_join import drop_near_copies
from docketlake.llm.mixing import mix_sources
from docketlake.llm.packing import pack
from docketlake.llm.quality import quality_rules
from docketlake.llm.queries import domain_of, table
from docketlake.llm.substring_dedup import remove_repeats


def _aside(docs: DataFrame, *used: str) -> DataFrame:
    """The columns a stage works on, and all others as one, out of reach of the names it makes."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in used]
    return docs.select(*used, (F.struct(*others) if others else F.lit(None)).alias("_others"))


def _restored(rows: DataFrame, docs: DataFrame, used: tuple[str, ...], new: dict[str, Column] | None = None) -> DataFrame:
    """The columns of ``docs`` again, with ``new`` values for some."""
    own = {c: F.col(c) if c in used else F.col(f"_others.`{c}`") for c in docs.columns} | (new or {})
    return rows.select(*[own[c].alias(c) for c in docs.columns])


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep.

    Null and blank texts go.  Repeated rows share their verdict, rows without an id have
    no label and are judged like others; labels that contradict each other count as bad.
    """
    used = ("doc_id", "text")
    found = quality_rules(_aside(docs, *used), table(spark, sf_dir, "labels", "doc_id", "quality"))
    return _restored(found.where("kept"), docs, used)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies.

    Repeated rows are one.  Null and blank texts are copies of nothing; rows without an
    id are told apart by their text.
    """
    return drop_near_copies(docs)


def distinct_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that occur earlier; documents of which nothing is left go.

    Null and blank texts stay as they are.  Of rows that share an id, none is earlier.
    """
    used = ("doc_id", "text")
    cut = remove_repeats(_aside(docs, *used), as_text=True).where("n_bytes = 0 or trim(kept) <> ''")
    new = {"text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    return _restored(cut, docs, used, {c: v for c, v in new.items() if c in docs.columns})


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """95 % of the tokens, in damped proportion to the sources' sizes, each document once at most.

    A null source or language is one of its own; documents without words cost nothing.
    Rows of one id are taken or left together.
    """
    used = ("doc_id", "text", "lang", "source")
    return _restored(mix_sources(_aside(docs, *used), domain_of("source"), share=0.95, max_epochs=1), docs, used)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their place in a training sequence.

    A null or blank text is its end token and what its white space makes; long texts are cut,
    repeated rows packed like any others.
    """
    return pack(docs.select("doc_id", "text"))


STAGES = [
    ("quality rules", good_documents),
    ("n-gram Jaccard join", distinct_documents),
    ("suffix-array dedup", distinct_passages),
    ("mixing sources to target weights", mixed_sources),
    ("best-fit packing", packed_sequences),
]

#: The tokenizer, the shingle join and the passages have no SQL.  The tests hold each stage's operator against a
#: brute-force version, and the stages against odd rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each but the last is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
