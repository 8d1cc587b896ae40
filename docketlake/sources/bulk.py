"""Bulk CSV dumps as DataFrames of strings, one column per header name."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketlake.functions.parsing import strip
from docketlake.plans.paging import page
from docketlake.schemas import Entity, entity
from docketlake.sources.records import cut_records, read_lines, separated_records

CORRUPT = "_corrupt"
#: Different header lines that the files of one read may have; each becomes a parser in the plan.
MOST_HEADERS = 200
#: Longest header line that is read, and files whose header is read at a time.
HEADER_BYTES = 1 << 20
HEADER_THREADS = 16


@dataclass(frozen=True)
class Dialect:
    """How a dump quotes its values, and whether parsing is strict.

    The older dumps wrap values in backticks and are read leniently (a bad
    value becomes NULL or ''); the newer ones use double quotes, distinguish
    NULL from blank and reject rows whose required values do not convert.
    ``wrapped`` rows come from elsewhere and still have backticks around values.
    """

    name: str
    quote: str
    strict: bool
    wrapped: bool = False

    def options(self) -> dict[str, str]:
        return {
            "quote": self.quote,
            "escape": "\\",
            "nullValue": "\\N",
            "ignoreLeadingWhiteSpace": "true",
            "ignoreTrailingWhiteSpace": "false",
        }


DIALECTS = {
    "backtick": Dialect("backtick", "`", strict=False),
    "postgres": Dialect("postgres", '"', strict=True),
    "wrapped": Dialect("wrapped", "`", strict=False, wrapped=True),
}


def read_header(spark: SparkSession, path: str | list[str], quote: str = "`") -> list[str]:
    """Column names on the first line; an empty file has none."""
    first = spark.read.option("lineSep", "\n").text(path).select(strip(F.col("value"))).head()
    return header_names(first[0], quote) if first and first[0] else []


def header_names(line: str, quote: str) -> list[str]:
    """Names in a header line; one that was there before gets its position, so that names stay different."""
    names: list[str] = []
    for name in line.strip().split(","):
        name = name.strip().strip(quote + '"')
        names.append(f"{name}_{len(names)}" if name in names else name)
    return names


def first_lines(spark: SparkSession, path: str | list[str]) -> dict[str, str]:
    """The first line of every file by its path, as readers' metadata has it; nothing else of the file is read."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    codecs = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf)

    def first(name: str) -> tuple[str, str]:
        place = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(name))
        stream = place.getFileSystem(conf).open(place)
        try:
            codec = codecs.getCodec(place)
            text = jvm.org.apache.hadoop.io.Text()
            reader = jvm.org.apache.hadoop.util.LineReader(codec.createInputStream(stream) if codec else stream)
            reader.readLine(text, HEADER_BYTES, HEADER_BYTES)
            return place.toString(), text.toString()
        finally:
            stream.close()

    with ThreadPoolExecutor(HEADER_THREADS) as pool:
        return dict(pool.map(first, spark.read.text(path).inputFiles()))


def file_headers(spark: SparkSession, path: str | list[str], quote: str = "`") -> DataFrame:
    """``file, headers`` of every file; an empty file has none."""
    lines = first_lines(spark, path)
    rows = [(file, header_names(line, quote) if line.strip() else []) for file, line in lines.items()]
    return spark.createDataFrame(rows, "file string, headers array<string>")


def read_bulk(
    spark: SparkSession,
    path: str | list[str],
    data_type: str,
    dialect: str | Dialect = "backtick",
    method: str = "auto",
    limit: int | None = None,
    join_lines: str = "\n",
    partitions: int | None = None,
    columns: list[str] | None = None,
    required: list[str] | None = None,
) -> DataFrame:
    """Raw string columns of dumps plus ``_corrupt`` for rows of a wrong shape.

    Every file is read by its own header line: columns may be in any order, and
    those a file lacks are NULL in its rows.  ``columns`` names them for files without
    a header line.  The records of a file whose header lacks a name of ``required``
    are not parsed; they come out as corrupt rows with their text.

    ``method``: ``parity`` (also ``auto``) splits plain and .bz2 files over many tasks
    and reads a .gz file, told by its extension, with one; ``multiline`` is Spark's own
    reader (one task per file); ``separator`` cuts records at quote-newline-quote.
    A stray quote costs the record it is in.  ``partitions`` spreads the rows of a file
    that cannot be split.
    """
    e = entity(data_type)
    d = DIALECTS[dialect] if isinstance(dialect, str) else dialect
    if method == "multiline":
        rows = _multiline(spark, path, d, e, columns, required)
    elif method == "separator":
        headers = {} if columns else first_lines(spark, path)
        rows = parse_records(separated_records(spark, path, d.quote, headers), d, e, columns, required)
    elif method in ("parity", "auto"):
        records = cut_records(read_lines(spark, path), d.quote, join_lines)
        rows = parse_records(records, d, e, columns, required)
    else:
        raise ValueError(f"Unknown read method: {method}")
    rows = rows.drop("_file", "_record")
    if partitions:
        rows = rows.repartition(partitions)
    return page(rows, [], limit) if limit else rows


def _strings(names: list[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in [*names, CORRUPT]])


def _fails(names: list[str], required: list[str] | None) -> bool:
    return bool(set(required or ()) - set(names))


def _multiline(
    spark: SparkSession, path: str | list[str], d: Dialect, e: Entity, columns: list[str] | None, required: list[str] | None
) -> DataFrame:
    """One reader per distinct header, over the files that have it."""
    files: dict[tuple[str, ...], list[str]] = {}
    for name, line in first_lines(spark, path).items():
        names = columns or (header_names(line, d.quote) if line.strip() else e.columns)
        files.setdefault(tuple(names), []).append(name)
    _check_variants(len(files))
    parts = []
    for names, paths in sorted(files.items()):
        reader = spark.read.schema(_strings(list(names))).options(
            header=str(columns is None).lower(), multiLine="true", columnNameOfCorruptRecord=CORRUPT, **d.options()
        )
        part = reader.csv(paths).withColumn("_file", F.col("_metadata.file_path"))
        if _fails(list(names), required):
            text = F.concat_ws(",", *[F.coalesce(F.col(f"`{n}`"), F.lit("")) for n in names])
            part = part.select(F.coalesce(CORRUPT, text).alias(CORRUPT), "_file")
        parts.append(part)
    if not parts:
        return spark.createDataFrame([], _strings(columns or e.columns))
    wanted = list(dict.fromkeys([*(n for names in files for n in names), CORRUPT, "_file"]))
    whole = [p.select(*[F.col(f"`{n}`") if n in p.columns else F.lit(None).cast("string").alias(n) for n in wanted]) for p in parts]
    out = whole[0]
    for part in whole[1:]:
        out = out.unionByName(part)
    return out


def _check_variants(number: int) -> None:
    if number > MOST_HEADERS:
        raise ValueError(f"The files have {number} or more different headers; read them in several parts")


def parse_records(
    records: DataFrame,
    d: Dialect,
    e: Entity,
    columns: list[str] | None = None,
    required: list[str] | None = None,
) -> DataFrame:
    """Split records into columns by the header record of their file, which is dropped.

    The columns of all headers are united by name.  Each record is parsed once, by the
    parser of its header.
    """
    first = (F.col("record.block") == 0) & (F.col("record.line") == 0)
    if columns:
        lines, rows = [""], records.withColumn("_header", F.lit(""))
        variants = [columns]
    else:
        heads = records.where(first).select("file", F.trim(F.regexp_replace("value", r"\s+\z", "")).alias("_header"))
        lines = sorted(r[0] for r in heads.select("_header").distinct().limit(MOST_HEADERS + 1).collect())
        _check_variants(len(lines))
        variants = [header_names(line, d.quote) if line else e.columns for line in lines]
        rows = records.where(~first)
        # With one header for all files there is nothing to look up.
        rows = rows.withColumn("_header", F.lit(lines[0])) if len(lines) == 1 else rows.join(heads, "file")
    names = list(dict.fromkeys(n for v in variants for n in v)) or e.columns
    rows = rows.where(F.col("value") != "")
    null = F.lit(None).cast("string")

    def united(variant: list[str]) -> Column:
        if _fails(variant, required):
            return F.array(F.struct(*[null.alias(n) for n in names], F.col("value").alias(CORRUPT)))
        ddl = ", ".join(f"`{f.name}` string" for f in _strings(variant))
        parsed = F.from_csv("value", ddl, {"columnNameOfCorruptRecord": CORRUPT, **d.options()})
        if variant == names:
            return F.array(parsed)
        held = {*variant, CORRUPT}
        # The lambda's argument is one parsed record, however many columns are taken from it.
        pick = lambda r: F.struct(*[(r[n] if n in held else null).alias(n) for n in [*names, CORRUPT]])
        return F.transform(F.array(parsed), pick)

    by_header = united(variants[0]) if variants else F.array(F.struct(*[null.alias(n) for n in [*names, CORRUPT]]))
    for line, variant in list(zip(lines, variants, strict=True))[1:]:
        by_header = F.when(F.col("_header") == line, united(variant)).otherwise(by_header)
    return rows.select(F.col("file").alias("_file"), F.col("record").alias("_record"), F.inline(by_header))


def drop_blank_keys(rows: DataFrame, e: Entity) -> DataFrame:
    """Leave out rows in which every key column is NULL or blank; malformed rows stay, to be rejected."""
    keys = [k for k in e.key if k in rows.columns]
    if not keys:
        return rows
    filled = F.col(CORRUPT).isNotNull() if CORRUPT in rows.columns else F.lit(False)
    for k in keys:
        filled = filled | (F.length(F.trim(F.coalesce(F.col(k), F.lit("")))) > 0)
    return rows.where(filled)
