"""Citation networks: nodes and edges within a number of hops, by breadth-first levels of all seeds at once."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketlake.operators.reach import distances
from docketlake.session import stored

CITING, CITED = "citing_opinion_id", "cited_opinion_id"


#: Words of a packed row, and links into a node that one task unites.
CHUNK_WORDS = 1024
HUB_LINKS = 1_000_000
FEW_BITS = 3  # fixed value: up to so many bits are kept as places, which take less room than a word


def numbered(seeds: DataFrame) -> DataFrame:
    """``seed_id, word, bit``: each distinct seed's place in bitmaps of 64 bits, in the order of their ids."""
    ids = seeds.select(F.col(seeds.columns[0]).cast("bigint").alias("seed_id")).where("seed_id is not null").distinct()
    at = F.monotonically_increasing_id()
    ids = ids.orderBy("seed_id")
    return stored(ids.select("seed_id", F.shiftright(at, 6).alias("word"), at.bitwiseAND(63).cast("int").alias("bit")), "seeds")


def _packed(level: DataFrame) -> DataFrame:
    """A row per node and ``CHUNK_WORDS`` words: places of bits of sparse words, and the other words with their masks."""
    item = F.struct((F.col("word") % CHUNK_WORDS).cast("int").alias("word"), "mask")
    chunk = F.floor(F.col("word") / CHUNK_WORDS).alias("chunk")
    rows = level.repartition("node").groupBy("node", chunk).agg(F.collect_list(item).alias("items"))
    without = lambda m: m.bitwiseAND(m - 1)
    lowest = lambda m: F.bit_count(F.bitwise_not(m).bitwiseAND(m - 1))

    def places(x: Column) -> Column:
        first = x["mask"]
        rest = F.array(first, without(first), without(without(first)))
        return F.transform(F.filter(rest, lambda m: m > 0), lambda m: (x["word"] * 64 + lowest(m) - 32768).cast("smallint"))

    # A mask with the last bit set is negative, and no number to subtract from.
    sparse = lambda x: (x["mask"] > 0) & (F.bit_count(x["mask"]) <= FEW_BITS)
    few = F.flatten(F.transform(F.filter("items", sparse), places))
    dense = F.filter("items", lambda x: ~sparse(x))
    some = lambda a: F.when(F.size(a) > 0, a)
    return rows.select(
        "node",
        "chunk",
        some(few).alias("few"),
        some(F.transform(dense, lambda x: x["word"].cast("smallint"))).alias("words"),
        some(F.transform(dense, lambda x: x["mask"])).alias("masks"),
    )


def _unpacked(rows: DataFrame) -> DataFrame:
    """The packed rows as ``word, mask``, beside their other columns."""
    none = F.array().cast("array<int>")
    few = F.coalesce(F.col("few").cast("array<int>"), none)
    # Numbers behind those of places are indexes of dense words; no lambda runs per word.
    dense = F.when(F.size("words") > 0, F.sequence(F.lit(32768), F.size("words") + 32767)).otherwise(none)
    others = [c for c in rows.columns if c not in ("chunk", "few", "words", "masks")]
    rows = rows.select(*others, "chunk", "words", "masks", F.explode(F.concat(few, dense)).alias("_at"))
    place, index, is_place = F.col("_at") + 32768, F.col("_at") - 32768, F.col("_at") < 32768
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), place.bitwiseAND(63))
    word = F.when(is_place, F.shiftright(place, 6)).otherwise(F.get("words", index))
    mask = F.when(is_place, bit).otherwise(F.get("masks", index))
    return rows.select(*others, (F.col("chunk") * CHUNK_WORDS + word).alias("word"), mask.alias("mask"))


def _links(citations: DataFrame) -> tuple[DataFrame, bool]:
    """``node, next, part`` both ways, and whether any node has more links than one task should unite, told apart by ``part``."""
    ends = citations.where(F.col(CITING) != F.col(CITED)).select(CITING, CITED)
    ends = stored(ends.distinct(), "links")
    links = ends.select(F.col(CITING).alias("node"), F.col(CITED).alias("next")).unionByName(
        ends.select(F.col(CITED).alias("node"), F.col(CITING).alias("next"))
    )
    hubs = links.groupBy("next").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > HUB_LINKS)
    hubs = stored(hubs, "hubs")
    if hubs.isEmpty():
        return links.withColumn("part", F.lit(0).cast("bigint")), False
    part = F.pmod(F.xxhash64("node"), F.ceil(F.col("_n") / HUB_LINKS))
    return links.join(hubs, "next", "left").select("node", "next", F.coalesce(part, F.lit(0)).alias("part")), True


def seed_masks(citations: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """Rows ``node, word, depth, mask``: the seeds of a word, as bits, that reach a node in so many undirected hops.

    All seeds are searched at once.  A level has a row per node and word, not per node
    and seed, so seeds with the same surroundings share the work.  What goes over a link
    is one packed row for up to 65,536 seeds, and it is unpacked behind the shuffle, where
    the bits that reach a node are united.  Neighbours of level d lie on
    levels d-1, d and d+1, so bits of a new level are only checked against the two
    before it, which take part in the same union.  Links and levels are written to the
    shared folder: plans stay short and survive lost executors.
    """
    bit = F.expr("shiftleft(1L, bit)")
    frontier = seeds.groupBy(F.col("seed_id").alias("node"), "word").agg(F.bit_or(bit).alias("mask"))
    levels = frontier.select("node", "word", F.lit(0).alias("depth"), "mask")
    if depth < 1:
        return levels
    links, hubs = _links(citations)
    before: DataFrame | None = None
    for hop in range(1, depth + 1):
        packed = stored(_packed(frontier), "packed")
        columns = [F.col(c) for c in ("chunk", "few", "words", "masks")]
        found = packed.join(links, "node").select(F.col("next").alias("node"), "part", *columns, F.lit(False).alias("old"))
        known = packed if before is None else packed.unionByName(before)
        known = known.select("node", F.lit(0).cast("bigint").alias("part"), *columns, F.lit(True).alias("old"))
        rows = _unpacked(found.unionByName(known).repartition("node", "part"))
        new, old = F.bit_or(F.when(~F.col("old"), F.col("mask"))), F.bit_or(F.when(F.col("old"), F.col("mask")))
        united = rows.groupBy("node", "part", "word").agg(new.alias("mask"), old.alias("seen"))
        if hubs:
            united = united.groupBy("node", "word").agg(F.bit_or("mask").alias("mask"), F.bit_or("seen").alias("seen"))
        fresh = F.col("mask").bitwiseAND(F.bitwise_not(F.coalesce("seen", F.lit(0).cast("bigint"))))
        level = united.select("node", "word", fresh.alias("mask")).where("mask <> 0")
        level = stored(level, "level")
        if level.isEmpty():
            break
        levels = levels.unionByName(level.withColumn("depth", F.lit(hop)))
        before, frontier = packed, level
    return levels


def by_seed(masks: DataFrame, seeds: DataFrame) -> DataFrame:
    """The rows of ``masks`` once per seed in their bitmap, with ``seed_id`` for ``word`` and ``mask``."""
    bits = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.getbit("mask", i) == 1)
    return masks.withColumn("bit", F.explode(bits)).join(seeds, ["word", "bit"]).drop("word", "bit", "mask")


def reachable(citations: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """Opinions within ``depth`` undirected hops of each seed, with the hop count."""
    return distances(citations, seeds, depth).select("seed_id", "node", "depth")


class Network:
    """``nodes(seed_id, node, depth)``, ``edges(seed_id, citing, cited, depth, quoted)`` and all that is ``visited``.

    Each is searched for when it is asked for: nodes and edges by bitmaps, which seeds share
    over every edge, and the rows of ``visited`` by lists of ids.
    """

    def __init__(self, citations: DataFrame, seeds: DataFrame, depth: int, opinions: DataFrame | None):
        self.citations, self.seeds, self.depth, self.opinions = citations, seeds, depth, opinions

    @cached_property
    def places(self) -> DataFrame:
        return numbered(self.seeds)

    @cached_property
    def masks(self) -> DataFrame:
        return seed_masks(self.citations, self.places, self.depth)

    @cached_property
    def visited(self) -> DataFrame:
        return reachable(self.citations, self.seeds, self.depth)

    @cached_property
    def nodes(self) -> DataFrame:
        if self.opinions is None:
            return self.visited
        kept = self.masks.join(self.opinions.select(F.col("id").alias("node")), "node", "left_semi")
        return by_seed(kept, self.places).select("seed_id", "node", "depth")

    @cached_property
    def edges(self) -> DataFrame:
        members = self.masks.groupBy("node", "word").agg(F.bit_or("mask").alias("mask"))
        columns = [CITING, CITED, "depth", "quoted"]
        touching = [
            self.citations.select(*columns).join(members, F.col(end) == F.col("node")).select("word", "mask", *columns)
            for end in (CITING, CITED)
        ]
        edges = (
            touching[0]
            .unionByName(touching[1])
            .groupBy("word", CITING, CITED)
            .agg(F.bit_or("mask").alias("mask"), F.max("depth").alias("depth"), F.bool_or("quoted").alias("quoted"))
        )
        return by_seed(edges, self.places).select("seed_id", *columns)


def citation_network(
    citations: DataFrame, seeds: DataFrame, depth: int = 1, opinions: DataFrame | None = None
) -> Network:
    """Network around each seed.

    Opinions that are not in the table are walked through but not listed as
    nodes.  Edges are all citations that touch a visited opinion, once each.
    """
    return Network(citations, seeds, depth, opinions)
