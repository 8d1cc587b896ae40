"""Mixing sources to target weights by hierarchical token budgets.

Budgets flow from the root through domains and languages to sources in
proportion to the weights of siblings.  A child that cannot use its share, even
with ``max_epochs`` passes over its documents, leaves the rest to its siblings;
only what a whole subtree cannot use goes to the siblings of its parent.  A leaf
spends its budget on whole epochs, then on a prefix of one more epoch in that
epoch's seeded order.

The prefix is a bound on the order's hash.  It is found from token sums of hash
slices and from the rows of one slice per leaf, so neither a frequent source nor
any text is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketlake.llm.common import materialise
from docketlake.llm.quality import words

LEVELS = ("domain", "lang", "source")
SLICES = 4096
#: Leaves whose budgets are planned at once, in the driver; more are refused.
MOST_LEAVES = 1_000_000


@dataclass(frozen=True)
class Targets:
    """Weights of children among their siblings, by level and name; others get ``tokens ** damping``.

    A name is that of the child alone, or the names from the root joined by "/".
    """

    domain: dict[str, float] = field(default_factory=dict)
    lang: dict[str, float] = field(default_factory=dict)
    source: dict[str, float] = field(default_factory=dict)
    damping: float = 0.7

    def weight(self, path: tuple[str, ...], tokens: float) -> float:
        given = getattr(self, LEVELS[len(path) - 1])
        return given.get("/".join(path), given.get(path[-1], tokens**self.damping))


def spread(budget: float, weights: list[float], room: list[float]) -> list[float]:
    """``budget`` in proportion to ``weights``, nobody above their ``room``; what someone cannot take the others share."""
    out, open_ = [0.0] * len(room), [i for i, w in enumerate(weights) if w > 0 and room[i] > 0]
    while open_ and budget > 1e-9:
        total = sum(weights[i] for i in open_)
        full = [i for i in open_ if out[i] + budget * weights[i] / total >= room[i]]
        if not full:
            for i in open_:
                out[i] += budget * weights[i] / total
            break
        spent = 0.0
        for i in full:
            spent += room[i] - out[i]
            out[i] = room[i]
        budget -= spent
        open_ = [i for i in open_ if i not in set(full)]
    return out


def leaf_budgets(supply: dict[tuple[str, ...], float], budget: float, targets: Targets, max_epochs: int) -> dict[tuple[str, ...], float]:
    """Tokens each leaf may spend."""
    tokens: dict[tuple[str, ...], float] = {}
    for leaf, n in supply.items():
        for depth in range(len(leaf) + 1):
            tokens[leaf[:depth]] = tokens.get(leaf[:depth], 0.0) + n
    children: dict[tuple[str, ...], list[tuple[str, ...]]] = {}
    for path in sorted(tokens):
        if path:
            children.setdefault(path[:-1], []).append(path)
    out, todo = {}, [((), min(budget, tokens.get((), 0.0) * max_epochs))]
    while todo:
        path, own = todo.pop()
        below = children.get(path)
        if not below:
            out[path] = own
            continue
        shares = spread(own, [targets.weight(c, tokens[c]) for c in below], [tokens[c] * max_epochs for c in below])
        todo += zip(below, shares, strict=True)
    out.pop((), None)
    return out


def mix_sources(
    docs: DataFrame,
    domain: Column,
    share: float = 1.0,
    targets: Targets = Targets(),  # noqa: B008
    max_epochs: int = 2,
    seed: int = 1,
    tokens: Column | None = None,
) -> DataFrame:
    """``docs`` (any columns, among them ``doc_id, text, lang, source``) with ``domain, n_tokens, epoch``.

    ``share`` of all tokens is spent; a document appears once for each epoch it
    is part of.  Tokens are words unless ``tokens`` says otherwise.  Null names
    are the name ``""``.  Rows of equal ``doc_id`` are taken or left together;
    documents without tokens cost nothing and come with every whole epoch, and
    with a prefix if their place is inside it.  No rows give no rows; columns of
    the new names are replaced.
    """
    spark = docs.sparkSession
    count = F.size(words(F.coalesce("text", F.lit("")))) if tokens is None else tokens
    own = docs.drop("domain", "n_tokens", "epoch")
    own = own.withColumns({"domain": F.coalesce(domain, F.lit("")), "n_tokens": F.coalesce(count, F.lit(0)).cast("long")})
    names = [F.coalesce(c, F.lit("")).alias(f"_{c}") for c in LEVELS]
    leaves = [f"_{c}" for c in LEVELS]
    narrow = materialise(own.select("doc_id", *names, "n_tokens"))

    found = narrow.groupBy(*leaves).agg(F.sum("n_tokens").alias("n")).limit(MOST_LEAVES + 1).collect()
    if len(found) > MOST_LEAVES:
        raise ValueError(f"more than {MOST_LEAVES} sources; group them by a coarser source column")
    supply = {tuple(r[c] for c in leaves): float(r.n) for r in found}
    budgets = leaf_budgets(supply, share * sum(supply.values()), targets, max_epochs)
    rows = []
    for leaf, n in supply.items():
        whole = min(max_epochs, int((budgets[leaf] + 0.5) // n)) if n else 0
        rows.append((*leaf, whole, max(0, int(budgets[leaf] - whole * n + 0.5)) if whole < max_epochs else 0))
    plan = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in leaves) + ", whole int, rest long")

    order = F.xxhash64(F.lit(seed), "whole", F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    placed = narrow.join(F.broadcast(plan), leaves).where("rest > 0").withColumn("h", order)
    placed = placed.withColumn("slice", F.shiftright("h", 52))
    sums = placed.groupBy(*leaves, "rest", "slice").agg(F.sum("n_tokens").alias("n"))
    along = Window.partitionBy(*leaves).orderBy("slice")
    sums = sums.withColumn("before", F.sum("n").over(along) - F.col("n"))
    edge = sums.where((F.col("before") <= F.col("rest")) & (F.col("before") + F.col("n") > F.col("rest")))
    edge = materialise(edge.select(*leaves, "slice", "before"))
    inside = placed.join(F.broadcast(edge), [*leaves, "slice"])  # one slice for each leaf at most
    running = F.sum("n_tokens").over(Window.partitionBy(*leaves).orderBy("h").rangeBetween(Window.unboundedPreceding, 0))
    inside = inside.withColumn("spent", F.col("before") + running).where("spent <= rest")
    cuts = edge.join(inside.groupBy(*leaves).agg(F.max("h").alias("h")), leaves, "left")
    # Without a row of the edge slice the prefix ends with the slice before; without an edge all fits.
    cuts = cuts.select(*leaves, F.coalesce("h", F.shiftleft(F.col("slice").cast("long"), 52) - 1).alias("cut"))
    plan = materialise(plan.join(F.broadcast(cuts), leaves, "left").withColumn("cut", F.coalesce("cut", F.lit((1 << 63) - 1))))

    out = own.withColumns(dict(zip(leaves, [F.coalesce(c, F.lit("")) for c in LEVELS], strict=True)))
    out = out.join(F.broadcast(plan), leaves)
    last = F.when((F.col("rest") > 0) & (order <= F.col("cut")), 1).otherwise(0)
    times = F.col("whole") + last
    out = out.withColumn("epoch", F.explode(F.when(times > 0, F.sequence(F.lit(0), times - 1)).otherwise(F.array().cast("array<int>"))))
    return out.drop(*leaves, "whole", "rest", "cut")
