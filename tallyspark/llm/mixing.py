"""Mixing sources to target weights by budgets that flow down a domain - language - source tree.

Every leaf has a capacity: its tokens times the epochs allowed. Capacities add up to the root, which
gets the smaller of the asked budget and its capacity. A node divides its budget among its children in
proportion to their weights; a child that cannot hold its share keeps its capacity, and the rest goes
to its siblings. What the siblings cannot hold either already shows in their parent's capacity, so it
goes to the parent's siblings one level up: siblings come before ancestors. All of it is exact integer
arithmetic. Each leaf then takes whole epochs and, of the last epoch's seeded order, the token prefix
that its budget covers.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .shared import Staging

LEVELS = ("domain", "language", "leaf_source")
MAX_EPOCHS = 4
SEED = 17
#: 65,536 ranges of the seeded order per leaf: the running sum goes over ranges, then within the cut's range.
RANGE_HEX = 4
#: Leaves are sent to every task up to this many, after counting; more are joined by a shuffle.
BROADCAST_LEAVES = 1 << 16


def n_words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; null has none."""
    plain = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), "[ \\t\\n\\x0B\\f\\r]+", " "))
    return F.when(plain == "", F.lit(0)).otherwise(F.size(F.split(plain, " "))).cast("long")


def weight_of(name: Column, weights: Mapping[str, int], default: int) -> Column:
    out = F.lit(default)
    for key, value in weights.items():
        out = F.when(name == key, F.lit(value)).otherwise(out)
    return out.cast("decimal(38,0)")


def _divide(nodes: DataFrame, parent: Sequence[str], order: str) -> DataFrame:
    """Add ``budget`` to children (weight, capacity, parent_budget) so that shortages go to siblings.

    Children in rising capacity / weight: the first ones are filled as long as their capacity is below
    their share of what is left; from the first one that is not, all share the rest by weight.
    """
    by = Window.partitionBy(*parent).orderBy(F.col("_fill"), order)
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    dec = "decimal(38,0)"
    nodes = nodes.withColumn("_fill", F.expr("capacity * cast(1000000 as decimal(38,0)) div weight").cast(dec))
    nodes = nodes.withColumns({
        "_left": (F.col("parent_budget") - F.coalesce(F.sum("capacity").over(before), F.lit(0))).cast(dec),
        "_weights": F.sum("weight").over(by.rowsBetween(0, Window.unboundedFollowing)).cast(dec),
    })
    full = (F.col("capacity") * F.col("_weights") <= F.col("_left") * F.col("weight")).cast("int")
    nodes = nodes.withColumn("_full", F.min(full).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    everyone = Window.partitionBy(*parent)
    first = F.max(F.when(F.col("_full") == 0, F.struct(F.col("_weights").alias("w"), F.col("_left").alias("l")))).over(everyone)
    nodes = nodes.withColumn("_first", first)
    share = F.expr("_first.l * weight div _first.w").cast("long")
    return nodes.withColumn(
        "budget", F.when(F.col("_full") == 1, F.col("capacity").cast("long")).otherwise(F.least(share, F.col("capacity").cast("long")))
    ).drop("_fill", "_left", "_weights", "_full", "_first")


def leaf_budgets(
    leaves: DataFrame, budget: Column, domain_weights: Mapping[str, int], language_weights: Mapping[str, int],
    source_weights: Mapping[str, int], default: int = 1, max_epochs: int = MAX_EPOCHS,
) -> DataFrame:
    """Budgets of leaves (domain, language, leaf_source, tokens); ``budget`` may use the total ``_tokens``."""
    dec = "decimal(38,0)"
    leaves = leaves.withColumn("capacity", (F.col("tokens") * max_epochs).cast(dec))
    weights = (domain_weights, language_weights, source_weights)
    root = leaves.agg(F.sum("tokens").alias("_tokens"), F.sum("capacity").alias("_capacity")).select(
        F.least(budget.cast(dec), F.col("_capacity")).alias("parent_budget"), F.lit(0).alias("_root")
    )
    given, above = root, ["_root"]
    for depth, level in enumerate(LEVELS):
        keys = list(LEVELS[: depth + 1])
        nodes = leaves.groupBy(*keys).agg(F.sum("capacity").cast(dec).alias("capacity"), F.sum("tokens").alias("tokens"))
        nodes = nodes.withColumns({"_root": F.lit(0), "weight": weight_of(F.col(level), weights[depth], default)})
        nodes = _divide(nodes.join(given, above), above, level)
        given, above = nodes.select(*keys, F.col("budget").cast(dec).alias("parent_budget")), keys
    return nodes.select(*LEVELS, "tokens", "weight", "budget")


def mix_sources(
    docs: DataFrame, domain: Column, budget: Column, domain_weights: Mapping[str, int] | None = None,
    language_weights: Mapping[str, int] | None = None, source_weights: Mapping[str, int] | None = None,
    max_epochs: int = MAX_EPOCHS, seed: int = SEED,
) -> DataFrame:
    """All columns of ``docs`` plus domain, language, leaf_source, mix_tokens, leaf_budget and epoch.

    One row for each epoch in which a document is taken. ``budget`` is a column over the total
    ``_tokens``. A null language or source is the leaf ``?``. In an epoch the order is the md5 of
    (seed, epoch, doc_id); rows with equal ids are peers and are taken together. A text without words
    has no tokens and is taken wherever the prefix reaches it; a text of any length is taken whole or not.
    An empty table gives an empty one. Columns of ``docs`` called like the added ones are replaced.

    Texts are never shuffled. Tokens are summed per range of the seeded order (65,536 ranges a leaf), the running sum goes
    over ranges, and only the keys in the one range at the cut are ordered; that gives the last key taken of each leaf, and
    every row is then compared with its leaf's.
    """
    added = {*LEVELS, "mix_tokens", "leaf_budget", "epoch"}
    stage = Staging(docs.sparkSession)
    leaf = {
        "domain": F.coalesce(domain, F.lit("?")), "language": F.coalesce(F.col("lang"), F.lit("?")),
        "leaf_source": F.coalesce(F.col("source"), F.lit("?")), "mix_tokens": n_words(F.col("text")),
        "id": F.coalesce(F.col("doc_id").cast("string"), F.lit("?")),
    }
    rows = stage.table(docs.select(*(column.alias(name) for name, column in leaf.items())), "mix-rows")
    leaves = rows.groupBy(*LEVELS).agg(F.sum("mix_tokens").alias("tokens"))
    budgets = leaf_budgets(leaves, budget, domain_weights or {}, language_weights or {}, source_weights or {}, 1, max_epochs)
    plan = stage.table(budgets.select(
        *LEVELS, F.col("budget").alias("leaf_budget"),
        F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(0).alias("whole"),
        F.when(F.col("tokens") > 0, F.expr("budget % tokens")).otherwise(0).alias("part"),
    ), "mix-plan")
    few = plan.count() <= BROADCAST_LEAVES

    def with_leaf(rows: DataFrame, leaves: DataFrame) -> DataFrame:
        return rows.join(F.broadcast(leaves) if few else leaves, list(LEVELS))

    # The order of the last, partly taken epoch.
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), (F.col("whole") + 1).cast("string"), F.col("id")))
    placed = with_leaf(rows, plan).where("part > 0").withColumn("key", key).withColumn("range", F.substring("key", 1, RANGE_HEX))
    sums = placed.groupBy(*LEVELS, "range", "part").agg(F.sum("mix_tokens").alias("tokens"))
    before = Window.partitionBy(*LEVELS).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("ahead", F.coalesce(F.sum("tokens").over(before), F.lit(0)))
    # Of each leaf: the one range that the cut falls into, and the tokens before it.
    cut = sums.where("ahead + tokens > part and ahead <= part").groupBy(*LEVELS).agg(F.min(F.struct("range", "ahead")).alias("cut"))
    cut = stage.table(cut.select(*LEVELS, F.col("cut.range").alias("range"), F.col("cut.ahead").alias("ahead")), "mix-cut")
    near = with_leaf(placed, cut.withColumnRenamed("range", "cut_range")).where("range = cut_range")
    peers = Window.partitionBy(*LEVELS).orderBy("key")
    near = near.withColumn("upto", F.col("ahead") + F.sum("mix_tokens").over(peers)).where("upto <= part")
    taken = near.groupBy(*LEVELS).agg(F.max("key").alias("last_key"))
    # Keys of earlier ranges are below the bare range, those of the cut's own range above it.
    limits = plan.join(cut, list(LEVELS), "left").join(taken, list(LEVELS), "left").select(
        *LEVELS, "leaf_budget", "whole", "part", F.coalesce("last_key", "range").alias("last_key")
    )
    limits = stage.table(limits, "mix-limits")
    own = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c not in added)).alias("_row")
    out = with_leaf(docs.select(own, *(column.alias(name) for name, column in leaf.items())), limits)
    last = F.col("whole") + F.when((F.col("part") > 0) & (key <= F.col("last_key")), 1).otherwise(0)
    return _epochs(out, last)


def _epochs(rows: DataFrame, last: Column) -> DataFrame:
    """A row for each epoch up to the last one that takes the document."""
    return rows.withColumn("last", last).where("last > 0").withColumn(
        "epoch", F.explode(F.sequence(F.lit(1).cast("long"), F.col("last").cast("long")))
    ).select("_row.*", *LEVELS, "mix_tokens", "leaf_budget", "epoch")
