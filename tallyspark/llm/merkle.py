"""Merkle manifest of a table: one tree per group of rows, and one tree over the groups' roots.

Rows are leaves. A leaf is the digest of its columns; within a group leaves stand in the order of a key. Every ``arity``
consecutive nodes of a level become the digest of their digests, until one node, the group's root, remains. The groups'
roots, ordered by group, are the leaves of the upper tree.

Each level is one sibling-shift self-join: a node computes the places of the slots of its run and meets the nodes that
stand there by an equality join; rows in slot zero then emit the run's parent. The join makes ``arity`` rows a node
whatever a group's size, so a group that holds most rows is dealt out like any other. Levels are written tables.

Places come from a range partitioning by (group, key, leaf): a row's place is the count of its group's rows in earlier
ranges, a table of one row per range and group, plus its place in its own range. No group is sorted or counted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .shared import Staging, partitions

ARITY = 8
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def digest(*columns: Column) -> Column:
    """Hex sha256 of columns one after another: each its UTF-8 byte count, ``:`` and its text; ``-`` if null."""
    parts = []
    for column in columns:
        text = column.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def lower_ascii(text: Column) -> Column:
    """A-Z lowered, all else unchanged; null stays null."""
    return F.translate(text, _UPPER, _UPPER.lower())


def group_key(column: Column) -> Column:
    """A group's name as a non-null string that sorts bytewise, null first."""
    return F.coalesce(F.concat(F.lit("v"), column.cast("string")), F.lit("n"))


def numbered(rows: DataFrame, order: list[str], staging: Staging, name: str) -> DataFrame:
    """``rows`` (with a group ``g``) and the place ``i`` of each in its group by ``order``, and the group's count ``n``."""
    ranged = rows.repartitionByRange(partitions(rows.sparkSession), "g", *order).sortWithinPartitions("g", *order)
    at = F.monotonically_increasing_id()  # the partition in the upper bits, the place in it in the lower 33
    ranged = staging.table(ranged.withColumn("at", at).withColumn("part", F.shiftright("at", 33)), f"{name}-ranged")
    counts = ranged.groupBy("g", "part").agg(F.count(F.lit(1)).alias("held"), F.min("at").alias("first"))
    group = Window.partitionBy("g")
    before = F.sum("held").over(group.orderBy("part")) - F.col("held")
    counts = counts.select("g", "part", "first", before.alias("before"), F.sum("held").over(group).alias("n"))
    return ranged.join(counts, ["g", "part"]).withColumn("i", F.expr("before + at - first")).drop("at", "part", "first", "before")


def climb(nodes: DataFrame, arity: int, staging: Staging, name: str) -> tuple[list[DataFrame], DataFrame]:
    """All levels above ``nodes`` (g, i, n, h), and the roots (g, height, h).

    A level holds, for each node of groups of two nodes or more, the digests left and right of it in its run.
    """
    levels, roots, height = [], [], 0
    while True:
        roots.append(nodes.where("n = 1").select("g", F.lit(height).alias("height"), "h"))
        largest = nodes.agg(F.max("n")).first()[0]
        if largest is None or largest == 1:
            break
        open_ = nodes.where("n > 1")
        places = F.explode(F.expr(f"sequence(i - i % {arity}, least(i - i % {arity} + {arity - 1}, n - 1))"))
        shifted = open_.select("g", "i", "n", places.alias("j"))
        met = shifted.join(open_.select("g", F.col("i").alias("j"), "h"), ["g", "j"])
        run = met.groupBy("g", "i", "n").agg(F.sort_array(F.collect_list(F.struct("j", "h"))).alias("run"))
        joined = "aggregate(filter(run, x -> x.j {} i), cast('' as binary), (all, x) -> concat(all, x.h))"
        level = run.select(
            "g", "i", "n", F.expr(joined.format("<")).alias("left"), F.expr(joined.format(">")).alias("right"),
            F.expr(f"if(i % {arity} = 0, unhex(sha2(array_join(transform(run, x -> lower(hex(x.h))), ''), 256)), null)").alias("parent"),
        )
        level = staging.table(level, f"{name}-{height}")
        levels.append(level)
        height += 1
        nodes = level.where(f"i % {arity} = 0").select(
            "g", F.expr(f"i div {arity}").alias("i"), F.expr(f"(n + {arity - 1}) div {arity}").alias("n"), F.col("parent").alias("h")
        )
    every = roots[0]
    for more in roots[1:]:
        every = every.unionByName(more)
    return levels, every


def descend(levels: list[DataFrame], roots: DataFrame, arity: int) -> DataFrame:
    """(g, i, path and what ``roots`` carries) of the lowest nodes: the digests left and right on the way up.

    ``roots`` has g, height, path (what follows above a root) and columns that every node of the group gets.
    """
    carried = [c for c in roots.columns if c not in ("g", "height", "path")]
    top = len(levels)
    paths = roots.where(F.col("height") == top).select("g", F.lit(0).cast("long").alias("i"), "path", *carried)
    for height in range(top - 1, -1, -1):
        above = paths.withColumnRenamed("i", "up").withColumnRenamed("path", "rest")
        own = levels[height].select("g", "i", F.expr(f"i div {arity}").alias("up"), F.struct("left", "right").alias("step"))
        below = own.join(above, ["g", "up"]).select("g", "i", F.concat(F.array("step"), "rest").alias("path"), *carried)
        ends = roots.where(F.col("height") == height).select("g", F.lit(0).cast("long").alias("i"), "path", *carried)
        paths = below.unionByName(ends)
    return paths


#: A leaf's digest folded with its path.
_FOLD = (
    "lower(hex(aggregate(path, {}, (own, x) -> unhex(sha2(concat(lower(hex(x.left)), lower(hex(own)), lower(hex(x.right))), 256)))))"
)
_NO_PATH = "cast(array() as array<struct<left:binary,right:binary>>)"


def manifest(leaves: DataFrame, order: list[str], arity: int = ARITY) -> DataFrame:
    """The tree over ``leaves`` (g, h, and ``order`` and other columns): all its columns, subroot, root and path.

    ``g`` is the group (see ``group_key``), ``h`` a leaf's digest as binary. Rows that tie in ``order`` stand by ``h``; equal
    rows are leaves of their own. ``path`` holds, level by level from the leaf to the root, the digests left and right of
    the node in its run (empty where the run has no other). One lone leaf is its own root; no leaf gives no row.
    """
    staging = Staging(leaves.sparkSession)
    hashed = staging.table(leaves, "merkle-hashed")  # a range partitioning reads its input twice
    rows = staging.table(numbered(hashed, [*order, "h"], staging, "merkle-leaves"), "merkle-leaves")
    staging.drop("merkle-hashed", "merkle-leaves-ranged")
    levels, subroots = climb(rows.select("g", "i", "n", "h"), arity, staging, "merkle-level")
    subroots = staging.table(subroots.select(F.lit("").alias("g"), F.col("g").alias("name"), "height", "h"), "merkle-subroots")
    upper = staging.table(numbered(subroots, ["name"], staging, "merkle-upper"), "merkle-upper")
    staging.drop("merkle-upper-ranged")
    upper_levels, root = climb(upper.select("g", "i", "n", "h"), arity, staging, "merkle-root")
    root = root.select("g", "height", F.expr(_NO_PATH).alias("path"), F.col("h").alias("root"))
    above = descend(upper_levels, root, arity)
    tops = upper.join(above, ["g", "i"]).select(F.col("name").alias("g"), "height", "path", F.col("h").alias("subroot"), "root")
    tops = staging.table(tops, "merkle-tops")
    return rows.join(descend(levels, tops, arity), ["g", "i"])


def document_manifest(docs: DataFrame, arity: int = ARITY) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified for each row of documents, a tree per lang.

    A leaf is the digest of doc_id, source, lang, n_chars and text. Leaves of a lang ascend by doc_id (null first), then
    by digest. Where 3 divides the crc32 of the decimal doc_id (null: of the empty text) the text is tampered with: its
    A-Z are lowered; ``folded_root`` is the root recomputed from the tampered leaf, otherwise from the leaf, with the
    original siblings, and ``verified`` tells whether it is the root. So a tampered row without A-Z, or without text,
    still verifies. Null columns have their own mark, an empty text is ``0:``; a text is hashed whole, whatever its
    length. Repeated rows are leaves of their own. Extra columns are not read; an empty table gives an empty result.
    """
    columns = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    text = F.col("text")
    chosen = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 3 == 0
    tampered = F.when(chosen, F.unhex(digest(*columns, lower_ascii(text))))
    leaves = docs.select(
        group_key(F.col("lang")).alias("g"), F.col("doc_id").cast("long").alias("doc_id"),
        F.unhex(digest(*columns, text)).alias("h"), tampered.alias("tampered"),
    )
    tree = manifest(leaves, ["doc_id"], arity)
    hexed = {c: F.lower(F.hex(c)) for c in ("subroot", "root")}
    proof = F.expr("sha2(array_join(transform(path, x -> lower(hex(concat(x.left, x.right)))), ''), 256)")
    out = tree.select(
        "doc_id", F.lower(F.hex("h")).alias("leaf"), hexed["subroot"].alias("subroot"), hexed["root"].alias("root"),
        proof.alias("proof_sha256"), F.expr(_FOLD.format("coalesce(tampered, h)")).alias("folded_root"),
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
