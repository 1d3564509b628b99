"""Line deduplication by an exact set-similarity join, in DataFrame functions only.

A line is its set of words. A later line goes if an earlier one, by (doc_id, line number), has a Jaccard
similarity of ``PERCENT`` percent or more with it; lines are judged on the input.

1. Rarity: word counts of the whole corpus in ``BUCKETS`` hash buckets, as 32 levels. Any fixed order of words
   makes prefix filtering exact; this one is close to rarity and of bounded size, so no join is needed.
2. Equal sets collapse to one class with its first line.
3. A class gives one row for each word of its prefix: the n - ceil(t n) + 1 rarest ones. Two similar classes share
   one of these. Rows of a word keep only partners that pass the length, positional and parity filters (a 64-bit
   parity map: its differing bits cannot outnumber the differing words).
4. Round one verifies each class against the first class of its word, so a group of similar lines costs one pair
   each. Round two verifies the classes still there against every earlier partner. Both verify full word sets.
5. A document keeps the lines that are the first of a remaining class, and lines without words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .shared import Staging

PERCENT = 90
BUCKETS = 1 << 16
_SPACES = "[ \\t\\x0B\\f\\r]+"
_LOWEST = -(1 << 63)
_PARITY = "aggregate(c, 0L, (a, x) -> a ^ shiftleft(1L, cast(x & 63 as int)))"


def rarity(docs: DataFrame) -> Column:
    """Levels 0 (rare) to 31 of the hash buckets of words, as a constant array of bounded size."""
    text = F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(" "))
    words = docs.select(F.explode(F.split(_even(text), " ")).alias("w"))
    counts = words.where("w <> ''").groupBy(F.xxhash64("w").bitwiseAND(BUCKETS - 1).cast("int").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    level = F.least(F.lit(31), F.floor(F.log2("n"))).cast("int")
    levels = ["0"] * BUCKETS
    for b, n in counts.select("b", level).collect():  # at most BUCKETS rows
        levels[b] = str(n)
    return F.split(F.lit(",".join(levels)), ",").cast("array<int>")


def _even(text: Column) -> Column:
    """Other white space becomes a space, as cutting at one character is much cheaper than at a pattern."""
    return F.when(text.rlike("[\\t\\x0B\\f\\r]"), F.regexp_replace(text, _SPACES, " ")).otherwise(text)


def has_word(line: Column) -> Column:
    return line.rlike("[^ \\t\\x0B\\f\\r]")


def word_codes(line: Column, levels: Column) -> Column:
    """The distinct words of a line as sorted longs: rarity level, then 58 bits of the word's hash."""
    words = F.array_remove(F.split(_even(line), " "), "")
    code = lambda h: F.shiftleft(
        F.element_at(levels, h.bitwiseAND(BUCKETS - 1).cast("int") + 1).cast("long"), 58
    ) + F.shiftrightunsigned(h, 6)
    return F.sort_array(F.array_distinct(F.transform(words, lambda w: code(F.xxhash64(w)))))


def _classes(docs: DataFrame, levels: Column, percent: int) -> DataFrame:
    """One row per distinct set: first document and line, size, parity map, and prefix (null for sets too small
    to match another one)."""
    lines = docs.select("d", F.posexplode(F.split("text", "\n")).alias("l", "line")).where(has_word(F.col("line")))
    # A filter on the codes would be pushed below them, and so compute them twice.
    lines = lines.select("d", "l", word_codes(F.col("line"), levels).alias("c"))
    n = F.size("c")
    prefix = F.when(100 * n >= percent * (n + 1), F.slice("c", 1, n - F.ceil(n * percent / 100).cast("int") + 1))
    rows = lines.select("d", "l", F.xxhash64("c").alias("s1"), F.hash("c").alias("s2"), n.alias("n"), F.expr(_PARITY).alias("map"), prefix.alias("prefix"))
    return rows.groupBy("s1", "s2", "n", "map", "prefix").agg(F.min(F.struct("d", "l")).alias("first")).select(
        F.col("first.d").alias("d"), F.col("first.l").alias("l"), "n", "map", "prefix"
    )


def _near(x: str, y: str, percent: int) -> str:
    """Length, positional and parity filters between two rows of the same word."""
    # Overlap needed: t (n + m) / (1 + t). Different words at most n + m - 2 overlap.
    need = f"ceil({percent} * ({x}.n + {y}.n) / {100 + percent}D)"
    return (
        f"100 * least({x}.n, {y}.n) >= {percent} * greatest({x}.n, {y}.n)"
        f" and 1 + least({x}.n - {x}.pos, {y}.n - {y}.pos) >= {need}"
        f" and bit_count({x}.map ^ {y}.map) <= {x}.n + {y}.n - 2 * {need}"
    )


def _earlier(x: str, y: str) -> str:
    return f"({x}.d < {y}.d or ({x}.d = {y}.d and {x}.l < {y}.l))"


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The later lines (d, l) of pairs that are similar on their full sets."""
    one = sets.select(F.col("d").alias("d1"), F.col("l").alias("l1"), F.col("c").alias("c1"))
    two = sets.select(F.col("d").alias("d2"), F.col("l").alias("l2"), F.col("c").alias("c2"))
    both = F.size(F.array_intersect("c1", "c2"))
    return (
        pairs.join(one, ["d1", "l1"]).join(two, ["d2", "l2"])
        .where(100 * both >= percent * (F.size("c1") + F.size("c2") - both))
        .select(F.col("d2").alias("d"), F.col("l2").alias("l")).distinct()
    )


def dedup_lines(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``docs`` with ``text`` cut to the kept lines, plus n_lines and n_removed.

    Words are parts between white space, unchanged. Lines without words stay. A null text stays null with
    no lines; an empty text has one line. Rows that share a doc_id have the same place in the order, so the lines of
    equal rows do not remove each other; a null id comes first. Other columns pass through; columns called like
    the added ones are replaced.
    """
    others = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c not in ("n_lines", "n_removed", "text"))).alias("_row")
    place = F.coalesce(F.col("doc_id").cast("long"), F.lit(_LOWEST))
    rows = docs.select(place.alias("d"), F.coalesce("text", F.lit("")).alias("text"))
    levels = rarity(docs)
    stage = Staging(docs.sparkSession)
    classes = stage.table(_classes(rows, levels, percent), "line-classes")
    prefixes = classes.where("prefix is not null").select("d", "l", "n", "map", F.posexplode("prefix").alias("pos", "w"))
    prefixes = prefixes.select("w", "d", "l", "n", "map", "pos")
    x, y = prefixes.alias("x"), prefixes.alias("y")
    other = "(x.d <> y.d or x.l <> y.l)"
    met = stage.table(x.join(y, F.expr(f"x.w = y.w and {other} and {_near('x', 'y', percent)}"), "left_semi"), "line-prefixes")
    needed = met.select("d", "l").distinct().groupBy("d").agg(F.collect_set("l").alias("ls"))
    found = rows.join(needed, "d").select("d", F.split("text", "\n").alias("lines"), F.explode("ls").alias("l"))
    sets = found.select("d", "l", word_codes(F.element_at("lines", F.col("l") + 1), levels).alias("c"))
    # Two rows that share an id may hold different lines at one place: only the class's own line counts.
    own = classes.where("prefix is not null").select("d", "l", "n", "map")
    sets = stage.table(sets.withColumns({"n": F.size("c"), "map": F.expr(_PARITY)}).join(own, ["d", "l", "n", "map"], "left_semi").select("d", "l", "c").distinct(), "line-sets")
    first = met.groupBy("w").agg(F.min(F.struct("d", "l", "n", "map", "pos")).alias("f")).select("w", "f.*")
    a, b = first.alias("a"), met.alias("b")
    ids = [F.col(f"{t}.{c}").alias(f"{c}{i}") for t, i in (("a", 1), ("b", 2)) for c in ("d", "l")]
    star = a.join(b, F.expr(f"a.w = b.w and {_earlier('a', 'b')} and {_near('a', 'b', percent)}")).select(*ids).distinct()
    star = stage.table(star, "line-star")
    gone = stage.table(_verified(star, sets, percent), "line-gone")
    left = met.join(gone, ["d", "l"], "left_anti").select(*met.columns)
    a, b = met.alias("a"), left.alias("b")
    rest = a.join(b, F.expr(f"a.w = b.w and {_earlier('a', 'b')} and {_near('a', 'b', percent)}")).select(*ids).distinct()
    rest = _verified(rest.join(star, ["d1", "l1", "d2", "l2"], "left_anti"), sets, percent)
    gone = gone.unionByName(stage.table(rest, "line-gone-later"))
    stage.drop("line-prefixes", "line-sets", "line-star")
    keep = classes.select("d", "l").join(gone, ["d", "l"], "left_anti").groupBy("d").agg(F.collect_set("l").alias("keep"))
    joined = docs.select(others, "text", F.split("text", "\n").alias("_parts"), place.alias("_d"))
    joined = joined.join(keep.withColumnRenamed("d", "_d"), "_d", "left")
    bare = F.filter(F.transform("_parts", lambda line, i: F.when(~has_word(line), i)), lambda i: i.isNotNull())
    # Places of kept lines by a hash of the row, then one look-up each: linear in the lines of a document.
    stay = F.array_sort(F.array_union(F.coalesce("keep", F.array().cast("array<int>")), bare))
    joined = joined.withColumn("_stay", stay)
    kept = F.array_join(F.transform("_stay", lambda i: F.get("_parts", i)), "\n")
    return joined.select(
        "_row.*", F.when(F.col("text").isNotNull(), kept).alias("text"),
        F.when(F.col("text").isNull(), 0).otherwise(F.size("_parts")).cast("long").alias("n_lines"),
        F.when(F.col("text").isNull(), 0).otherwise(F.size("_parts") - F.size("_stay")).cast("long").alias("n_removed"),
    )
