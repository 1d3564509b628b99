"""Multi-label categories."""

from __future__ import annotations

import functools
import operator
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import fixed
from ..functions.fixed import literal_map


def _strings(*values: str) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def label_set(*parts: Column) -> Column:
    """Sorted distinct union of label arrays."""
    return F.array_sort(F.array_distinct(F.concat(*parts)))


def _item_labels(name: Column) -> Column:
    lowered = F.lower(name)
    chosen = None
    for words, labels in fixed.ITEM_RULES:
        hit = F.lit(False)
        for word in words:
            hit = hit | lowered.contains(word)
        chosen = F.when(hit, _strings(*labels)) if chosen is None else chosen.when(hit, _strings(*labels))
    return chosen.otherwise(_strings())


def name_rules(name: Column) -> Column:
    """The bit of the first rule that matches an item's name; 0 where none does."""
    lowered, chosen = F.lower(name), F.lit(0)
    for bit, (words, _) in reversed(list(enumerate(fixed.ITEM_RULES))):
        hit = functools.reduce(operator.or_, [lowered.contains(word) for word in words])
        chosen = F.when(hit, F.lit(1 << bit)).otherwise(chosen)
    return chosen


def _rule_labels(bits: Column) -> Column:
    return F.concat(*[
        F.when(bits.bitwiseAND(F.lit(1 << bit)) != 0, _strings(*labels)).otherwise(_strings())
        for bit, (_, labels) in enumerate(fixed.ITEM_RULES)
    ])


def assign_labels(txn: DataFrame, names: str | Column = "item_names", rules: str | None = None) -> DataFrame:
    """Add ``categories``: the major category, its related labels, and labels from item names.

    ``names`` is an array of item names (repeats do not matter). Per name the first matching rule
    decides. A single label is padded with its first related one. ``rules`` names a column that holds the bits of all item
    names (``name_rules``), in place of the names.
    """
    related = literal_map(fixed.RELATED)[F.col("major_category")]
    if rules is None:
        from_names = F.flatten(F.transform(F.array_distinct(names), _item_labels))
    else:
        from_names = _rule_labels(F.col(rules))
    labels = label_set(F.array("major_category"), F.coalesce(related, _strings()), from_names)
    fallback = F.coalesce(F.get(literal_map(fixed.RELATED)[F.get("categories", F.lit(0))], F.lit(0)),
                          F.lit("Miscellaneous"))
    return txn.withColumn("categories", labels).withColumn(
        "categories",
        F.when(F.size("categories") < 2, label_set(F.col("categories"), F.array(fallback))).otherwise(
            F.col("categories")
        ),
    )


def extra_labels(txn: DataFrame) -> DataFrame:
    """Add ``categories`` from ``major_category`` and ``subcategory``; at least the category."""
    base = F.coalesce(literal_map(fixed.CATEGORY_LABELS)[F.col("major_category")], F.array("major_category"))
    extra = F.coalesce(literal_map(fixed.SUBCATEGORY_LABELS)[F.col("subcategory")], _strings())
    labels = label_set(base, extra)
    return txn.withColumn(
        "categories",
        F.when(F.size(labels) < 2, label_set(labels, F.array("major_category"))).otherwise(labels),
    )


def text_set(txn: DataFrame, weight: float = 0.5) -> DataFrame:
    """Columns of the categorisation set; labels as a JSON list."""
    return txn.select(
        "description",
        F.to_json("categories").alias("categories"),
        "amount",
        *[c for c in ("persona_id", "period", "split") if c in txn.columns],
        F.lit("USD").alias("currency"),
        F.lit("US").alias("country"),
        F.lit(float(weight)).alias("sample_weight"),
    )


def parse_labels(df: DataFrame, column: str = "categories") -> DataFrame:
    """JSON label list back to an array."""
    return df.withColumn(column, F.from_json(column, "array<string>"))


def label_counts(df: DataFrame, column: str = "categories") -> DataFrame:
    """Rows per label."""
    return df.select(F.explode(column).alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def label_universe(df: DataFrame, column: str = "categories") -> DataFrame:
    """One row: sorted distinct labels. One entry per label of the label list, not per row."""
    labels = df.select(F.explode(column).alias("label")).distinct()
    return labels.agg(F.array_sort(F.collect_list("label")).alias("classes"))


def binarise(df: DataFrame, classes: Sequence[str] | Column, column: str = "categories") -> DataFrame:
    """Add ``target``: 0/1 per class in class order. ``classes`` may be a scalar subquery."""
    wanted = classes if isinstance(classes, Column) else _strings(*classes)
    return (
        df.withColumn("_classes", wanted)
        .withColumn("target", F.transform("_classes", lambda c: F.array_contains(column, c).cast("int")))
        .drop("_classes")
    )


def top_k_vocab(df: DataFrame, column: str, k: int) -> DataFrame:
    """(value, idx): the k most frequent values, numbered from 1; ties by value."""
    top = (
        df.where(F.col(column).isNotNull())
        .groupBy(F.col(column).alias("value"))
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "value")
        .limit(k)
    )
    # At most k rows reach this window.
    return top.withColumn("idx", F.row_number().over(Window.orderBy(F.desc("n"), "value")))


def encode(df: DataFrame, column: str, vocab: DataFrame, out: str) -> DataFrame:
    """Replace a value by its index; unknown is 0. The vocabulary has at most k rows by its limit."""
    lookup = vocab.select(F.col("value").alias(column), F.col("idx").alias(out))
    return df.join(F.broadcast(lookup), column, "left").withColumn(out, F.coalesce(out, F.lit(0)))


def auxiliary_features(df: DataFrame, currencies: DataFrame, countries: DataFrame) -> DataFrame:
    """Add ``log_amount``, ``currency_idx`` and ``country_idx``."""
    logged = df.withColumn("log_amount", F.log1p("amount"))
    return encode(encode(logged, "currency", currencies, "currency_idx"), "country", countries, "country_idx")
