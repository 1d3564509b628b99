"""Survey tables to transactions."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed
from ..functions.draws import draw, draw_index, row_hashes, uniform
from ..functions.money import dollars
from ..functions.order import first_k
from ..sources.tables import require_columns

# Input columns of the survey and what they are called here.
DEMOGRAPHICS = {
    "FINCBTXM": "income", "FAM_SIZE": "family_size", "AGE_REF": "age", "REGION": "region",
    "CUTENURE": "housing_tenure",
}
UNKNOWN_ITEM = "Unknown Item"
OTHER_CATEGORY = "Miscellaneous"


def latest_units(units: DataFrame, order: Sequence[str]) -> DataFrame:
    """One record per NEWID: the last by ``order``. An aggregate, so it combines map-side."""
    others = [c for c in units.columns if c != "NEWID"]
    # Records of one quarter are told apart by their contents.
    order = [*order, *(c for c in others if c not in order)]
    return (
        require_columns(units, ["NEWID"])
        .groupBy(F.col("NEWID").cast("string").alias("NEWID"))
        .agg(F.max_by(F.struct(*others), F.struct(*order)).alias("_u"))
        .select("NEWID", *[F.col("_u")[c].alias(c) for c in others])
    )


def sample_units(units: DataFrame, n: int = 750, weight: str = "FINLWT21", seed: int = 42) -> DataFrame:
    """Weighted sample of ``min(n, units)`` rows without replacement, demographics renamed.

    Each unit gets the key ``-ln(u)/w`` and the smallest keys win (Efraimidis and Spirakis 2006):
    a top-n over independent rows. Weights below zero or null count as zero and are never drawn;
    too few positive weights is an error. Without a weight column the sample is uniform.
    """
    if weight not in units.columns:
        sampled = first_k(units, lambda total: F.least(F.lit(n), total), key=["NEWID"], seed=seed)
    else:
        w = F.greatest(F.coalesce(F.col(weight).cast("double"), F.lit(0.0)), F.lit(0.0))
        keyed = units.withColumn("_w", w)
        need = F.least(F.lit(n), F.count(F.lit(1)))
        short = keyed.agg(
            F.when(
                F.count_if(F.col("_w") > 0) < need,
                F.raise_error(F.lit("fewer units with positive weight than the sample size")).cast("int"),
            ).alias("x")
        ).scalar()
        # The check runs with the query; it adds nothing to the key when it passes.
        key = -F.ln(draw(seed, "NEWID")) / F.col("_w")
        sampled = (
            keyed.where("_w > 0")
            .withColumn("_key", key + F.coalesce(short, F.lit(0)))
            .orderBy("_key", "NEWID")
            .limit(n)
            .drop("_key", "_w")
        )
    return named_units(sampled)


def named_units(units: DataFrame) -> DataFrame:
    """Demographics renamed; all units stay."""
    return units.withColumnsRenamed({k: v for k, v in DEMOGRAPHICS.items() if k in units.columns})


def item_names(hierarchy: DataFrame) -> DataFrame:
    """(ucc, item_name): padded code to title; the last line of a code wins; blanks skipped."""
    ucc, title = F.trim("ucc"), F.trim("title")
    order = "line_no" if "line_no" in hierarchy.columns else "title"
    return (
        hierarchy.where((F.length(ucc) > 0) & (F.length(title) > 0))
        .groupBy(F.lpad(ucc, 6, "0").alias("ucc"))
        .agg(F.max_by(title, F.struct(order, "title")).alias("item_name"))
    )


def major_category(ucc) -> F.Column:
    """Category of a padded code by its first two digits."""
    code = fixed.literal_map(fixed.UCC_PREFIX)[F.substring(ucc, 1, 2)]
    return F.coalesce(code, F.lit(OTHER_CATEGORY))


def period_totals(
    items: DataFrame, units: DataFrame, hierarchy: DataFrame, tasks: int | None = None, rules: Callable[[Column], Column] | None = None
) -> DataFrame:
    """Positive totals per (persona_id, major_category, period) of the given units.

    ``items`` is an array of (ucc, item_name, n): every code once with its count, so the array is
    bounded by the code list however many rows a group has. Costs that do not parse are 0.

    With ``tasks`` items and units are dealt by NEWID to so many tasks, which join and group them. Groups are nearly as many as
    items, so a task's memory goes by its items: choose their number (``tasks_for``), as shuffles that are sized by compressed
    bytes give a task many times as many. Names go to every task, at most one row per code of six characters: joined by a shuffle,
    all items of a code would be in one task, and groups would be dealt anew by bytes.

    ``rules`` gives bits to an item's name: totals then carry ``rules``, the bits of all their items, in place of ``items``, and
    are added up in one step without a list.
    """
    cost = F.coalesce(F.col("COST").try_cast("double"), F.lit(0.0))
    bought = items.select(
        F.col("NEWID").cast("string").alias("NEWID"),
        F.lpad(F.trim("UCC"), 6, "0").alias("ucc"),
        F.make_date("REFYR", "REFMO", F.lit(1)).alias("period"),
        F.round(cost * 100).cast("bigint").alias("_c"),
    )
    wanted = units.select(F.col("NEWID").cast("string").alias("NEWID"))
    if tasks is None:
        bought = bought.join(wanted, "NEWID", "left_semi")
    else:
        # Spark moves a semi join in front of the dealing of items, which then shuffles them twice.
        bought = bought.repartition(tasks, "NEWID").join(wanted.distinct().repartition(tasks, "NEWID"), "NEWID")
    if rules is not None:
        known = item_names(hierarchy).select("ucc", rules(F.col("item_name")).alias("_r"))
        return (
            bought.join(F.broadcast(known), "ucc", "left")
            .groupBy(F.col("NEWID").alias("persona_id"), major_category("ucc").alias("major_category"), "period")
            .agg(
                F.sum("_c").alias("total_cents"),
                F.count("ucc").alias("item_count"),
                F.bit_or(F.coalesce("_r", rules(F.lit(UNKNOWN_ITEM)))).alias("rules"),
            )
            .where("total_cents > 0")
        )
    per_code = bought.groupBy(F.col("NEWID").alias("persona_id"), "period", "ucc").agg(
        F.sum("_c").alias("_c"), F.count("ucc").alias("n")
    )
    named = per_code.join(F.broadcast(item_names(hierarchy)), "ucc", "left").withColumn(
        "item_name", F.coalesce("item_name", F.lit(UNKNOWN_ITEM))
    )
    return (
        named.groupBy("persona_id", major_category("ucc").alias("major_category"), "period")
        .agg(
            F.sum("_c").alias("total_cents"),
            F.sum("n").alias("item_count"),
            F.array_sort(F.collect_list(F.struct("ucc", "item_name", "n"))).alias("items"),
        )
        .where("total_cents > 0")
    )


def item_lists(totals: DataFrame) -> DataFrame:
    """Add ``uccs`` and ``item_names``: one entry per purchased item, repeats included."""

    def repeat(field: str):
        return F.flatten(F.transform("items", lambda i: F.array_repeat(i[field], i["n"].cast("int"))))

    return totals.withColumns({"uccs": repeat("ucc"), "item_names": repeat("item_name")})


def disaggregate(
    totals: DataFrame,
    purchases: Mapping[str, tuple[int, int]] = fixed.PURCHASES,
    default: tuple[int, int] = fixed.DEFAULT_PURCHASES,
    noise: tuple[float, float] = (0.95, 1.10),
    seed: int = 42,
    draws: Sequence[str] = (),
) -> DataFrame:
    """Split a total into purchases: their number uniform in the category's range, each part
    ``total / n`` times a uniform factor. Parts need not add up to the total.

    ``draws`` are seeds of further draws of a purchase: they are found along with the factor's and stay in ``_draws``
    (``row_hashes``).
    """
    group = ("persona_id", "major_category", "period")
    span = F.coalesce(
        fixed.literal_map(dict(purchases))[F.col("major_category")], F.array(F.lit(default[0]), F.lit(default[1]))
    )
    n = span[0] + draw_index(span[1] - span[0] + 1, f"{seed}n", *group)
    factor = F.lit(noise[0]) + uniform(F.col("_draws")[f"{seed}x"]) * F.lit(noise[1] - noise[0])
    return (
        totals.withColumn("n_parts", n)
        .withColumn("part", F.explode(F.sequence(F.lit(1), F.col("n_parts"))))
        .withColumn("_draws", row_hashes([f"{seed}x", *draws], *group, "part"))
        .withColumn("amount", dollars(F.round(F.col("total_cents") / F.col("n_parts") * factor).cast("bigint")))
        .drop("total_cents", "n_parts", *([] if draws else ["_draws"]))
    )
