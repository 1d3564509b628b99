"""Survey tables to labelled transactions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.functions import fixed
from tallyspark.functions.money import dollars
from tallyspark.operators import labels as L, merchants as M, profile as P, survey as S
from tallyspark.operators.splits import split_by_hash
from tallyspark.sources.tables import staged

from .registry import query
from .views import TWINS

_POOLS = M.merchant_pools()


def _values(rows: list[tuple], columns: str) -> str:
    def lit(v) -> str:
        if isinstance(v, list):
            return "[" + ", ".join(lit(x) for x in v) + "]"
        return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)

    return f"select * from (values {', '.join('(' + ', '.join(lit(v) for v in r) + ')' for r in rows)}) t({columns})"


def _u(seed: str, *columns: str) -> str:
    key = " || '|' || ".join([f"'{seed}'", *[f"{c}::varchar" for c in columns]])
    return f"((('0x' || substr(md5({key}), 1, 13))::bigint + 0.5::double) / 4503599627370496.0::double)"


_GROUP = ("persona_id", "major_category", "period")
_PART = (*_GROUP, "part")


def _index(size: str, seed: str) -> str:
    return f"floor({_u(seed, *_PART)} * {size})::int"


TWINS.update(
    {
        "prefixes": ((), _values(list(fixed.UCC_PREFIX.items()), "prefix, name")),
        "purchases": ((), _values([(c, a, b) for c, (a, b) in fixed.PURCHASES.items()], "c, least_n, most_n")),
        "related": ((), _values([(k, v) for k, v in fixed.RELATED.items()], "c, r")),
        "pools": ((), _values([(*k.split("|"), v) for k, v in _POOLS.items()], "c, g, pool")),
        "states": ((), _values(list(fixed.STATES.items()), "g, states")),
        "cities": ((), _values(list(fixed.CITIES.items()), "st, cities")),
        "codes": (("latest", "items", "hg", "prefixes"), """
select i.NEWID as persona_id, coalesce(p.name, 'Miscellaneous') as major_category,
  make_date(i.REFYR, i.REFMO, 1) as period, i.u as ucc, coalesce(h.title, 'Unknown Item') as item_name,
  round(coalesce(try_cast(i.COST as double), 0) * 100)::bigint as c
from (select *, lpad(trim(UCC), 6, '0') as u from items where NEWID in (select NEWID from latest)) i
left join (select ucc, max(title) as title from hg group by ucc) h on i.u = h.ucc
left join prefixes p on p.prefix = substr(i.u, 1, 2)"""),
        "totals": (("codes",), """
select persona_id, major_category, period, sum(c)::bigint as total_cents, count(*) as item_count,
  string_agg(ucc, ',' order by ucc, item_name) as uccs, string_agg(item_name, ',' order by ucc, item_name) as item_names,
  bool_or(regexp_matches(lower(item_name), 'egg|cereal|meat')) as food,
  bool_or(not regexp_matches(lower(item_name), 'egg|cereal|meat')
    and regexp_matches(lower(item_name), 'electric|gas|water')) as power,
  bool_or(not regexp_matches(lower(item_name), 'egg|cereal|meat|electric|gas|water')
    and contains(lower(item_name), 'insurance')) as insured,
  bool_or(not regexp_matches(lower(item_name), 'egg|cereal|meat|electric|gas|water|insurance')
    and regexp_matches(lower(item_name), 'doctor|hospital|drug')) as medical
from codes group by all having sum(c) > 0"""),
        "txn": (("totals", "purchases"), f"""
select *, round(total_cents / n_parts * (0.95::double + {_u("42x", *_PART)} * (1.10::double - 0.95::double)))::bigint
  / 100.0::double as amount
from (select *, unnest(range(1, n_parts + 1)) as part from (
  select t.*, coalesce(least_n, 2) + floor({_u("42n", *_GROUP)}
    * (coalesce(most_n, 5) - coalesce(least_n, 2) + 1))::int as n_parts
  from totals t left join purchases on c = major_category))"""),
        "labelled": (("txn", "related"), """
select persona_id, major_category, period, part, amount, list_sort(list_distinct(list_concat([major_category],
  coalesce(r, []::varchar[]),
  case when food then ['Groceries', 'Food'] else [] end, case when power then ['Utilities', 'Bills'] else [] end,
  case when insured then ['Insurance'] else [] end, case when medical then ['Healthcare', 'Medical'] else [] end)))
  as categories
from txn left join related on c = major_category"""),
        "described": (("txn", "latest", "pools", "states", "cities"), f"""
select persona_id, major_category, period, part, region, upper(case {_index("3", "42l")}
    when 0 then merchant || ' ' || number || ' ' || city || ' ' || state
    when 1 then merchant || ' ' || number || ' ' || state else merchant || ' ' || city || ' ' || state end) as description
from (select *, coalesce(cities, ['ANYTOWN']) as cs,
    coalesce(cities, ['ANYTOWN'])[1 + {_index("len(coalesce(cities, ['ANYTOWN']))", "42c")}] as city
  from (select *, case when {_u("42q", *_PART)} < 0.7 then chosen[1 + {_index("len(chosen)", "42f")}]
      else pool[1 + {_index("len(pool)", "42a")}] end as merchant,
      '#' || lpad((100 + {_index("9900", "42s")})::varchar, 4, '0') as number,
      states[1 + {_index("len(states)", "42t")}] as state
    from (select *, list_transform(list_sort(list_transform(pool, lambda m: md5('42p|' || persona_id || '|' || major_category
        || '|' || m) || '|' || m))[1:3], lambda s: substr(s, 34)) as chosen
      from (select x.*, coalesce(case REGION when 1 then 'Northeast' when 2 then 'Midwest' when 3 then 'South'
          when 4 then 'West' end, 'Midwest') as region from txn x left join latest s on s.NEWID = x.persona_id)
      join pools on pools.c = major_category and pools.g = region
      join states on states.g = region))
  left join cities on cities.st = state)"""),
    }
)
# The same rule for labels, over the totals as they are.
_, _labelled = TWINS["labelled"]
TWINS["labelled_totals"] = (("totals", "related"), _labelled.replace("period, part, amount,", "period, total_cents / 100.0::double as amount,")
                            .replace("from txn", "from totals"))
TWINS["regions"] = (("latest",), """
select NEWID as persona_id, case REGION when 1 then 'Northeast' when 2 then 'Midwest' when 3 then 'South' when 4 then 'West'
  else 'Midwest' end as region from latest""")


def everyone(t):
    """Every unit once, by its latest record."""
    return S.named_units(S.latest_units(t.units, ["quarter"]))


def totals(t, rules=None):
    return S.period_totals(t.items, everyone(t), t.hierarchy, t.tasks("lineitem"), rules)


def txn(t):
    return S.disaggregate(totals(t))


def amounts(t):
    """The totals with their amount in dollars."""
    return totals(t).withColumn("amount", dollars("total_cents"))


def labelled_totals(t):
    return L.assign_labels(amounts(t), F.transform("items", lambda i: i["item_name"]))


def totals_with_labels(t):
    """Labels hang on a total's items alone, and of these on the rules that their names match."""
    return L.assign_labels(totals(t, L.name_rules), rules="rules").drop("rules")


def labelled(t):
    """Labels are found before a total is split into purchases."""
    return S.disaggregate(totals_with_labels(t))


def joined(df, *columns):
    """Arrays as text, for the comparison."""
    return df.withColumns({c: F.array_join(c, ",") for c in columns})


@query("latest_units", "W12 P5", "select * from latest", ("latest",))
def latest_units(t):
    return S.latest_units(t.units, ["quarter"])


@query("weighted_unit_sample", "M1 P5", "select NEWID, FINLWT21, REGION as region from sampled", ("sampled",))
def weighted_unit_sample(t):
    return S.sample_units(S.latest_units(t.units, ["quarter"])).select("NEWID", "FINLWT21", "region")


@query("uniform_unit_sample", "M1", """
select NEWID from latest order by ('0x' || substr(md5('42|' || NEWID), 1, 13))::bigint, NEWID limit 100""", ("latest",))
def uniform_unit_sample(t):
    units = S.latest_units(t.units, ["quarter"]).drop("FINLWT21")
    return S.sample_units(units, 100).select("NEWID")


@query("period_totals", "J1 J2 J13 P6 P7 A6", """
select persona_id, major_category, period, total_cents, item_count, uccs, item_names from totals""", ("totals",))
def period_totals(t):
    lists = S.item_lists(totals(t))
    return joined(lists, "uccs", "item_names").select(
        "persona_id", "major_category", "period", "total_cents", "item_count", "uccs", "item_names"
    )


@query("disaggregated_transactions", "E4", """
select persona_id, major_category, period, part, amount, item_count from txn""", ("txn",))
def disaggregated_transactions(t):
    return txn(t).select("persona_id", "major_category", "period", "part", "amount", "item_count")


@query("labelled_transactions", "E1 E2 J14 U3", """
select persona_id, major_category, period, part, array_to_string(categories, ',') as categories from labelled""",
       ("labelled",))
def labelled_transactions(t):
    return joined(labelled(t), "categories").select("persona_id", "major_category", "period", "part", "categories")


@query("labels_of_totals", "E1 E2 J14 U3", """
select persona_id, major_category, period, amount, array_to_string(categories, ',') as categories from labelled_totals""",
       ("labelled_totals",))
def labels_of_totals(t):
    return joined(labelled_totals(t), "categories").select("persona_id", "major_category", "period", "amount", "categories")


@query("regional_totals", "J12", """
select region, major_category, count(*) as n, sum(total_cents)::bigint as total_cents from totals join regions using (persona_id)
group by all""", ("totals", "regions"))
def regional_totals(t):
    rows = totals(t).join(M.unit_regions(everyone(t)), "persona_id")
    return rows.groupBy("region", "major_category").agg(
        F.count(F.lit(1)).alias("n"), F.sum("total_cents").alias("total_cents")
    )


_SUBCATEGORY = "case p_size % 6 when 0 then 'Shelter' when 1 then 'Drugs' when 2 then 'Tuition' when 3 then 'Dairy products' when 4 then 'Gasoline and motor oil' else 'Other' end"
_MAJOR = "case p_partkey % 4 when 0 then 'Food' when 1 then 'Housing' when 2 then 'Healthcare' else 'Pets' end"


@query("labels_by_subcategory", "J20 U3", f"""
select p_partkey, array_to_string(list_sort(list_distinct(list_concat(coalesce(b.r, [m]),
  coalesce(s.r, []::varchar[])))), ',') as categories
from (select p_partkey, {_MAJOR} as m, {_SUBCATEGORY} as u from part)
left join ({_values(list(fixed.CATEGORY_LABELS.items()), "c, r")}) b on b.c = m
left join ({_values(list(fixed.SUBCATEGORY_LABELS.items()), "c, r")}) s on s.c = u""")
def labels_by_subcategory(t):
    parts = t.table("part").selectExpr("p_partkey", f"{_MAJOR} as major_category", f"{_SUBCATEGORY} as subcategory")
    return joined(L.extra_labels(parts), "categories").select("p_partkey", "categories")


@query("merchant_descriptions", "J12 J21 E3", """
select persona_id, major_category, period, part, region, description from described""", ("described",))
def merchant_descriptions(t):
    return M.assign_merchants(txn(t), everyone(t)).select(
        "persona_id", "major_category", "period", "part", "region", "description"
    )


@query("first_transactions", "T9", """
select persona_id, major_category, period, part, amount from txn
order by persona_id, major_category, period, part limit 10""", ("txn",))
def first_transactions(t):
    keys = ["persona_id", "major_category", "period", "part"]
    return txn(t).orderBy(*keys).limit(10).select(*keys, "amount")


@query("text_training_set", "P8 P9 M3", """
select x.persona_id, x.period, x.description, '["' || array_to_string(l.categories, '","') || '"]' as categories, l.amount,
  'USD' as currency, 'US' as country, 0.5::double as sample_weight,
  case when pos < floor(n * 0.8::double) then 'train' when pos < floor(n * 0.9::double) then 'val' else 'test' end as split
from (select *, count(*) over () as n, row_number() over (order by ('0x' || substr(md5(concat_ws('|', '42', persona_id,
    major_category, period::varchar, part::varchar)), 1, 13))::bigint) - 1 as pos from described) x
join labelled l using (persona_id, major_category, period, part)""", ("described", "labelled"))
def text_training_set(t):
    # Totals get labels, region and merchants before they are split, so purchases are neither joined nor shuffled, and all draws
    # of a purchase, that of the split too, are found at once.
    chosen = M.merchant_choices(totals_with_labels(t), everyone(t), tasks=t.tasks("lineitem"))
    full = M.assign_merchants(S.disaggregate(chosen, draws=[*M.merchant_seeds(), "42"]))
    slim = staged(
        full.select(*M.KEY, "description", "categories", "amount", F.col(M.DRAWS)["42"].alias("_split")), "txn"
    )
    return L.text_set(split_by_hash(slim, M.KEY, hashed="_split"))


@query("label_distribution", "A16", """
select label, count(*) as n from (select unnest(categories) as label from labelled) group by all""", ("labelled",))
def label_distribution(t):
    return L.label_counts(labelled(t))


@query("label_universe", "A17", """
select string_agg(label, ',' order by label) as classes from (
  select distinct unnest(categories) as label from labelled_totals)""", ("labelled_totals",))
def label_universe(t):
    return joined(L.label_universe(labelled_totals(t)), "classes")


# Each different label list is turned into its row of zeros and ones once.
TWINS["label_rows"] = (("labelled",), """
select categories, string_agg(case when list_contains(categories, label) then '1' else '0' end, ',' order by label) as target
from (select distinct categories from labelled) cross join (select distinct unnest(categories) as label from labelled)
group by categories""")


@query("binarised_labels", "ML4", """
select persona_id, major_category, period, part, target from labelled join label_rows using (categories)""", ("label_rows",))
def binarised_labels(t):
    rows = staged(labelled(t).select("persona_id", "major_category", "period", "part", "categories"), "labelled")
    return joined(L.binarise(rows, L.label_universe(rows).scalar()), "target").select(
        "persona_id", "major_category", "period", "part", "target"
    )


@query("labels_through_json", "P9", """
select persona_id, major_category, period, part, len(categories) as n_labels from labelled""", ("labelled",))
def labels_through_json(t):
    text = labelled(t).withColumn("categories", F.to_json("categories"))
    return L.parse_labels(text).select(
        "persona_id", "major_category", "period", "part", F.size("categories").cast("bigint").alias("n_labels")
    )


@query("top_values", "T2", """
select value, row_number() over (order by n desc, value) as idx, n from (
  select source as value, count(*) as n from documents group by all) order by n desc, value limit 3""")
def top_values(t):
    return L.top_k_vocab(t.table("documents"), "source", 3).select("value", "idx", "n")


@query("auxiliary_features", "T2 J18 ML3", """
with ranked as (select source, row_number() over (order by count(*) desc, source) as idx from documents group by source),
langs as (select lang, row_number() over (order by count(*) desc, lang) as idx from documents group by lang)
select doc_id, round(ln(1 + n_chars), 9) as log_amount,
  case when r.idx <= 2 then r.idx else 0 end::int as currency_idx, case when l.idx <= 3 then l.idx else 0 end::int as country_idx
from documents left join ranked r using (source) left join langs l using (lang)""")
def auxiliary_features(t):
    rows = t.table("documents").selectExpr(
        "doc_id", "cast(n_chars as double) as amount", "source as currency", "lang as country"
    )
    encoded = L.auxiliary_features(rows, L.top_k_vocab(rows, "currency", 2), L.top_k_vocab(rows, "country", 3))
    return encoded.select("doc_id", F.round("log_amount", 9).alias("log_amount"), "currency_idx", "country_idx")


@query("average_monthly_spend", "A10", """
select major_category, sum(c) / count(*) / 100.0::double as avg_monthly from (
  select major_category, period, sum(round(amount * 100)::bigint) as c from txn group by all) group by all""", ("txn",))
def average_monthly_spend(t):
    return P.average_monthly(txn(t))


@query("transactions_per_category", "A11", "select major_category, count(*) as n from txn group by all", ("txn",))
def transactions_per_category(t):
    return P.count_by(txn(t), "major_category")


@query("label_coverage", "A12", """
select sum(len(categories)) / count(*) as avg_labels, min(len(categories))::int as min_labels,
  count(*) filter (where len(categories) >= 2) / count(*) as pct_multilabel from labelled""", ("labelled",))
def label_coverage(t):
    return P.label_coverage(labelled(t))


@query("amount_profile", "A13", """
select sum(round(amount * 100)::bigint) / count(*) / 100.0::double as amount_mean,
  median(round(amount * 100)::bigint) / 100.0::double as amount_median, round(stddev_samp(amount), 6) as amount_std,
  min(amount) as amount_min, max(amount) as amount_max from ledger""", ("ledger",))
def amount_profile(t):
    return P.amount_profile(t.ledger).withColumn("amount_std", F.round("amount_std", 6))


@query("distinct_counts", "A14", """
select count(*) as n_rows, count(distinct user_id) as n_user_id, count(distinct category_name) as n_category_name,
  count(distinct transaction_date) as n_transaction_date from ledger""", ("ledger",))
def distinct_counts(t):
    return P.distinct_counts(t.ledger, ["user_id", "category_name", "transaction_date"])


@query("quality_report", "A12 A13 A14 A19", """
select r.rule, r.value, case r.rule when 'positive amounts' then r.value > 0 else r.value >= r.bound end as passed
from (select min(len(categories)) as l, min(amount) as a, count(distinct persona_id) as p from labelled),
lateral (values ('labels per transaction', l::double, 2), ('positive amounts', a::double, 0),
  ('personas', p::double, 100)) r(rule, value, bound)""", ("labelled",))
def quality_report(t):
    return P.quality_issues(P.profile(staged(labelled(t), "labelled")))
