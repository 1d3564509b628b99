"""Splits and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.operators import profile as P, splits as SP
from tallyspark.sources.tables import staged

from .registry import query
from .views import TWINS


def _hash(*columns: str) -> str:
    return f"('0x' || substr(md5(concat_ws('|', '42', {', '.join(f'{c}::varchar' for c in columns)})), 1, 13))::bigint"


_LINE = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
_ALL = (*_LINE, "l_returnflag")

TWINS["line_ranks"] = ((), f"""
select {", ".join(_ALL)}, count(*) over () as n,
  row_number() over (order by {_hash(*_LINE)}, {", ".join(_ALL)}) - 1 as pos from lineitem""")
TWINS["trend_ranks"] = (("trend",), f"""
select *, count(*) over () as n, row_number() over (order by period, {_hash("user_id", "category")}) - 1 as pos
from trend""")
TWINS["trend_split"] = (("trend_ranks",), """
select *, case when pos < floor(n * 0.7::double) then 'train' when pos < floor(n * 0.85::double) then 'val'
  else 'test' end as split from trend_ranks""")
_BY_HASH = """case when pos < floor(n * 0.8::double) then 'train' when pos < floor(n * 0.9::double) then 'val'
  else 'test' end"""


def lines(t):
    return t.table("lineitem").select(*_ALL)


def trend(t):
    return staged(t.trend.select("user_id", "category", "period", "current_spend", "rolling_mean_3m", "next_month_spend"),
                  "trend")


@query("split_by_time", "M2 W13", "select user_id, category, period, next_month_spend, split from trend_split",
       ("trend_split",))
def split_by_time(t):
    return SP.split_by_time(trend(t)).select("user_id", "category", "period", "next_month_spend", "split")


@query("split_by_hash", "M3", f"select {', '.join(_ALL)}, {_BY_HASH} as split from line_ranks", ("line_ranks",))
def split_by_hash(t):
    return SP.split_by_hash(lines(t), _LINE)


@query("split_of_copies", "M3", f"""
select l_returnflag, l_linestatus, {_BY_HASH} as split, count(*) as n from (
  select l_returnflag, l_linestatus, count(*) over () as n, row_number() over (
    order by {_hash("l_returnflag", "l_linestatus")}, l_returnflag, l_linestatus) - 1 as pos from lineitem) group by all""")
def split_of_copies(t):
    """Four distinct rows in the whole table: every cut falls inside a group of copies."""
    flags = t.table("lineitem").select("l_returnflag", "l_linestatus")
    return P.count_by(SP.split_by_hash(flags), "l_returnflag", "l_linestatus", "split")


@query("split_sizes", "A15 P10", f"select split, count(*) as n from (select {_BY_HASH} as split from line_ranks) group by all",
       ("line_ranks",))
def split_sizes(t):
    split = SP.split_by_hash(lines(t), _LINE)
    parts = [SP.part(split, s) for s in SP.SPLITS]
    return P.count_by(parts[0].unionByName(parts[1]).unionByName(parts[2]), "split")


@query("fallback_splits", "M4", f"""
select 'time' as kind, split, count(*) as n from trend_split group by all
union all select 'hash', {_BY_HASH}, count(*) from line_ranks group by all
union all select 'given', case when l_returnflag = 'R' then 'test' else 'train' end, count(*) from lineitem group by all""",
       ("trend_split", "line_ranks"))
def fallback_splits(t):
    given = lines(t).withColumn("split", F.when(F.col("l_returnflag") == "R", "test").otherwise("train"))
    kinds = {
        "time": SP.ensure_split(trend(t), "period", ["user_id", "category"]),
        "hash": SP.ensure_split(lines(t), key=_LINE),
        "given": SP.ensure_split(given),
    }
    counted = [
        P.count_by(df, "split").select(F.lit(kind).alias("kind"), "split", "n") for kind, df in kinds.items()
    ]
    return counted[0].unionByName(counted[1]).unionByName(counted[2])


@query("capped_sample", "M5", f"""
select {", ".join(_ALL)}, split from (
  select *, row_number() over (partition by split order by {_hash(*_LINE)}, {", ".join(_ALL)}) as r
  from (select *, {_BY_HASH} as split from line_ranks))
where split <> 'train' or r <= 5000""", ("line_ranks",))
def capped_sample(t):
    split = staged(SP.split_by_hash(lines(t), _LINE), "split")
    return SP.cap_sample(split, 5000, _LINE)


@query("sampled_rows", "M6 M7", f"select {', '.join(_ALL)} from line_ranks where pos < 50", ("line_ranks",))
def sampled_rows(t):
    return SP.sample_rows(lines(t), 50, _LINE)


@query("shuffled_split", "F3 M7", f"""
select {", ".join(_ALL)}, case when pos < floor(n * 0.8::double) then 'train'
  when pos <= floor(n * 0.9::double) then 'val' else 'test' end as split from line_ranks""", ("line_ranks",))
def shuffled_split(t):
    return SP.split_shuffled(lines(t), _LINE)
