"""The given tables in the roles of ledger, survey, feedback, predictions and registry.

``Tables`` builds the views with Spark; ``TWINS`` states the same views for the SQL side.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyspark.operators.features import trend_features
from tallyspark.sources.tables import tasks_for

ASOF = dt.date(2000, 1, 1)
CUT = dt.date(1998, 6, 1)

CATEGORY = (
    "case when p_size > 45 then null when p_size <= 18 then 'A' when p_size <= 34 then 'B' "
    "when p_size <= 41 then 'C' else 'D' end"
)
HASH16 = "cast(conv(substr(md5(concat(cast(row_id as string), '|', label)), 1, 4), 16, 10) as bigint)"


class Tables:
    """Views over one scale directory; every property is a lazy DataFrame."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def path(self, name: str) -> str:
        return f"{self.dir}/{name}.parquet"

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def tasks(self, name: str) -> int:
        """Tasks for a shuffle of a table's rows, which are counted in the footers of its files."""
        return tasks_for(self.spark, self.table(name).count())

    # ------------------------------------------------------------ ledger

    @property
    def ledger(self) -> DataFrame:
        items, parts = self.table("lineitem"), self.table("part")
        return items.join(parts, F.col("l_partkey") == F.col("p_partkey"), "left").selectExpr(
            "l_orderkey * 10 + l_linenumber as transaction_id",
            "cast(l_suppkey as string) as user_id",
            "p_name as description",
            "l_extendedprice as amount",
            "l_shipdate as transaction_date",
            f"{CATEGORY} as category_name",
        )

    @property
    def budgets(self) -> DataFrame:
        return self.table("supplier").selectExpr("s_suppkey", "explode(array(0, 1)) as k").selectExpr(
            "s_suppkey * 2 + k as id", "cast(s_suppkey as string) as user_id",
            "case when k = 0 then 'A' else 'B' end as name",
        )

    @property
    def budget_limits(self) -> DataFrame:
        return (
            self.table("supplier").where("s_suppkey % 3 <> 2")
            .selectExpr("s_suppkey", "s_acctbal", "explode(array(0, 1)) as k")
            .selectExpr(
                "s_suppkey * 2 + k as budget_id",
                "1000 + abs(s_acctbal) as amount",
                "cast(case when k = 0 then '1995-01-01' else '1990-01-01' end as date) as start_date",
                "cast(case when k = 0 then '2002-12-31' else '1990-12-31' end as date) as end_date",
            )
        )

    @property
    def transactions(self) -> DataFrame:
        return self.table("lineitem").selectExpr(
            "l_orderkey * 10 + l_linenumber as id", "l_orderkey as transaction_journal_id",
            "l_returnflag as description",
            "case when l_returnflag = 'R' then -l_extendedprice else l_extendedprice end as amount",
            "l_shipdate as date",
        )

    @property
    def journals(self) -> DataFrame:
        return self.table("orders").selectExpr(
            "o_orderkey as id", "cast(o_custkey as string) as user_id",
            "case when o_custkey % 7 > 4 then null else cast(o_custkey % 7 as int) end as category_id",
            "o_custkey % 11 as budget_id",
        )

    @property
    def categories(self) -> DataFrame:
        return self.table("region").selectExpr("r_regionkey as id", "r_name as name")

    # ------------------------------------------------------------ trend set

    @property
    def trend(self) -> DataFrame:
        return trend_features(self.ledger)

    # ------------------------------------------------------------ survey

    @property
    def units(self) -> DataFrame:
        return (
            self.table("customer").join(self.table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
            .selectExpr("*", "explode(array(1, 2)) as quarter").where("quarter = 1 or c_custkey % 7 = 0")
            .selectExpr(
                "cast(c_custkey as string) as NEWID", "c_acctbal as FINLWT21", "n_regionkey as REGION", "quarter"
            )
        )

    @property
    def items(self) -> DataFrame:
        lines, orders = self.table("lineitem"), self.table("orders")
        return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).selectExpr(
            "cast(o_custkey as string) as NEWID",
            "cast((l_partkey % 90 + 1) * 10000 + l_linenumber as string) as UCC",
            "case when l_linenumber = 7 then 'n/a' else cast(l_extendedprice as string) end as COST",
            "year(l_shipdate) as REFYR", "month(l_shipdate) as REFMO",
        )

    @property
    def hierarchy(self) -> DataFrame:
        return self.table("part").selectExpr("p_partkey", "explode(array(1, 2, 3)) as n").selectExpr(
            "'1' as level",
            "case p_partkey % 5 when 0 then 'Eggs and cereal' when 1 then 'Gasoline' "
            "when 2 then 'Health insurance' when 3 then 'Prescription drugs' else 'Other item' end as title",
            "lpad(cast((p_partkey % 90 + 1) * 10000 + n as string), 6, '0') as ucc",
        ).distinct()

    # ------------------------------------------------------------ feedback

    @property
    def feedback_text(self) -> DataFrame:
        orders, customers = self.table("orders"), self.table("customer")
        return orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).selectExpr(
            "o_orderkey as feedback_id", "cast(o_custkey as string) as user_id", "o_orderkey as transaction_id",
            "o_orderpriority as predicted_category", "c_mktsegment as actual_category",
            "case when o_orderstatus = 'F' then 'override' else 'accepted' end as feedback_type",
            "o_totalprice as amount", "o_orderdate as created_at",
            "case when o_orderkey % 10 = 0 then 'trend' else 'categorization' end as model_type",
        )

    @property
    def feedback_trend(self) -> DataFrame:
        return self.table("events").where("event_type in ('purchase', 'click', 'error')").selectExpr(
            "event_id as feedback_id", "cast(user_id as string) as user_id",
            "case when event_id % 2 = 0 then 'A' else 'B' end as category_name",
            "value / 10 as anomaly_score", "value * 900 as predicted_spend", "value * 1000 as actual_spend",
            "case event_type when 'purchase' then 'expected' when 'click' then 'helpful' else 'not_useful' end "
            "as feedback_type",
            "ts as created_at", "'trend' as model_type",
        )

    # ------------------------------------------------------------ predictions

    @property
    def predictions(self) -> DataFrame:
        documents, labels = self.table("documents"), self.table("labels")
        return (
            documents.join(labels, "doc_id")
            .selectExpr("doc_id as row_id", "quality", "toxic", "n_chars",
                        "explode(array('quality', 'toxic', 'long')) as label")
            .selectExpr(
                "row_id", "label",
                "cast(case label when 'quality' then quality when 'toxic' then toxic "
                "else case when n_chars > 2000 then 1 else 0 end end as int) as actual",
                f"{HASH16} / 65535.0D as prob",
            )
        )

    # ------------------------------------------------------------ registry

    @property
    def run_metrics(self) -> DataFrame:
        return (
            self.table("supplier")
            .selectExpr(
                "s_suppkey",
                "stack(4, 'test_subset_accuracy', 0.93D, 'test_macro_f1', 0.88D, 'test_min_class_recall', 0.75D, "
                "'test_abstention_rate', 0.18D) as (metric, base)",
            )
            .where("not (s_suppkey % 4 = 3 and metric = 'test_macro_f1')")
            .selectExpr("s_suppkey as run_id", "metric", "base * (0.9D + 0.2D * (s_suppkey % 10) / 10) as value")
        )

    @property
    def trend_metrics(self) -> DataFrame:
        return self.table("supplier").selectExpr(
            "cast(s_nationkey as string) as model_type", "s_suppkey as run_id",
            "stack(3, 'xgb_test_rmse', cast(100 + s_suppkey % 17 as double), "
            "'xgb_test_mae', cast(50 + s_suppkey % 13 as double), "
            "'xgb_precision_at_5', (s_suppkey % 6) / 5.0D) as (metric, value)",
        )

    @property
    def production_metrics(self) -> DataFrame:
        return self.table("nation").where("n_nationkey % 5 <> 4").selectExpr(
            "cast(n_nationkey as string) as model_type",
            "stack(2, 'xgb_test_rmse', cast(103 + n_nationkey % 4 as double), "
            "'xgb_test_mae', cast(52 + n_nationkey % 3 as double)) as (metric, value)",
        )

    @property
    def status_events(self) -> DataFrame:
        return self.table("orders").selectExpr(
            "o_custkey as model_id", "o_orderpriority as model_type", "o_orderkey as seq", "o_orderdate as ts",
            "case o_orderkey % 5 when 0 then 'TRAINING' when 1 then 'SHADOW' when 2 then 'CANARY' "
            "when 3 then 'PRODUCTION' else 'RETIRED' end as status",
        )

    @property
    def models(self) -> DataFrame:
        return self.table("orders").selectExpr(
            "o_orderkey as model_id", "o_orderpriority as model_type",
            "case when o_custkey % 3 = 0 then null else cast(o_custkey % 50 as string) end as user_id",
            "o_orderkey as seq", "o_orderdate as ts",
            "case o_orderkey % 5 when 0 then 'TRAINING' when 1 then 'SHADOW' when 2 then 'CANARY' "
            "when 3 then 'PRODUCTION' else 'RETIRED' end as status",
            "concat('1.', cast(o_orderkey % 9 as string), '.0') as version",
        )


# name: (views it needs, SQL)
TWINS: dict[str, tuple[tuple[str, ...], str]] = {
    "ledger": ((), f"""
select l_orderkey * 10 + l_linenumber as transaction_id, cast(l_suppkey as varchar) as user_id,
  p_name as description, l_extendedprice as amount, l_shipdate as transaction_date, {CATEGORY} as category_name
from lineitem left join part on l_partkey = p_partkey"""),
    "budgets": ((), """
select s_suppkey * 2 + k as id, cast(s_suppkey as varchar) as user_id, case when k = 0 then 'A' else 'B' end as name
from supplier cross join (select 0 as k union all select 1) t"""),
    "budget_limits": ((), """
select s_suppkey * 2 + k as budget_id, 1000 + abs(s_acctbal) as amount,
  cast(case when k = 0 then '1995-01-01' else '1990-01-01' end as date) as start_date,
  cast(case when k = 0 then '2002-12-31' else '1990-12-31' end as date) as end_date
from supplier cross join (select 0 as k union all select 1) t where s_suppkey % 3 <> 2"""),
    "active": (("budgets", "budget_limits"), """
select user_id, name as category, max_by(amount, (start_date, budget_id)) as budget
from budget_limits join budgets on budget_id = id
where start_date <= date '2000-01-01' and end_date >= date '2000-01-01' group by all"""),
    "transactions": ((), """
select l_orderkey * 10 + l_linenumber as id, l_orderkey as transaction_journal_id, l_returnflag as description,
  case when l_returnflag = 'R' then -l_extendedprice else l_extendedprice end as amount, l_shipdate as date
from lineitem"""),
    "journals": ((), """
select o_orderkey as id, cast(o_custkey as varchar) as user_id,
  case when o_custkey % 7 > 4 then null else cast(o_custkey % 7 as int) end as category_id,
  o_custkey % 11 as budget_id from orders"""),
    "categories": ((), "select r_regionkey as id, r_name as name from region"),
    "month_rows": (("ledger",), """
select user_id, category_name as category, date_trunc('month', transaction_date)::date as period,
  coalesce(sum(round(amount * 100)::bigint), 0)::bigint as spend, count(amount) as txn_count,
  max(transaction_date) as last_txn, count(*) filter (where isodow(transaction_date) >= 6) as weekend_txns,
  coalesce(sum(round(amount * 100)::bigint) filter (where day(transaction_date) <= 15), 0)::bigint as mid_spend
from ledger group by all"""),
    "months": (("month_rows", "ledger"), """
select m.*, t.total from month_rows m join (
  select user_id, date_trunc('month', transaction_date)::date as period,
    sum(round(amount * 100)::bigint)::bigint as total from ledger group by all) t using (user_id, period)
where category is not null"""),
    "hist_all": (("months",), """
select *, row_number() over by_month - 1 as i,
  lag(spend) over by_month as prev, lead(spend) over by_month as next_spend, lag(last_txn) over by_month as prev_last,
  lag(spend, 2) over by_month as prev2, lag(spend, 3) over by_month as prev3,
  sum(spend) over f3 / count(*) over f3 / 100.0::double as mean3,
  sum(spend) over f6 / count(*) over f6 / 100.0::double as mean6,
  sqrt((count(*) over f3 * sum(spend::hugeint * spend) over f3 - sum(spend) over f3 * sum(spend) over f3)::double)
    / count(*) over f3 / 100.0::double as raw_std3,
  sqrt((count(*) over f6 * sum(spend::hugeint * spend) over f6 - sum(spend) over f6 * sum(spend) over f6)::double)
    / count(*) over f6 / 100.0::double as raw_std6,
  avg((spend / 100.0::double) / greatest(total / 100.0::double, 1e-8::double)) over f6 as hist_share,
  sum(txn_count) over f3 / count(*) over f3 as hist_count,
  avg((spend / 100.0::double) / greatest(txn_count, 1)) over f3 as hist_size,
  count(*) over pair as n_months, sum(txn_count) over pair as n_txn
from months
window pair as (partition by user_id, category), by_month as (partition by user_id, category order by period),
  f3 as (partition by user_id, category order by period rows between 3 preceding and 1 preceding),
  f6 as (partition by user_id, category order by period rows between 6 preceding and 1 preceding)"""),
    "hist": (("hist_all",), """
select * from hist_all where n_months >= 3 and n_txn / n_months >= 2"""),
    "elevated_n": (("hist",), """
select user_id, period,
  sum(case when i >= 1 and spend / 100.0::double > mean3 * 1.2::double then 1 else 0 end)::bigint as elevated_cat_count
from hist group by all"""),
    "features": (("hist", "elevated_n"), """
select user_id, category, period, i, next_spend / 100.0::double as next_month_spend,
  spend / 100.0::double as current_spend, prev / 100.0::double as rolling_mean_1m, mean3 as rolling_mean_3m,
  mean6 as rolling_mean_6m, case when i >= 2 then raw_std3 else 0 end as rolling_std_3m,
  case when i >= 2 then raw_std6 else 0 end as rolling_std_6m,
  least((spend / 100.0::double) / greatest(mean3, 1e-8::double), 10.0::double) as deviation_ratio,
  (spend / 100.0::double) / greatest(total / 100.0::double, 1e-8::double) as share_of_wallet,
  hist_share as hist_share_of_wallet, txn_count, hist_count as hist_txn_count_mean,
  (spend / 100.0::double) / greatest(txn_count, 1) as avg_txn_size, hist_size as hist_avg_txn_size,
  case when prev_last is null then 30
    else greatest(0, floor((epoch(period::timestamp) - epoch(prev_last)) / 86400))::bigint end as days_since_last_txn,
  month(period) as month_of_year, (mid_spend / 100.0::double) / greatest(mean3, 1e-8::double) as spending_velocity,
  weekend_txns / greatest(txn_count, 1) as weekend_txn_ratio, total / 100.0::double as total_monthly_spend,
  elevated_cat_count, 0.0::double as budget_utilization
from hist join elevated_n using (user_id, period) where i >= 1"""),
    "trend": (("features",), "select * from features where next_month_spend is not null"),
    "units": ((), """
select cast(c_custkey as varchar) as NEWID, c_acctbal as FINLWT21, n_regionkey as REGION, q as quarter
from customer join nation on c_nationkey = n_nationkey cross join (select 1 as q union all select 2) t
where q = 1 or c_custkey % 7 = 0"""),
    "latest": (("units",), """
select NEWID, FINLWT21, REGION, quarter from (
  select *, row_number() over (partition by NEWID order by quarter desc) as rn from units) where rn = 1"""),
    "sampled": (("latest",), """
select NEWID, FINLWT21, REGION from latest where FINLWT21 > 0
order by -ln((('0x' || substr(md5('42|' || NEWID), 1, 13))::bigint + 0.5::double) / 4503599627370496.0::double)
  / FINLWT21, NEWID limit 750"""),
    "items": ((), """
select cast(o_custkey as varchar) as NEWID, cast((l_partkey % 90 + 1) * 10000 + l_linenumber as varchar) as UCC,
  case when l_linenumber = 7 then 'n/a' else cast(l_extendedprice as varchar) end as COST,
  year(l_shipdate) as REFYR, month(l_shipdate) as REFMO
from lineitem join orders on l_orderkey = o_orderkey"""),
    "hg": ((), """
select distinct lpad(cast((p_partkey % 90 + 1) * 10000 + n as varchar), 6, '0') as ucc,
  case p_partkey % 5 when 0 then 'Eggs and cereal' when 1 then 'Gasoline' when 2 then 'Health insurance'
    when 3 then 'Prescription drugs' else 'Other item' end as title
from part cross join (select 1 as n union all select 2 union all select 3) t"""),
    "feedback_text": ((), """
select o_orderkey as feedback_id, cast(o_custkey as varchar) as user_id, o_orderkey as transaction_id,
  o_orderpriority as predicted_category, c_mktsegment as actual_category,
  case when o_orderstatus = 'F' then 'override' else 'accepted' end as feedback_type,
  o_totalprice as amount, o_orderdate as created_at,
  case when o_orderkey % 10 = 0 then 'trend' else 'categorization' end as model_type
from orders join customer on o_custkey = c_custkey"""),
    "feedback_trend": ((), """
select event_id as feedback_id, cast(user_id as varchar) as user_id,
  case when event_id % 2 = 0 then 'A' else 'B' end as category_name, value / 10 as anomaly_score,
  value * 900 as predicted_spend, value * 1000 as actual_spend,
  case event_type when 'purchase' then 'expected' when 'click' then 'helpful' else 'not_useful' end as feedback_type,
  ts as created_at, 'trend' as model_type
from events where event_type in ('purchase', 'click', 'error')"""),
    "predictions": ((), """
select d.doc_id as row_id, l.label, cast(case l.label when 'quality' then b.quality when 'toxic' then b.toxic
    else case when d.n_chars > 2000 then 1 else 0 end end as int) as actual,
  ('0x' || substr(md5(concat(cast(d.doc_id as varchar), '|', l.label)), 1, 4))::bigint / 65535.0::double as prob
from documents d join labels b on d.doc_id = b.doc_id
cross join (select 'quality' as label union all select 'toxic' union all select 'long') l"""),
    "run_metrics": ((), """
select s_suppkey as run_id, m.metric, m.base * (0.9::double + 0.2::double * (s_suppkey % 10) / 10) as value
from supplier cross join (select 'test_subset_accuracy' as metric, 0.93::double as base
  union all select 'test_macro_f1', 0.88::double union all select 'test_min_class_recall', 0.75::double
  union all select 'test_abstention_rate', 0.18::double) m
where not (s_suppkey % 4 = 3 and m.metric = 'test_macro_f1')"""),
    "trend_metrics": ((), """
select cast(s_nationkey as varchar) as model_type, s_suppkey as run_id, 'xgb_test_rmse' as metric,
  (100 + s_suppkey % 17)::double as value from supplier
union all select cast(s_nationkey as varchar), s_suppkey, 'xgb_test_mae', (50 + s_suppkey % 13)::double from supplier
union all select cast(s_nationkey as varchar), s_suppkey, 'xgb_precision_at_5', (s_suppkey % 6) / 5.0::double
from supplier"""),
    "production_metrics": ((), """
select cast(n_nationkey as varchar) as model_type, 'xgb_test_rmse' as metric, (103 + n_nationkey % 4)::double as value
from nation where n_nationkey % 5 <> 4
union all select cast(n_nationkey as varchar), 'xgb_test_mae', (52 + n_nationkey % 3)::double
from nation where n_nationkey % 5 <> 4"""),
    "status_events": ((), """
select o_custkey as model_id, o_orderpriority as model_type, o_orderkey as seq, o_orderdate as ts,
  case o_orderkey % 5 when 0 then 'TRAINING' when 1 then 'SHADOW' when 2 then 'CANARY' when 3 then 'PRODUCTION'
    else 'RETIRED' end as status from orders"""),
    "models": ((), """
select o_orderkey as model_id, o_orderpriority as model_type,
  case when o_custkey % 3 = 0 then null else cast(o_custkey % 50 as varchar) end as user_id,
  o_orderkey as seq, o_orderdate as ts,
  case o_orderkey % 5 when 0 then 'TRAINING' when 1 then 'SHADOW' when 2 then 'CANARY' when 3 then 'PRODUCTION'
    else 'RETIRED' end as status,
  concat('1.', cast(o_orderkey % 9 as varchar), '.0') as version from orders"""),
}
