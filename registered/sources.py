"""Sources and sinks. File formats are exercised on files Spark writes from the given tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F, types as T

from tallyspark.sources import clustered as CL, ledger_store as LS, schemas, state as ST, survey_files as SV, tables as TB

from .registry import query

MOMENT = dt.datetime(2000, 1, 1, 12, 0)
SINCE = dt.datetime(1998, 1, 1)
FB_SINCE = dt.datetime(2024, 1, 10)

LEDGER_COLUMNS = T.StructType([
    T.StructField("l_orderkey", T.LongType()), T.StructField("l_linenumber", T.IntegerType()),
    T.StructField("l_returnflag", T.StringType()), T.StructField("l_extendedprice", T.DoubleType()),
])


@query("read_table_columns", "S1 S2 P1", """
select l_orderkey, l_linenumber, l_extendedprice from lineitem where l_extendedprice > 0""")
def read_table_columns(t):
    lines = TB.read_table(
        t.spark, t.path("lineitem"), LEDGER_COLUMNS, required=["l_orderkey", "l_linenumber", "l_extendedprice"]
    )
    return lines.where("l_extendedprice > 0").select("l_orderkey", "l_linenumber", "l_extendedprice")


_LEDGER = """
select t.id as transaction_id, j.user_id, t.description, t.amount, t.date as transaction_date,
  c.name as category_name, j.category_id, j.budget_id
from transactions t join journals j on t.transaction_journal_id = j.id left join categories c on j.category_id = c.id
where t.amount > 0 and t.date >= timestamp '2000-01-01 12:00:00' - interval 7 months"""


@query("ledger_last_seven_months", "S5 P1 P2 J6 J7", _LEDGER, ("transactions", "journals", "categories"))
def ledger_last_seven_months(t):
    return LS.ledger(t.transactions, t.journals, t.categories, MOMENT)


@query("ledger_of_one_user", "S5 P3", _LEDGER + " and j.user_id = '11'", ("transactions", "journals", "categories"))
def ledger_of_one_user(t):
    return LS.ledger(t.transactions, t.journals, t.categories, MOMENT, user="11")


@query("active_budgets", "S6 J9", "select * from active", ("active",))
def active_budgets(t):
    return LS.active_budgets(t.budget_limits, t.budgets, MOMENT.date())


@query("text_feedback_since", "S7 P4 J10", """
select f.feedback_id, f.user_id, f.transaction_id, o_orderstatus as description, o_totalprice as amount,
  predicted_category, actual_category, feedback_type, created_at
from feedback_text f join orders on f.transaction_id = o_orderkey
where model_type = 'categorization' and created_at >= timestamp '1998-01-01'""", ("feedback_text",))
def text_feedback_since(t):
    described = t.table("orders").selectExpr(
        "o_orderkey as transaction_id", "o_orderstatus as description", "o_totalprice as amount"
    )
    return LS.text_feedback(t.feedback_text, described, SINCE)


@query("trend_feedback_since", "S8 P4", """
select feedback_id, user_id, category_name, anomaly_score, predicted_spend, actual_spend, feedback_type, created_at
from feedback_trend where created_at >= timestamp '2024-01-10'""", ("feedback_trend",))
def trend_feedback_since(t):
    return LS.trend_feedback(t.feedback_trend, FB_SINCE)


@query("feedback_from_file", "S9 S10", """
select feedback_id, user_id, category_name, actual_spend, feedback_type, created_at from feedback_trend""",
       ("feedback_trend",))
def feedback_from_file(t):
    path = TB.scratch_path(t.spark, "feedback") + ".parquet"
    TB.write_table(t.feedback_trend.drop("model_type"), path)
    found = TB.read_feedback(t.spark, path, schemas.TREND_FEEDBACK)
    missing = TB.read_feedback(t.spark, path + ".none.parquet", schemas.TREND_FEEDBACK)
    return found.unionByName(missing).select(
        "feedback_id", "user_id", "category_name", "actual_spend", "feedback_type", "created_at"
    )


@query("ledger_through_csv", "S1 S11", """
select transaction_id, user_id, amount, transaction_date, category_name from ledger""", ("ledger",))
def ledger_through_csv(t):
    path = TB.scratch_path(t.spark, "ledger") + ".csv"
    TB.write_table(t.ledger.select(*[f.name for f in schemas.LEDGER]), path)
    back = TB.read_table(t.spark, path, schemas.LEDGER, schemas.LEDGER_REQUIRED)
    return back.select("transaction_id", "user_id", "amount", "transaction_date", "category_name")


@query("ledger_through_json", "S12", "select transaction_id, user_id, amount from ledger", ("ledger",))
def ledger_through_json(t):
    path = TB.scratch_path(t.spark, "ledger") + ".json"
    TB.write_table(t.ledger, path)
    return t.spark.read.schema(schemas.LEDGER).json(path).select("transaction_id", "user_id", "amount")


@query("months_by_partition", "S10 S13", """
select user_id, category, spend, period from months where period >= date '1998-01-01'""", ("months",))
def months_by_partition(t):
    """Partitioned by month: the filter prunes folders. The path may be any object-store URI."""
    from tallyspark.operators.monthly import monthly

    path = TB.scratch_path(t.spark, "months") + ".parquet"
    months = monthly(t.ledger)
    TB.write_table(months.repartition("period"), path, partition_by=["period"])
    return (
        t.spark.read.schema(months.schema).parquet(path)
        .where(F.col("period") >= F.lit("1998-01-01").cast("date"))
        .select("user_id", "category", "spend", "period")
    )


@query("months_of_version", "S10 S13", """
select user_id, category, spend, period from months where period >= date '1998-01-01' and user_id > '5'""", ("months",))
def months_of_version(t):
    """A clustered table in two versions, the second committed twice: the filters prune folders and row groups."""
    from tallyspark.operators.monthly import monthly

    path = TB.scratch_path(t.spark, "versions")
    months = monthly(t.ledger).select("user_id", "category", "spend", "period")
    CL.write_clustered(months.where("spend > 0"), path, "first", "period", ["user_id"])
    for _ in range(2):
        CL.write_clustered(months, path, "second", "period", ["user_id"])
    return CL.read_clustered(t.spark, path).where((F.col("period") >= F.lit("1998-01-01").cast("date")) & (F.col("user_id") > "5"))


@query("survey_quarter_files", "S3 U1 W12", "select NEWID, FINLWT21, REGION from latest", ("latest",))
def survey_quarter_files(t):
    """Writes the units by quarter, with other headers in each, reads them by name and keeps each unit's last record."""
    from tallyspark.operators.survey import latest_units

    folder = TB.scratch_path(t.spark, "survey")
    first = ["NEWID", "FINLWT21", "REGION", "quarter"]
    second = ["REGION as region", "'.' as FAM_SIZE", "quarter as QINTRVMO", "NEWID", "FINLWT21"]
    for quarter, columns in ((1, first), (2, second)):
        TB.write_table(t.units.where(F.col("quarter") == quarter).selectExpr(*columns), f"{folder}/fmli24{quarter}.csv")
    TB.write_table(t.units.selectExpr("NEWID", "1 as COST"), f"{folder}/mtbi241.csv")
    units = SV.read_survey(t.spark, folder, r"^fmli\d+.*\.csv$", schemas.UNITS)
    return latest_units(units, ["source_file"]).select("NEWID", "FINLWT21", "REGION")


@query("survey_code_hierarchy", "S4", "select '1' as level, title, ucc from hg", ("hg",))
def survey_code_hierarchy(t):
    path = TB.scratch_path(t.spark, "hierarchy")
    lines = t.hierarchy.select(F.concat_ws("\t", "level", F.concat(F.lit(" "), "title", F.lit(" ")), "ucc").alias("value"))
    noise = t.table("region").select(F.explode(F.array(F.lit("# note\tx\ty"), F.lit("   "), F.lit("1\tshort"))).alias("value"))
    lines.unionByName(noise).write.mode("overwrite").text(path)
    return SV.read_hierarchy(t.spark, path).select("level", "title", "ucc")


@query("content_fingerprint", "S14", """
select count(*) as n_rows, sum(('0x' || substr(md5(concat_ws('|', l_orderkey::varchar, l_partkey::varchar,
  l_linenumber::varchar, l_returnflag, l_linestatus)), 1, 15))::bigint)::hugeint::varchar as content_hash from lineitem""")
def content_fingerprint(t):
    return TB.fingerprint(
        t.table("lineitem"), ["l_orderkey", "l_partkey", "l_linenumber", "l_returnflag", "l_linestatus"]
    )


@query("latest_retrain_state", "S15", """
select model_type, max(ts) as last_retrain_date, max_by(seq::varchar, (ts, seq::varchar)) as run_id
from status_events group by all""", ("status_events",))
def latest_retrain_state(t):
    return ST.latest_state(retried_state(t))


def retried_state(t):
    """Two commits of runs, each tried twice: the second try appends nothing."""
    path = TB.scratch_path(t.spark, "state")
    runs = t.status_events.selectExpr("model_type", "ts as last_retrain_date", "cast(seq as string) as run_id")
    for half in (0, 1, 0, 1):
        ST.append_once(runs.where(F.col("run_id") % 2 == half), path, f"half {half}")
    return ST.read_state(t.spark, path)


@query("recorded_retrain_runs", "S15", """
select model_type, ts as last_retrain_date, seq::varchar as run_id from status_events""", ("status_events",))
def recorded_retrain_runs(t):
    return retried_state(t)
