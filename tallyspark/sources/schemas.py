"""Declared schemas; jobs never infer one."""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {
    "string": T.StringType(), "bigint": T.LongType(), "int": T.IntegerType(),
    "double": T.DoubleType(), "timestamp_ntz": T.TimestampNTZType(),
}


def _schema(**fields: str) -> T.StructType:
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in fields.items()])


LEDGER = _schema(
    transaction_id="bigint", user_id="string", description="string", amount="double",
    transaction_date="timestamp_ntz", category_name="string",
)
LEDGER_REQUIRED = ("user_id", "category_name", "amount", "transaction_date")

UNITS = _schema(
    NEWID="string", FINLWT21="double", FINCBTXM="double", FAM_SIZE="int", AGE_REF="int",
    REGION="int", CUTENURE="int",
)
ITEMS = _schema(NEWID="string", UCC="string", COST="string", REFYR="int", REFMO="int")
HIERARCHY = _schema(level="string", title="string", ucc="string")

TEXT_FEEDBACK = _schema(
    feedback_id="bigint", user_id="string", transaction_id="bigint", description="string",
    amount="double", predicted_category="string", actual_category="string",
    feedback_type="string", created_at="timestamp_ntz",
)
TREND_FEEDBACK = _schema(
    feedback_id="bigint", user_id="string", category_name="string", anomaly_score="double",
    predicted_spend="double", actual_spend="double", feedback_type="string",
    created_at="timestamp_ntz",
)
RETRAIN_STATE = _schema(model_type="string", last_retrain_date="timestamp_ntz", run_id="string")
