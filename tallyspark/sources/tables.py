"""Tables in files: load by extension, check columns, write, fingerprint."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Fail on the plan, without running it, when a column is missing."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def read_table(
    spark: SparkSession,
    path: str,
    schema: T.StructType | None = None,
    required: Sequence[str] = (),
) -> DataFrame:
    """Parquet or CSV by extension. CSV needs a schema."""
    bare = path.rstrip("/")
    if bare.endswith(".parquet"):
        reader = spark.read if schema is None else spark.read.schema(schema)
        df = reader.parquet(path)
    elif bare.endswith(".csv"):
        if schema is None:
            raise ValueError("a CSV table needs a schema")
        df = spark.read.option("header", True).schema(schema).csv(path)
    else:
        raise ValueError(f"unsupported format: {path}")
    return require_columns(df, required)


def path_exists(spark: SparkSession, path: str) -> bool:
    """True when the path exists on whatever file system its URI names."""
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop_path)


def read_feedback(spark: SparkSession, path: str | None, schema: T.StructType) -> DataFrame:
    """Feedback from a file; no path or no file gives an empty table with the schema."""
    if not path or not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    return read_table(spark, path, schema)


def read_jdbc(spark: SparkSession, url: str, table: str, split_on: str | None = None,
              bounds: tuple | None = None, partitions: int = 64, **properties: str) -> DataFrame:
    """A database table; filters and columns of later steps are pushed into its scan.

    ``split_on`` with ``bounds`` reads in parallel ranges of a numeric or date column.
    """
    options = {"url": url, "dbtable": table, "fetchsize": "10000", **properties}
    if split_on is not None:
        low, high = bounds
        options |= {
            "partitionColumn": split_on, "lowerBound": str(low), "upperBound": str(high),
            "numPartitions": str(partitions),
        }
    return spark.read.format("jdbc").options(**options).load()


def write_table(
    df: DataFrame, path: str, fmt: str | None = None, partition_by: Sequence[str] = (), mode: str = "overwrite"
) -> str:
    """Parquet, CSV with header, or JSON; the format comes from the extension unless given.

    ``path`` may be any URI Spark can write, an object store included.
    """
    if fmt is None:
        tail = path.rstrip("/").rsplit(".", 1)[-1]
        fmt = tail if tail in ("parquet", "json") else "csv"
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)
    return path


#: Rows of one task where a shuffle is followed by groups that are about as many as its rows.
TASK_ROWS = 1 << 18


def tasks_for(spark: SparkSession, rows: int) -> int:
    """Tasks for a shuffle of so many rows: their size stays the same however large the table is."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // TASK_ROWS))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in ``spark.checkpoint.dir``, or below the warehouse if that is unset; all executors share both."""
    base = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/_staging"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts the lineage, survives executors."""
    path = path or scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fingerprint(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row: row count and an order-insensitive content hash.

    The hash adds up the 60-bit md5 prefixes of the rows, so it needs no sort and copies count.
    """
    columns = list(columns or df.columns)
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in columns])
    part = F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint").cast("decimal(19,0)")
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.coalesce(F.sum(part), F.lit(0).cast("decimal(29,0)")).cast("string").alias("content_hash"),
    )
