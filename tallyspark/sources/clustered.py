"""Tables in versions: files clustered by month and key below one folder, committed by a manifest.

``<path>/data/<run>`` holds the files of a run, ``<path>/manifest/<version>-<run>`` its commit. A run counts once Spark has
marked its manifest complete, which is written last: readers see a whole version or none, and a job that is tried again after
its commit writes nothing. The folder may be any URI Spark can write; nothing is renamed.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

MANIFEST = "version bigint, run_id string, folder string, n_rows bigint, table_schema string"


def _tag(run_id: str) -> str:
    return hashlib.sha256(run_id.encode()).hexdigest()[:32]


def committed(spark: SparkSession, path: str) -> list[str]:
    """Names of the complete manifests, oldest version first: one short name per version still kept."""
    jvm = spark.sparkContext._jvm
    pattern = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/manifest/*/_SUCCESS")
    found = pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(pattern)
    return sorted(status.getPath().getParent().getName() for status in found or [])


def write_clustered(
    df: DataFrame, path: str, run_id: str, partition: str, by: Sequence[str], files: int | None = None,
    group_bytes: int = 64 << 20,
) -> int:
    """Write a new version and commit it; the number of the version. A run that is committed already is not written again.

    Rows are ranged by (``partition``, ``by``, a hash of the row), so that a partition with very many rows is spread over as
    many files as its share, and sorted by ``by``: the statistics of row groups of ``group_bytes`` hold narrow ranges. ``files``
    is the number of ranges, that of the session's shuffle partitions if not given. Two runs that commit at the same time get
    the same number; the one with the greater name is the latest.
    """
    spark, path, tag = df.sparkSession, path.rstrip("/"), _tag(run_id)
    names = committed(spark, path)
    for name in names:
        if name.endswith(tag):
            return int(name.split("-")[0])
    spread = [partition, *by, F.xxhash64(*df.columns)]
    ranged = df.repartitionByRange(*spread) if files is None else df.repartitionByRange(files, *spread)
    folder = f"{path}/data/{tag}"
    ranged.sortWithinPartitions(partition, *by).write.mode("overwrite").partitionBy(partition).option(
        "parquet.block.size", group_bytes
    ).parquet(folder)
    version = int(names[-1].split("-")[0]) + 1 if names else 1
    entry = (version, run_id, f"data/{tag}", spark.read.schema(df.schema).parquet(folder).count(), df.schema.json())
    manifest = spark.createDataFrame([entry], MANIFEST).coalesce(1)
    manifest.write.mode("overwrite").json(f"{path}/manifest/{version:010d}-{tag}")
    return version


def manifest(spark: SparkSession, path: str, version: int | None = None) -> T.Row:
    """The manifest row of a version, of the latest one if none is given."""
    names = [n for n in committed(spark, path) if version in (None, int(n.split("-")[0]))]
    if not names:
        raise ValueError(f"no committed version in {path}")
    return spark.read.schema(MANIFEST).json(f"{path.rstrip('/')}/manifest/{names[-1]}").first()


def read_clustered(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The latest version, or the given one. Filters on the partition column prune folders before files are listed in the
    scan; filters on the clustered columns skip row groups by their statistics."""
    entry = manifest(spark, path, version)
    schema = T.StructType.fromJson(json.loads(entry.table_schema))
    return spark.read.schema(schema).parquet(f"{path.rstrip('/')}/{entry.folder}").select(*schema.names)
