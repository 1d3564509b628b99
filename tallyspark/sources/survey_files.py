"""Survey files: quarterly CSVs and the tab-separated code hierarchy."""

from __future__ import annotations

import csv
import functools

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T


def _matching(path: Column, pattern: str) -> Column:
    """The file's name, or that of the folder it is a part of, if it matches; else null."""
    names = F.slice(F.split(path, "/"), -2, 2)
    return F.try_element_at(F.filter(names, lambda n: n.rlike(f"(?i){pattern}")), F.lit(-1))


def _file_path() -> Column:
    """The path of a row's file as it is written; the metadata have it as a URI."""
    return F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))


def read_survey(spark: SparkSession, folder: str, pattern: str, schema: T.StructType) -> DataFrame:
    """All CSVs below ``folder`` whose name matches a regex (any case), as one table with the columns of ``schema``.

    A quarter may be one file or a folder of part files. Columns are found by the header of each file, in any order and case,
    among any others; one that a file lacks is null there, as is a value that its type cannot hold. Files are scanned
    together by header. ``source_file`` is the matching name: quarters are named in time order, so it tells which of two
    records of a unit is the later one. An error if no file of that name has any content.
    """
    listing = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.[cC][sS][vV]")
        .load(folder)
        .select("path")
    )
    # File names and headers only: one short row per quarter file.
    paths = [r.path for r in listing.where(_matching(F.col("path"), pattern).isNotNull()).orderBy("path").collect()]
    if not paths:
        raise ValueError(f"no files matching {pattern!r} in {folder}")
    lines = spark.read.text(paths).select(
        _file_path().alias("path"), "value", F.monotonically_increasing_id().alias("at"),
        F.col("_metadata.file_block_start").alias("block"),
    )
    heads = lines.where("block = 0").groupBy("path").agg(F.min_by("value", "at").alias("head")).orderBy("path").collect()
    by_head: dict[str, list[str]] = {}
    for row in heads:
        by_head.setdefault(row.head.lstrip("\ufeff"), []).append(row.path)
    return functools.reduce(
        DataFrame.unionAll, [_scan(spark, group, next(csv.reader([head])), pattern, schema) for head, group in by_head.items()]
    )


def _scan(spark: SparkSession, paths: list[str], head: list[str], pattern: str, schema: T.StructType) -> DataFrame:
    """Files with one header; only the columns of the schema are parsed."""
    place: dict[str, int] = {}
    for i, name in enumerate(head):
        place.setdefault(name.strip().lower(), i)
    text = T.StructType([T.StructField(f"_{i}", T.StringType()) for i in range(len(head))])
    wanted = [
        (F.col(f"_{place[f.name.lower()]}").try_cast(f.dataType) if f.name.lower() in place else F.lit(None).cast(f.dataType)).alias(f.name)
        for f in schema.fields
    ]
    rows = spark.read.option("header", True).schema(text).csv(paths)
    return rows.select(*wanted, _matching(_file_path(), pattern).alias("source_file"))


def read_hierarchy(spark: SparkSession, path: str) -> DataFrame:
    """Lines ``level<TAB>title<TAB>ucc``; blank lines, ``#`` lines and short lines are skipped."""
    # Java's trim, like Python's strip, also removes tabs at the ends of the line.
    line = F.regexp_replace("value", r"^\s+|\s+$", "")
    parts = F.split("line", "\t")
    return (
        spark.read.text(path)
        .select(line.alias("line"), F.col("_metadata.file_name").alias("f"),
                F.monotonically_increasing_id().alias("line_no"))
        .where((F.length("line") > 0) & ~F.col("line").startswith("#") & (F.size(parts) >= 3))
        .select(
            F.trim(parts[0]).alias("level"), F.trim(parts[1]).alias("title"),
            F.trim(parts[2]).alias("ucc"), "line_no",
        )
    )
