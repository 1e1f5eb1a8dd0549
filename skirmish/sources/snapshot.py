"""Published tables in folders of their own and a log that names the complete ones; readers take the newest.

Publishing writes the tables under a new name and then appends one row to the log. What fails before that row is never
seen and never written over. One writer at a time.
"""

from __future__ import annotations

import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG = "generation long, folder string, manifest string"


def generations(spark: SparkSession, root: str) -> DataFrame | None:
    """The log: a row for each complete generation; None before the first."""
    try:
        return spark.read.schema(LOG).parquet(f"{root}/log")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def newest(spark: SparkSession, root: str) -> tuple[str, dict] | None:
    """(folder, manifest) of the newest complete generation."""
    log = generations(spark, root)
    row = None if log is None else log.orderBy(F.desc("generation")).first()
    return None if row is None else (f"{root}/{row['folder']}", json.loads(row["manifest"]) | {"generation": row["generation"]})


def resolve(spark: SparkSession, root: str) -> str | None:
    found = newest(spark, root)
    return found and found[0]


def write_tables(tables: dict[str, DataFrame], root: str) -> str:
    """The tables under a name that nothing else has; nobody reads them before the log names it."""
    folder = f"data/{uuid.uuid4().hex}"
    for name, df in tables.items():
        df.write.option("compression", "zstd").parquet(f"{root}/{folder}/{name}")
    return folder


def publish(spark: SparkSession, root: str, tables: dict[str, DataFrame], manifest: dict) -> str:
    """Write the tables, then their row of the log."""
    folder = write_tables(tables, root)
    before = newest(spark, root)
    row = (1 + (before[1]["generation"] if before else 0), folder, json.dumps(manifest, ensure_ascii=False, sort_keys=True))
    spark.createDataFrame([row], LOG).coalesce(1).write.mode("append").parquet(f"{root}/log")
    return f"{root}/{folder}"


def file_sizes(spark: SparkSession, path: str) -> DataFrame:
    """(name, size) of the files of a folder; their contents are not read."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"))


def digests(spark: SparkSession, path: str) -> DataFrame:
    """(name, size, sha256) of the files of a folder, hashed where they are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(
        F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256")
    )


def verify(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """(name, problem) of files that are missing, extra or differ in size or hash."""
    a = actual.select("name", F.col("size").alias("a_size"), F.col("sha256").alias("a_sha"))
    e = expected.select("name", F.col("size").alias("e_size"), F.col("sha256").alias("e_sha"))
    problem = (
        F.when(F.col("a_sha").isNull(), "missing")
        .when(F.col("e_sha").isNull(), "extra")
        .when(F.col("a_size") != F.col("e_size"), "size")
        .when(F.col("a_sha") != F.col("e_sha"), "hash")
    )
    return a.join(e, "name", "full").select("name", problem.alias("problem")).where(F.col("problem").isNotNull())


def newest_valid(snapshots: DataFrame, problems: DataFrame) -> DataFrame:
    """The candidate with the latest ``generated_at`` that has no validation problem."""
    good = snapshots.join(problems.select("path").distinct(), "path", "left_anti")
    return good.groupBy().agg(F.max_by("path", F.struct("generated_at", "path")).alias("path")).where(F.col("path").isNotNull())
