"""Served answers as one slice per hero, and their coded / nested forms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skirmish.schemas import SLICE
from skirmish.session import small_table

# Positions are the codes of the stored rows.
CONF_CODES = ("low", "mid", "high")


def common_roles(table: DataFrame, role_shares: DataFrame, min_share: float) -> DataFrame:
    """Drop the rows of roles a hero is rarely played in."""
    kept = role_shares.where(F.col("share") >= min_share).select("bucket", F.col("hero").cast("string").alias("hero"), "role")
    return table.withColumn("hero", F.col("hero").cast("string")).join(kept, ["bucket", "hero", "role"], "left_semi")


def write_slices(tables: dict[str, DataFrame], path: str) -> None:
    """All answer tables in one dataset, a folder per hero, one shuffle by hero."""
    union = None
    for name, df in tables.items():
        part = df.withColumn("table", F.lit(name))
        union = part if union is None else union.unionByName(part, allowMissingColumns=True)
    union.repartition("hero", "table").sortWithinPartitions("hero", "table", "bucket", "role", "ctx", "place").write.option(
        "compression", "zstd"
    ).partitionBy("hero").parquet(path)


def read_slice(spark: SparkSession, path: str, hero: str, schema: str = SLICE) -> DataFrame:
    """One hero's slice: only that folder is read."""
    return read_all(spark, path, schema).where(F.col("hero") == hero)


def read_all(spark: SparkSession, path: str, schema: str = SLICE) -> DataFrame:
    """Every slice. Tables without a row leave no folder and no file, so the columns are named here."""
    return spark.read.schema(schema).parquet(path)


def encode(rows: DataFrame, sources: Sequence[str]) -> DataFrame:
    """Replace confidence and source by their positions in the code lists."""
    spark = rows.sparkSession
    conf = small_table(spark, [(c, i) for i, c in enumerate(CONF_CODES)], "conf string, conf_code int")
    src = small_table(spark, [(s, i) for i, s in enumerate(sources)], "source string, source_code int")
    return rows.join(conf, "conf", "left").join(src, "source", "left").drop("conf", "source")


def decode(rows: DataFrame, sources: Sequence[str]) -> DataFrame:
    spark = rows.sparkSession
    conf = small_table(spark, [(c, i) for i, c in enumerate(CONF_CODES)], "conf string, conf_code int")
    src = small_table(spark, [(s, i) for i, s in enumerate(sources)], "source string, source_code int")
    return rows.join(conf, "conf_code", "left").join(src, "source_code", "left").drop("conf_code", "source_code")


def nested_json(rows: DataFrame) -> DataFrame:
    """(bucket, role, hero, answers): JSON text {context: [[item, S, A, B, conf, games, source], ...]}.

    Rows of one (hero, context) are at most the top-N kept by the ranking.
    """
    cell = F.array(*[F.col(c).cast("double") for c in ("y", "score", "a_pp", "b_pp", "conf_code", "games", "source_code")])
    per_ctx = rows.groupBy("bucket", "role", "hero", "ctx").agg(F.sort_array(F.collect_list(F.struct("place", cell.alias("r")))).alias("r"))
    entry = F.struct("ctx", F.transform("r", lambda x: x["r"]).alias("rows"))
    return per_ctx.groupBy("bucket", "role", "hero").agg(
        F.to_json(F.map_from_entries(F.sort_array(F.collect_list(entry)))).alias("answers")
    )
