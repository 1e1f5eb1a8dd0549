"""Readers and writers of match facts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skirmish.functions import game
from skirmish.operators.asof import effective_name
from skirmish.schemas import MATCH_PLAYER, RANK, RAW_MATCH

INVENTORY = [f"item_{i}" for i in range(6)] + [f"backpack_{i}" for i in range(3)]


def read_matches(spark: SparkSession, path: str | list[str], where: Column | None = None) -> DataFrame:
    """Match-player rows; ``where`` reaches the Parquet scan."""
    df = spark.read.schema(MATCH_PLAYER).parquet(*([path] if isinstance(path, str) else path))
    return df if where is None else df.where(where)


def read_ranks(spark: SparkSession, path: str | None) -> DataFrame:
    """The optional rank table; an empty typed table when there is none."""
    if path is None:
        return spark.createDataFrame([], RANK)
    return spark.read.schema(RANK).parquet(path)


def read_with_file(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Match rows with the name of the file they came from."""
    df = spark.read.schema(MATCH_PLAYER).parquet(*([path] if isinstance(path, str) else path))
    return df.select("*", F.col("_metadata.file_path").alias("filename"))


def read_by_name(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Files with different column sets, matched by name; absent columns become null."""
    return spark.read.option("mergeSchema", "true").parquet(*paths)


def match_ids(matches: DataFrame) -> DataFrame:
    return matches.select("match_id").distinct()


def read_match_json(spark: SparkSession, path: str, keep_broken: bool = False) -> DataFrame:
    """One match per line. Broken lines are dropped, or counted through ``_corrupt_record``."""
    schema = RAW_MATCH + (", _corrupt_record string" if keep_broken else "")
    mode = "PERMISSIVE" if keep_broken else "DROPMALFORMED"
    return spark.read.schema(schema).option("mode", mode).json(path)


def eligible(
    matches: DataFrame,
    modes: dict[int, str] = game.MODE_BUCKETS,
    min_duration: dict[str, int] | int = game.MIN_DURATION_SEC,
    players: int = 10,
) -> DataFrame:
    """Matches of a known mode, full, long enough, without leavers and with every hero known."""
    df = matches.withColumn("bucket", game.bucket_of(F.col("game_mode"), modes))
    floor = F.lit(min_duration) if isinstance(min_duration, int) else game.by_bucket(F.col("bucket"), min_duration)
    bad = F.exists(
        "players",
        lambda p: (F.coalesce(p["leaver_status"], F.lit(0)) > 1) | (F.coalesce(p["hero_id"], F.lit(0)) == 0),
    )
    return df.where(
        F.col("bucket").isNotNull()
        & (F.coalesce(F.size("players"), F.lit(0)) == players)
        & (F.coalesce("duration", F.lit(0)) >= floor)
        & ~bad
    )


def player_rows(matches: DataFrame, patches: DataFrame, players: int = 10) -> DataFrame:
    """JSON matches to typed player rows. Works the same on a stream of matches."""
    kept = effective_name(eligible(matches, players=players), "start_time", patches, "patch_name")
    one = kept.withColumn("p", F.explode("players"))
    p = {name: F.col(f"p.{name}") for name in ("player_slot", "hero_id", "item_neutral", "net_worth", *INVENTORY)}
    return one.select(
        "match_id",
        F.coalesce("start_time", F.lit(0)).cast("int").alias("start_time"),
        game.clamp(F.col("duration"), 32767, "smallint").alias("duration"),
        F.col("game_mode").cast("tinyint").alias("game_mode"),
        F.coalesce("lobby_type", F.lit(0)).cast("tinyint").alias("lobby_type"),
        F.coalesce("radiant_win", F.lit(False)).alias("radiant_win"),
        F.col("patch_name").alias("patch"),
        game.side_of_slot(p["player_slot"]).alias("is_radiant"),
        p["hero_id"].cast("smallint").alias("hero_id"),
        game.compact_items([p[c] for c in INVENTORY]).cast("array<smallint>").alias("items"),
        F.coalesce(p["item_neutral"], F.lit(0)).cast("smallint").alias("item_neutral"),
        F.coalesce(p["net_worth"], F.lit(0)).cast("int").alias("net_worth"),
        game.clamp(F.col("p.gold_per_min"), 32767, "smallint").alias("gold_per_min"),
        game.clamp(F.col("p.xp_per_min"), 32767, "smallint").alias("xp_per_min"),
        game.clamp(F.col("p.kills"), 127, "tinyint").alias("kills"),
        game.clamp(F.col("p.deaths"), 127, "tinyint").alias("deaths"),
        game.clamp(F.col("p.assists"), 127, "tinyint").alias("assists"),
        game.clamp(F.col("p.last_hits"), 32767, "smallint").alias("last_hits"),
    )


def write_facts(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("compression", "zstd").partitionBy(*partition_by).parquet(path)


def write_chunks(matches: DataFrame, chunks: DataFrame, path: str) -> None:
    """Rows sorted inside files of a fixed number of matches (``chunks``: match_id, part)."""
    order = ["start_time", "match_id", "is_radiant", "hero_id"]
    (
        matches.join(chunks, "match_id")
        .repartition("part")
        .sortWithinPartitions("part", *order)
        .write.option("compression", "zstd")
        .partitionBy("part")
        .parquet(path)
    )
