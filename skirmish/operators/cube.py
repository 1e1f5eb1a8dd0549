"""Count cube of games and wins, its pruning and rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TABLES = ("hero", "pair", "trait_games", "item_games", "base", "vs_hero", "vs_trait", "vs_item", "length")
SHORT_SEC, LONG_SEC = 30 * 60, 40 * 60


def length_kind(duration: Column) -> Column:
    return F.when(duration < SHORT_SEC, "short").when(duration > LONG_SEC, "long")


def count_cube(players: DataFrame) -> DataFrame:
    """All tables of the cube as rows (table, bucket, hero, ctx, item, games, wins), in one pass.

    ``players``: bucket, hero, win, duration, answers array (own answer items), enemies array,
    enemy_traits array, enemy_items array (each distinct per player). A player emits one entry per
    (context or none) x (item or none); partial aggregation folds them before the shuffle.
    """

    def entries(table: str, values: Column) -> Column:
        return F.transform(values, lambda v: F.struct(F.lit(table).alias("t"), v.cast("string").alias("c")))

    def entry(table: str, value: Column) -> Column:
        return F.array(F.struct(F.lit(table).alias("t"), value.alias("c")))

    ctx = F.concat(
        entry("none", F.lit("")), entries("hero", F.col("enemies")), entries("trait", F.col("enemy_traits")), entries("item", F.col("enemy_items"))
    )
    kind = length_kind(F.col("duration"))
    own = F.when(kind.isNotNull(), F.concat("ctx", entry("length", kind))).otherwise(F.col("ctx"))
    wide = players.withColumn("ctx", ctx).select("bucket", "hero", "win", "answers", "ctx", own.alias("own"))
    # Arrays are made once for a player; names and texts of items once for a cell.
    one = wide.select("bucket", "hero", "win", "ctx", "own", F.explode(F.concat(F.array(F.lit(None).cast("int")), "answers")).alias("y"))
    cells = one.select("bucket", "hero", "win", "y", F.explode(F.when(F.col("y").isNull(), F.col("own")).otherwise(F.col("ctx"))).alias("x"))
    cells = cells.groupBy("bucket", "hero", F.col("x.t").alias("t"), F.col("x.c").alias("ctx"), "y").agg(
        F.count("*").alias("games"), F.count_if("win").alias("wins")
    )
    with_item = F.col("y").isNotNull()
    name = (
        F.when((F.col("t") == "none") & with_item, "base").when(F.col("t") == "none", "hero").when(F.col("t") == "length", "length")
        .when(with_item, F.concat(F.lit("vs_"), "t"))
        .when(F.col("t") == "hero", "pair").otherwise(F.concat("t", F.lit("_games")))
    )
    return cells.select(name.alias("table"), "bucket", "hero", "ctx", F.coalesce(F.col("y").cast("string"), F.lit("")).alias("item"), "games", "wins")


def farm(players: DataFrame) -> DataFrame:
    """(bucket, hero, games, places): sum of net-worth places; the mean is the farm rank."""
    return players.groupBy("bucket", "hero").agg(F.count("*").alias("games"), F.sum("place").cast("bigint").alias("places"))


def prune(cube: DataFrame, min_games: int) -> DataFrame:
    return cube.where(F.col("games") >= min_games)


def rates(farm_rows: DataFrame, cube: DataFrame) -> DataFrame:
    """(bucket, hero, farm_rank, winrate)."""
    hero = cube.where("table = 'hero'").select("bucket", "hero", F.col("games").alias("g"), F.col("wins").alias("w"))
    return farm_rows.join(hero, ["bucket", "hero"], "left").select(
        "bucket", "hero", F.try_divide("places", "games").alias("farm_rank"), F.try_divide(F.col("w") * 100.0, F.col("g")).alias("winrate")
    )


def with_reset(state: DataFrame, version: int, patch: str) -> DataFrame:
    """State rows keyed by version and patch: another key starts empty."""
    return state.where((F.col("version") == version) & (F.col("patch") == patch))
