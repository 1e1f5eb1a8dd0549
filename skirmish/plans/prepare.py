"""From player rows to one row per team, ready for counting.

Two shuffles of the raw rows in total: by (match, hero) to drop repeated rows, by match to place
players and to see both teams. Everything after that works inside a row of a bounded size (a team
holds each hero once), so contexts and owned items never become a join of the raw data.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skirmish.config import Config
from skirmish.functions import game
from skirmish.operators.dims import ItemModel
from skirmish.operators.rows import first_per_key, max_scalar
from skirmish.session import SMALL_DIM_ROWS, pull_small

FACT_COLUMNS = (
    "match_id", "start_time", "duration", "game_mode", "radiant_win", "patch", "is_radiant", "hero_id", "items", "net_worth",
)


def unique_rows(matches: DataFrame) -> DataFrame:
    """First row per (match, hero) by start time; the other columns make the choice repeatable."""
    order = [F.col("start_time"), F.col("net_worth").desc(), F.col("is_radiant"), F.col("items")]
    return first_per_key(matches, ["match_id", "hero_id"], order)


def match_ranks(ranks: DataFrame) -> DataFrame:
    return ranks.groupBy("match_id").agg(F.max("avg_rank_tier").alias("rank_tier"))


def player_games(
    matches: DataFrame,
    cfg: Config,
    ranks: DataFrame | None = None,
    where: Column | None = None,
    epoch: float | None = None,
    unique_input: bool = False,
) -> DataFrame:
    """One row per player game: bucket, rank group, role, stratum, recency weight, win.

    ``where`` is applied before the choice of the first row, so it reaches the Parquet scan.
    ``unique_input`` skips that choice for sources already free of copies (a retention window).
    """
    source = matches if where is None else matches.where(where)
    source = source.select(*FACT_COLUMNS)
    rows = source if unique_input else unique_rows(source)
    rows = rows.repartition("match_id")
    if ranks is not None:
        rows = rows.join(match_ranks(ranks), "match_id", "left")
    else:
        rows = rows.withColumn("rank_tier", F.lit(None).cast("tinyint"))
    place = F.row_number().over(
        Window.partitionBy("match_id", "is_radiant").orderBy(F.col("net_worth").desc(), F.col("hero_id"))
    )
    newest = None if epoch is not None else max_scalar(source, F.col("start_time"))
    bucket = game.bucket_of(F.col("game_mode"), {23: "turbo"})
    return (
        rows.withColumn("place", place)
        .withColumn("bucket", F.coalesce(bucket, F.lit("normal")))
        .select(
            "match_id",
            "start_time",
            "duration",
            F.col("hero_id").cast("int").alias("hero"),
            "is_radiant",
            "bucket",
            "patch",
            game.rank_group_of(F.col("rank_tier"), cfg.rank_groups).alias("rank_group"),
            game.role_of(F.col("place")).alias("role"),
            game.stratum_of(F.col("bucket"), F.col("duration"), cfg.duration_edges).alias("stratum"),
            game.recency_weight(F.col("start_time"), cfg.half_life_sec, newest, epoch).alias("wt"),
            (F.col("is_radiant") == F.col("radiant_win")).alias("win"),
            F.col("items").cast("array<int>").alias("items"),
        )
    )


# ---- what an inventory counts as -------------------------------------------------------------


def _lookup(model: ItemModel, table: DataFrame, key: str, value: str, dtype: str) -> Column | None:
    """Array literal indexed by item id whose cells are the values of that id; None for a large dimension."""
    rows = pull_small(table.select(key, value), SMALL_DIM_ROWS)
    if rows is None:
        return None
    ids = [r[0] for r in rows]
    if ids and (min(ids) < 0 or max(ids) > SMALL_DIM_ROWS):
        return None
    cells: list[list] = [[] for _ in range(max(ids, default=0) + 1)]
    for i, v in rows:
        cells[i].append(v)
    import json

    text = json.dumps([sorted(c) for c in cells])
    return F.from_json(F.lit(text), f"array<array<{dtype}>>")


def _spread(items: Column, lookup: Column) -> Column:
    """Distinct values of all items of an inventory through an array-literal lookup."""
    cells = F.transform(items, lambda z: F.coalesce(F.get(lookup, z), F.array()))
    return F.array_distinct(F.flatten(cells))


def with_owned(pg: DataFrame, model: ItemModel) -> DataFrame:
    """Adds ``ys`` (answers owned), ``xs`` (key items), ``mechs`` (their mechanics) and ``finals``
    (recipe parts that lie in the inventory as themselves)."""
    keyed = model.key_items.select("x", F.col("x").alias("v"))
    part_rows = model.parts.select(F.col("y").alias("x"), F.col("y").alias("v"))
    lookups = [
        ("ys", _lookup(model, model.expand, "z", "y", "int"), model.expand.toDF("z", "v")),
        ("xs", _lookup(model, keyed, "x", "v", "int"), keyed.toDF("z", "v")),
        ("mechs", _lookup(model, model.x_mech, "x", "mech", "string"), model.x_mech.toDF("z", "v")),
        ("finals", _lookup(model, part_rows, "x", "v", "int"), part_rows.toDF("z", "v")),
    ]
    for name, literal, table in lookups:
        if literal is not None:
            pg = pg.withColumn(name, _spread(F.col("items"), literal))
        else:
            pg = _owned_by_join(pg, name, table)
    return pg


def _owned_by_join(pg: DataFrame, name: str, table: DataFrame) -> DataFrame:
    """The same lookup for an item dimension too large to inline: explode, join, collect per player."""
    keys = ["match_id", "is_radiant", "hero"]
    found = (
        pg.select(*keys, F.explode(F.array_distinct("items")).alias("z"))
        .join(table, "z")
        .groupBy(*keys)
        .agg(F.collect_set("v").alias(name))
    )
    empty = F.array().cast(found.schema[name].dataType)
    return pg.join(found, keys, "left").withColumn(name, F.coalesce(name, empty))


# ---- long tables (one row per fact), for single operators ---------------------------------


def owned_answers(players: DataFrame) -> DataFrame:
    return players.select("match_id", "is_radiant", "hero", F.explode("ys").alias("y"))


def owned_keys(players: DataFrame) -> DataFrame:
    return players.select("match_id", "is_radiant", "hero", F.explode("xs").alias("x"))


# ---- one row per team with its contexts ---------------------------------------------------

LEVELS_ALL = ("hero", "ally", "L1", "L2", "L3")


def _ctx_of(level: str, mine: Column, theirs: Column) -> Column:
    """Distinct context strings a team faces (or holds, for allies) at one level."""
    if level == "hero":
        texts = F.transform(theirs, lambda p: p["hero"].cast("string"))
    elif level == "ally":
        texts = F.transform(mine, lambda p: p["hero"].cast("string"))
    elif level == "L1":
        texts = F.flatten(
            F.transform(theirs, lambda p: F.transform(p["xs"], lambda x: F.concat_ws(":", p["hero"].cast("string"), x.cast("string"))))
        )
    elif level == "L2":
        texts = F.transform(F.flatten(F.transform(theirs, lambda p: p["xs"])), lambda x: x.cast("string"))
    elif level == "L3":
        texts = F.flatten(F.transform(theirs, lambda p: p["mechs"]))
    else:
        raise ValueError(f"unknown context level {level}")
    return F.array_distinct(texts)


def _tagged(level: str, ctxs: Column) -> Column:
    return F.transform(ctxs, lambda c: F.struct(F.lit(level).alias("level"), c.alias("ctx")))


def teams(players: DataFrame, levels: tuple[str, ...]) -> DataFrame:
    """One row per (match, side): the players and, per level, the contexts they played in.

    ``players`` comes partitioned by match from ``player_games``; a match holds each hero once, so
    the collected array is bounded by the hero table.
    """
    card = F.struct("hero", "is_radiant", "role", "rank_group", "win", "ys", "xs", "mechs", "finals")
    same = [F.first(c).alias(c) for c in ("start_time", "duration", "bucket", "patch", "stratum", "wt") if c in players.columns]
    per_match = players.groupBy("match_id").agg(*same, F.collect_list(card).alias("roster"))
    sides = per_match.withColumn("is_radiant", F.explode(F.array(F.lit(True), F.lit(False))))
    split = sides.withColumn(
        "players", F.filter("roster", lambda p: p["is_radiant"] == F.col("is_radiant"))
    ).withColumn("enemies", F.filter("roster", lambda p: p["is_radiant"] != F.col("is_radiant")))
    ctxs = [_tagged(level, _ctx_of(level, F.col("players"), F.col("enemies"))) for level in levels]
    none = F.array().cast("array<struct<level:string,ctx:string>>")
    return (
        split.where(F.size("players") > 0)
        .withColumn("ctxs", F.concat(none, *ctxs))
        .drop("roster", "enemies")
    )


def contexts(team_rows: DataFrame, level: str) -> DataFrame:
    """(match_id, is_radiant, ctx) of one level."""
    return (
        team_rows.select("match_id", "is_radiant", F.explode("ctxs").alias("c"))
        .where(F.col("c.level") == level)
        .select("match_id", "is_radiant", F.col("c.ctx").alias("ctx"))
    )


def dataset_facts(players: DataFrame) -> DataFrame:
    """One row: distinct matches, rows, ranked matches, first and last start, most frequent patch."""
    per_patch = players.groupBy("patch").agg(F.count("*").alias("c"))
    patch = per_patch.agg(F.max_by("patch", F.struct("c", "patch")).alias("p")).scalar()
    per_match = players.groupBy("match_id").agg(
        F.count("*").alias("rows"),
        F.max(F.col("rank_group").isNotNull()).alias("ranked"),
        F.min("start_time").alias("first_start"),
        F.max("start_time").alias("last_start"),
    )
    return per_match.agg(
        F.count("*").alias("matches"),
        F.sum("rows").alias("player_rows"),
        F.count_if("ranked").alias("ranked"),
        F.min("first_start").alias("first_start"),
        F.max("last_start").alias("last_start"),
    ).withColumn("patch", patch)


def matches_per_bucket(players: DataFrame) -> DataFrame:
    return players.groupBy("bucket", "match_id").agg(F.lit(1).alias("one")).groupBy("bucket").agg(F.count("*").alias("matches"))
