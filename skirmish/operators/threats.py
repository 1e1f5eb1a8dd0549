"""Threat scores of enemies: served form, count-cube form, and the catalogue form."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skirmish.config import ThreatConfig
from skirmish.functions.stats import expected_place, round_places


def threat_profile(roles: DataFrame, late: DataFrame) -> DataFrame:
    """(bucket, hero, core, offlane, support, main_role, late, n_late, n_early), one row per hero."""
    share = {r: F.coalesce(F.max(F.when(F.col("role") == r, F.col("share"))), F.lit(0.0)).alias(r) for r in ("core", "offlane", "support")}
    wide = roles.groupBy("bucket", "hero").agg(*share.values(), F.max_by("role", F.struct("share", "role")).alias("main_role"))
    return wide.join(late, ["bucket", "hero"], "left")


def rank_threats(asks: DataFrame, profile: DataFrame, matchups: DataFrame, cfg: ThreatConfig) -> DataFrame:
    """Enemies of each request by danger. ``asks``: request, bucket, my_hero, enemy.

    Late strength counts only as an addition and only for heroes that farm.
    """
    p = profile.withColumnRenamed("hero", "enemy")
    m = matchups.select("bucket", "enemy", F.col("hero").alias("my_hero"), F.round(F.col("delta") * 100, 2).alias("vs_pp"), F.col("n").alias("vs_n"))
    j = asks.join(p, ["bucket", "enemy"], "left").join(m, ["bucket", "enemy", "my_hero"], "left")
    farm = expected_place(F.col("core"), F.col("offlane"), F.col("support"))
    late_pp = F.when(F.least(F.round("n_late"), F.round("n_early")) >= cfg.min_length_games, F.round(F.col("late") * 100, 2))
    vs = F.when(F.round("vs_n") >= cfg.min_pair_games, F.col("vs_pp"))
    score = (
        F.coalesce(cfg.w_farm * (3.0 - farm), F.lit(0.0))
        + F.coalesce(cfg.w_late * F.greatest(F.lit(0.0), late_pp) * (F.col("core") + F.col("offlane")), F.lit(0.0))
        + F.coalesce(-cfg.w_matchup * vs, F.lit(0.0))
    )
    role = F.when((F.col("main_role") == "core") & (farm <= cfg.carry_rank), "carry").otherwise(F.coalesce("main_role", F.lit("core")))
    reasons = F.array_compact(
        F.array(role, F.when(late_pp >= cfg.late_notable, "late"), F.when(-vs >= cfg.matchup_notable, "matchup"))
    )
    scored = j.select("request", "enemy", F.round(score, 2).alias("score"), F.concat_ws(",", reasons).alias("reasons"))
    order = Window.partitionBy("request").orderBy(F.col("score").desc(), "enemy")
    return scored.withColumn("place", F.row_number().over(order))


def cube_threats(asks: DataFrame, cube: DataFrame, farm: DataFrame, cfg: ThreatConfig, digits: int = 2) -> DataFrame:
    """The same question from plain counts: farm place, late gain, my record, win rate.

    The score is rounded once, to ``digits`` places: rounding it again to fewer would carry a rounded five upwards.
    """

    def wr(n: str, w: str):
        return F.when(F.col(n) > 0, F.col(w) * 100.0 / F.col(n))

    hero = cube.where("table = 'hero'").select("bucket", F.col("hero").alias("enemy"), F.col("games").alias("g"), F.col("wins").alias("gw"))
    sides = cube.where("table = 'length'").groupBy("bucket", F.col("hero").alias("enemy")).agg(
        *[F.max(F.when(F.col("ctx") == k, F.col(c))).alias(f"{k}_{c}") for k in ("short", "long") for c in ("games", "wins")]
    )
    pair = cube.where("table = 'pair'").select("bucket", F.col("hero").alias("my_hero"), F.col("ctx").cast("int").alias("enemy"), F.col("games").alias("p"), F.col("wins").alias("pw"))
    place = farm.select("bucket", F.col("hero").alias("enemy"), F.try_divide("places", "games").alias("farm"))
    j = asks.join(hero, ["bucket", "enemy"], "left").join(sides, ["bucket", "enemy"], "left").join(place, ["bucket", "enemy"], "left").join(
        pair, ["bucket", "my_hero", "enemy"], "left"
    )
    enough = (F.col("short_games") >= cfg.min_length_games) & (F.col("long_games") >= cfg.min_length_games)
    late = F.when(enough, wr("long_games", "long_wins") - wr("short_games", "short_wins"))
    mine = F.when(F.col("p") >= cfg.min_pair_games, wr("p", "pw"))
    parts = [cfg.w_farm * (3.0 - F.col("farm")), cfg.w_late * late, cfg.w_matchup * (50 - mine), cfg.w_winrate * (wr("g", "gw") - 50)]
    score = sum((F.coalesce(p, F.lit(0.0)) for p in parts), F.lit(0.0))
    role = F.when(F.col("farm") <= cfg.carry_rank, "carry").when(F.col("farm") <= cfg.core_rank, "core").when(F.col("farm").isNotNull(), "support")
    reasons = F.array_compact(F.array(role, F.when(late >= cfg.late_notable, "late"), F.when(mine <= 50 - cfg.matchup_notable, "matchup")))
    scored = j.select("request", "enemy", round_places(score, digits).alias("score"), F.concat_ws(",", reasons).alias("reasons"))
    return scored.withColumn("place", F.row_number().over(Window.partitionBy("request").orderBy(F.col("score").desc(), "enemy")))


def catalogue_score(rows: DataFrame, weights: dict[str, float], support_multiplier: float, reason_winrate_min: float) -> DataFrame:
    """Score from catalogue win rates: ``wr``, ``mine`` (null when unknown), ``is_core``, ``is_support``."""
    a = weights["winrate"] * F.coalesce(F.col("wr") - 50, F.lit(0.0))
    b = F.when(F.col("is_core"), weights["core"]).otherwise(0.0)
    c = weights["matchup"] * F.coalesce(50 - F.col("mine"), F.lit(0.0))
    total = (a + b + c) * F.when(F.col("is_support"), support_multiplier).otherwise(1.0)
    reason = F.when(c > F.greatest(a, F.lit(0.0)), "matchup").when(F.col("wr") >= reason_winrate_min, "winrate").otherwise("core")
    return rows.withColumns({"score": F.round(total, 2), "reason": reason})
