"""Recommenders over the count cube: frequency uplift, and tiered win-rate advice."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skirmish.config import UpliftConfig
from skirmish.functions.stats import share_uplift, winrate_harmful


def _cells(cube: DataFrame, table: str) -> DataFrame:
    return cube.where(F.col("table") == table).select("bucket", "hero", "ctx", "item", F.col("games").alias("n"), F.col("wins").alias("w"))


def uplift_scores(asks: DataFrame, cube: DataFrame, cfg: UpliftConfig) -> DataFrame:
    """Best significant buy-share gain of every asked (request, threat, item).

    ``asks``: request, bucket, hero, threat, item, and ``contexts`` array<struct<tier, table, total, ctx>>
    naming the cells to look at. Rows: asks plus score, tier, delta, games; harmful items are gone.
    """
    hero = _cells(cube, "hero").select("bucket", "hero", F.col("n").alias("hero_n"))
    base = _cells(cube, "base").select("bucket", "hero", "item", F.col("n").alias("base_n"), F.col("w").alias("base_w"))
    known = asks.join(hero, ["bucket", "hero"], "left").join(base, ["bucket", "hero", "item"], "left").fillna(
        0, ["hero_n", "base_n", "base_w"]
    )
    share = F.coalesce(F.try_divide(F.col("base_n"), F.col("hero_n")), F.lit(0.0))
    bought = known.withColumn("base_share", share).where(
        (F.col("base_share") >= cfg.min_buy_share) & (F.col("base_n") >= cfg.min_base_games)
    )
    looks = bought.withColumn("c", F.explode_outer("contexts"))
    looks = looks.withColumns({"table": F.col("c.table"), "total": F.col("c.total"), "ctx": F.col("c.ctx"), "tier": F.col("c.tier")})
    cell = cube.select("table", "bucket", "hero", "ctx", "item", F.col("games").alias("cell_n"), F.col("wins").alias("cell_w"))
    games = cube.where(F.col("item") == "").select(F.col("table").alias("total"), "bucket", "hero", "ctx", F.col("games").alias("ctx_n"))
    found = (
        looks.join(cell, ["table", "bucket", "hero", "ctx", "item"], "left")
        .join(games, ["total", "bucket", "hero", "ctx"], "left")
        .fillna(0, ["cell_n", "cell_w", "ctx_n"])
    )
    harmful = winrate_harmful(F.col("cell_n"), F.col("cell_w"), F.col("base_n"), F.col("base_w"), cfg.z, cfg.wr_filter_games)
    delta, low = share_uplift(F.col("cell_n"), F.when(F.col("ctx_n") > 0, F.col("ctx_n")), F.col("base_share"), cfg.z)
    good = (F.col("ctx_n") >= cfg.min_pair_games) & (low > 0)
    order = F.when(F.col("tier") == "hero", 0).when(F.col("tier") == "item", 1).otherwise(2)
    pick = F.when(good, F.struct((-low).alias("o"), order.alias("t"), F.col("ctx").alias("x"), low.alias("low"), "tier", delta.alias("delta"), F.col("ctx_n").alias("games")))
    keys = ["request", "bucket", "hero", "threat", "item", "base_share", "base_n"]
    best = found.groupBy(*keys).agg(F.max(harmful).alias("bad"), F.min(pick).alias("best"))
    return best.where(~F.col("bad")).select(
        "request", "bucket", "hero", "threat", "item",
        F.coalesce("best.low", F.col("base_share") - 1.0).alias("score"),
        F.coalesce("best.tier", F.lit("mechanic")).alias("tier"), "best.delta", F.coalesce("best.games", F.lit(0)).alias("games"),
    )


def recommend_uplift(scores: DataFrame, costs: DataFrame, cfg: UpliftConfig) -> DataFrame:
    """Top answers per threat; an item significant against several threats of a request gets a bonus."""
    stat = F.col("tier") != "mechanic"
    shared = F.sum(stat.cast("int")).over(Window.partitionBy("request", "item"))
    key = F.col("score") + F.when(stat, F.lit(cfg.multi_threat_bonus) * (F.greatest(F.lit(1), F.col("shared")) - 1)).otherwise(0.0)
    priced = scores.withColumn("shared", shared).withColumn("key", key).join(costs, "item", "left")
    order = Window.partitionBy("request", "threat").orderBy(F.round("key", 9).desc(), F.coalesce("cost", F.lit(0)), "item")
    return priced.withColumn("place", F.row_number().over(order)).where(F.col("place") <= cfg.per_threat)


def tiered_advice(asks: DataFrame, cube: DataFrame, min_games: int, min_base: int, per: tuple[str, ...] = ("request",)) -> DataFrame:
    """First tier with enough games (enemy item, enemy hero, trait), else the hero's own record.

    ``asks``: request, bucket, hero, item, enemy_item, enemy_hero, trait. Rows: asks plus tier,
    delta (win-rate change in pp), games and place (no loss first, finer tier, larger gain, cheap). ``per``: what an answer
    is for, a request or a threat of it.
    """

    def look(table: str, ctx: str, name: str) -> DataFrame:
        return _cells(cube, table).select("bucket", "hero", F.col("ctx").alias(ctx), "item", F.col("n").alias(f"{name}_n"), F.col("w").alias(f"{name}_w"))

    base = _cells(cube, "base").select("bucket", "hero", "item", F.col("n").alias("b_n"), F.col("w").alias("b_w"))
    j = asks.join(base, ["bucket", "hero", "item"]).where(F.col("b_n") >= min_base)
    for table, ctx, name in (("vs_item", "enemy_item", "i"), ("vs_hero", "enemy_hero", "h"), ("vs_trait", "trait", "t")):
        j = j.join(look(table, ctx, name), ["bucket", "hero", ctx, "item"], "left")
    base_wr = F.col("b_w") * 100.0 / F.col("b_n")
    tier = F.when((F.col("i_n") >= min_games) | (F.col("h_n") >= min_games), "hero").when(F.col("t_n") >= min_games, "trait").otherwise("base")

    def pick(suffix: str):
        out = F.lit(None)
        for n in ("t", "h", "i"):
            out = F.when(F.col(f"{n}_n") >= min_games, F.col(f"{n}_{suffix}")).otherwise(out)
        return out

    games, wins = F.coalesce(pick("n"), F.col("b_n")), F.coalesce(pick("w"), F.col("b_w"))
    wr = wins * 100.0 / games
    delta = F.when(tier != "base", F.round(wr - base_wr, 1))
    value = F.coalesce(delta, wr / 100)
    rank = F.when(tier == "hero", 3).when(tier == "trait", 2).otherwise(1)
    out = j.select(*per, "item", tier.alias("tier"), delta.alias("delta"), games.alias("games"), F.coalesce(delta >= 0, F.lit(True)).alias("fine"), rank.alias("tier_rank"), value.alias("value"))
    order = Window.partitionBy(*per).orderBy(F.col("fine").desc(), F.col("tier_rank").desc(), F.round("value", 9).desc(), "item")
    return out.withColumn("place", F.row_number().over(order)).drop("fine", "tier_rank", "value")
