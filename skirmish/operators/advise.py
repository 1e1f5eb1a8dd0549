"""Served advice for many requests at once: fallback chain, ownership, bonus, now / later."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skirmish.config import AdviceConfig
from skirmish.functions.game import phase_budget


def resolve_roles(requests: DataFrame, answers: DataFrame, classes: DataFrame) -> DataFrame:
    """Adds ``role``: the wanted role if there are answers for it, else the one with most contexts."""
    contexts = answers.groupBy("bucket", "hero", "role").agg(F.count_distinct("ctx").alias("k"))
    widest = contexts.groupBy("bucket", "hero").agg(F.max_by("role", F.struct("k", "role")).alias("widest"))
    have = contexts.select("bucket", "hero", F.col("role").alias("wanted"), F.lit(True).alias("has"))
    main = classes.select(F.col("hero").cast("string").alias("hero"), "main_role")
    j = requests.join(main, "hero", "left").withColumn("wanted", F.coalesce("role_mode", "main_role"))
    j = j.join(have, ["bucket", "hero", "wanted"], "left").join(widest, ["bucket", "hero"], "left")
    return j.withColumn("role", F.when(F.col("has"), F.col("wanted")).otherwise(F.col("widest"))).drop("has", "widest", "wanted", "main_role").where(
        F.col("role").isNotNull()
    )


def answer_rows(threats: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """Answers per (request, threat): its items first (hero:item, else item), then the hero; first copy kept.

    ``threats``: request, bucket, hero, role, enemy, enemy_items array. ``tables``: item, hero and
    optionally item_hero, each with (bucket, role, hero, ctx, place, y, score, a_s, games, rule).
    """
    key = ["request", "bucket", "hero", "role", "enemy"]
    cols = ["place", "y", "score", "a_s", "games", "rule"]
    items = threats.select(*key, F.posexplode(F.array_sort("enemy_items")).alias("item_pos", "x"))
    chain = []
    if "item_hero" in tables:
        c = items.withColumn("ctx", F.concat_ws(":", F.col("enemy").cast("string"), F.col("x").cast("string")))
        chain.append(c.join(tables["item_hero"], ["bucket", "role", "hero", "ctx"]).select(*key, "item_pos", F.lit(0).alias("source"), *cols))
    c = items.withColumn("ctx", F.col("x").cast("string"))
    chain.append(c.join(tables["item"], ["bucket", "role", "hero", "ctx"]).select(*key, "item_pos", F.lit(1).alias("source"), *cols))
    both = chain[0] if len(chain) == 1 else chain[0].unionByName(chain[1])
    best = F.min("source").over(Window.partitionBy(*key, "item_pos"))
    both = both.withColumn("best", best).where(F.col("source") == F.col("best")).drop("best", "source").withColumn("tier", F.lit("item"))
    h = threats.withColumn("ctx", F.col("enemy").cast("string")).join(tables["hero"], ["bucket", "role", "hero", "ctx"])
    h = h.select(*key, F.lit(1_000_000).alias("item_pos"), *cols, F.lit("hero").alias("tier"))
    ordered = both.unionByName(h)
    first = Window.partitionBy(*key, "y").orderBy("item_pos", "place")
    kept = ordered.withColumn("copy", F.row_number().over(first)).where(F.col("copy") == 1).drop("copy")
    place = Window.partitionBy(*key).orderBy("item_pos", "place", "y")
    return kept.withColumn("pos", F.row_number().over(place)).drop("item_pos", "place")


def advise(rows: DataFrame, requests: DataFrame, closure: DataFrame, costs: DataFrame, cfg: AdviceConfig, taken: DataFrame | None = None) -> DataFrame:
    """(request, enemy, slot, y, value): slots bought, now (fits the budget) and later.

    ``requests``: request, my_items array<int>, minutes. ``taken``: (request, y) bought by allies.
    """
    own = requests.select("request", F.explode("my_items").alias("z"))
    up = closure.select(F.col("item").alias("z"), F.col("component").alias("y"))
    owned = own.select("request", F.col("z").alias("y")).unionByName(own.join(up, "z").select("request", "y")).distinct()
    j = rows.join(owned.withColumn("owned", F.lit(True)), ["request", "y"], "left").withColumn("owned", F.coalesce("owned", F.lit(False)))
    if taken is not None:
        marked = taken.select("request", "y").distinct().withColumn("taken", F.lit(True))
        j = j.join(marked, ["request", "y"], "left").where(F.col("owned") | F.col("taken").isNull()).drop("taken")
    per_threat = Window.partitionBy("request", "enemy", "owned").orderBy("pos")
    j = j.withColumn("turn", F.row_number().over(per_threat))
    in_top = (~F.col("owned") & (F.col("turn") <= cfg.top_for_bonus)).cast("int")
    j = j.withColumn("tops", F.sum(in_top).over(Window.partitionBy("request", "y")))
    value = F.col("score") + F.when(F.col("tops") >= 2, F.lit(cfg.multi_threat_bonus)).otherwise(0.0)
    j = j.withColumn("value", F.round(value, 2)).join(costs, "y", "left").join(requests.select("request", "minutes"), "request")
    fits = F.coalesce(F.col("cost") <= phase_budget(F.col("minutes"), cfg.phase_base_cost, cfg.phase_cost_per_min), F.lit(True))
    card = F.struct("pos", "y", "value", F.greatest(F.lit(1), F.col("tops")).alias("shared"))
    fresh = ~F.col("owned")
    picks = j.groupBy("request", "enemy").agg(
        F.min(F.when(F.col("owned"), card)).alias("bought"),
        F.min(F.when(fresh & fits, card)).alias("fit"),
        F.array_sort(F.collect_list(F.when(fresh & (F.col("turn") <= 2), card))).alias("lead"),
    )
    now = F.coalesce("fit", F.try_element_at("lead", F.lit(1)))
    later = F.try_element_at(F.filter("lead", lambda c: c["y"] != now["y"]), F.lit(1))
    slots = F.array(*[F.struct(F.lit(n).alias("slot"), c.alias("c")) for n, c in (("bought", F.col("bought")), ("now", now), ("later", later))])
    return picks.select("request", "enemy", F.inline(slots)).where(F.col("c").isNotNull()).select("request", "enemy", "slot", "c.y", "c.value", "c.shared")


def ally_taken(requests: DataFrame, ally_table: DataFrame) -> DataFrame:
    """(request, y): items an ally of the request usually brings."""
    a = requests.select("request", "bucket", "hero", "role", F.explode("allies").alias("ally")).withColumn("ctx", F.col("ally").cast("string"))
    return a.join(ally_table, ["bucket", "hero", "role", "ctx"]).select("request", "y").distinct()
