"""Counter hints: verified table look-ups, reasons, choice by own purchases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skirmish.config import HintConfig


def counters_vs_item(props: DataFrame, rules: DataFrame, counters: DataFrame) -> DataFrame:
    """(x, prop, answer, y, ord): verified answers to the verified properties of an item, in table order.

    ``props``: x, prop, ord_p, verified. ``rules``: prop, answer, ord_r. ``counters``: answer, y, ord_c, verified.
    """
    p = props.where("verified").select("x", "prop", "ord_p")
    c = counters.where("verified").select("answer", "y", "ord_c")
    return p.join(rules, "prop").join(c, "answer").select("x", "prop", "answer", "y", F.struct("ord_p", "ord_r", "ord_c").alias("ord"))


def hero_counters(wiki: DataFrame, consumables: DataFrame, allowed: DataFrame, reasons: DataFrame) -> DataFrame:
    """(hero, y, kind, ord): page answers minus consumables (unless in the table) and unfounded pairs.

    A reason counts only while the fingerprint of the page text is the one it was written for.
    """
    skip = consumables.join(allowed, "y", "left_anti")
    r = reasons.select("hero", "y", F.col("text_key").alias("r_key"), F.col("kind").alias("r_kind"))
    j = wiki.join(skip, "y", "left_anti").join(r, ["hero", "y"], "left")
    kind = F.when(F.col("r_key") == fingerprint(F.col("text")), F.col("r_kind"))
    return j.withColumn("kind", kind).where(F.coalesce(F.col("kind"), F.lit("")) != "none").select("hero", "y", "kind", "ord")


def fingerprint(text: Column) -> Column:
    return F.substring(F.sha1(text.cast("binary")), 1, 10)


def pick_parent(parts: DataFrame, shares: DataFrame) -> DataFrame:
    """(hero, part, parent): what a hero will build from a part: the candidate they buy most.

    ``parts``: hero, part, parent, ord (list position; the earlier one wins a tie).
    """
    known = parts.join(shares.select("hero", F.col("y").alias("parent"), "share"), ["hero", "parent"]).where(F.col("share") > 0)
    return known.groupBy("hero", "part").agg(F.max_by("parent", F.struct("share", (-F.col("ord")).alias("o"))).alias("parent"))


def choose(counters: DataFrame, shares: DataFrame, owned: DataFrame | None, cfg: HintConfig) -> DataFrame:
    """(request, place, y, answer, share, rare): one or two answers the request's hero really buys.

    ``counters``: request, y, answer, prop, ord. When nothing reaches the minimum share, the item
    covering most properties is shown as rare.
    """
    c = counters if owned is None else counters.join(owned, ["request", "y"], "left_anti")
    items = c.groupBy("request", "y").agg(
        F.min("ord").alias("ord"), F.min_by("answer", "ord").alias("answer"), F.count_distinct(F.coalesce("prop", "answer")).alias("covers")
    )
    j = items.join(shares.select("request", "y", "share"), ["request", "y"], "left")
    good = F.coalesce(F.col("share"), F.lit(0.0)) >= cfg.min_own_share
    per = Window.partitionBy("request")
    j = j.withColumn("good", good).withColumn("any_good", F.max("good").over(per))
    order = per.orderBy(
        F.col("good").desc(),
        F.when(F.col("any_good"), -F.coalesce(F.col("share"), F.lit(0.0))).otherwise(-F.col("covers")),
        "ord",
    )
    j = j.withColumn("place", F.row_number().over(order))
    keep = F.when(F.col("any_good"), F.col("good") & (F.col("place") <= cfg.limit)).otherwise(F.col("place") == 1)
    return j.where(keep).select("request", "place", "y", "answer", "share", (~F.col("any_good")).alias("rare"))


def similar_inventory(mine: Column, seen: Column, share: float = 0.8, min_size: int = 3, subset_min: int = 2) -> Column:
    """True where a seen inventory is most likely one's own: a subset, or a large overlap."""
    common = F.size(F.array_intersect(mine, seen))
    subset = (F.size(seen) >= subset_min) & (F.size(F.array_except(seen, mine)) == 0)
    close = (F.size(mine) >= min_size) & (F.size(seen) >= min_size) & (common >= share * F.greatest(F.size(mine), F.size(seen)))
    return subset | close


def enabled_events(preset: Column, switched_on: Column, switched_off: Column) -> Column:
    return F.array_except(F.array_union(preset, switched_on), switched_off)
