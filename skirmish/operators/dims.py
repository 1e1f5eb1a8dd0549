"""Item, hero and rule dimensions: closure, candidates, key items, mechanic answers.

Inputs are plain tables, so any game (or the driver tables) can supply them:

    items        id int, key string, cost int, created boolean, qual string, tier int
    edges        item int, component int
    item_traits  id int, mech string          what an item gives its owner
    item_tags    id int, tag string           what an item works against
    hero_traits  hero int, mech string
    heroes       hero int, attr string
    rules        rule string, enemy string, answer string
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skirmish.config import Config
from skirmish.session import settle_dim, settle_dims, stage

def component_closure(edges: DataFrame, depth: int | None = None) -> DataFrame:
    """(item, component) pairs reachable over any number of recipe steps, or over at most ``depth``.

    Only the pairs of the last step are taken further and known ones are left out, so cycles and diamonds end.
    """
    steps = edges.select(F.col("item").alias("component"), F.col("component").alias("part")).distinct()
    known = fresh = stage(edges.select("item", "component").distinct(), "closure_1")
    step = 1
    while depth is None or step < depth:
        further = fresh.join(steps, "component").select("item", F.col("part").alias("component")).distinct()
        step += 1
        fresh = stage(further.join(known, ["item", "component"], "left_anti"), f"closure_{step}")
        if not fresh.head(1):
            break
        known = known.unionByName(fresh)
    return known


def buyable(items: DataFrame) -> DataFrame:
    return items.where(
        (F.coalesce(F.col("cost"), F.lit(0)) > 0)
        & ~F.col("key").startswith("recipe")
        & (F.coalesce(F.col("qual"), F.lit("")) != "consumable")
        & (F.coalesce(F.col("tier"), F.lit(0)) == 0)
    )


def candidates(items: DataFrame, closure: DataFrame, cfg: Config) -> DataFrame:
    """Items that may be an answer: finished and dear enough, minus one recipe tree, plus a keep list."""
    base = buyable(items).where(
        (F.col("created") & (F.col("cost") >= cfg.candidate_min_cost)) | F.col("key").isin(*cfg.extra_candidates)
    )
    if cfg.exclude_tree_of is None:
        return base.select(F.col("id").alias("y"))
    root = items.where(F.col("key") == cfg.exclude_tree_of).select(F.col("id").alias("component"))
    tree = closure.join(root, "component", "left_semi").select(F.col("item").alias("id")).distinct()
    keep = base.where(F.col("key").isin(*cfg.keep_from_excluded))
    return base.join(tree, "id", "left_anti").unionByName(keep).select(F.col("id").alias("y")).distinct()


def key_items(items: DataFrame, item_traits: DataFrame, cfg: Config) -> DataFrame:
    """Enemy items worth a context: any mechanic, or finished and dear."""
    tagged = item_traits.select("id").distinct().withColumn("tagged", F.lit(True))
    return (
        buyable(items)
        .join(tagged, "id", "left")
        .where(F.coalesce("tagged", F.lit(False)) | (F.col("created") & (F.col("cost") >= cfg.key_item_min_cost)))
        .select(F.col("id").alias("x"))
    )


def expand_table(items: DataFrame, closure: DataFrame, cands: DataFrame) -> DataFrame:
    """(z, y): an inventory item z counts as owning candidate y, itself or one of its parts."""
    own = items.select(F.col("id").alias("z"), F.col("id").alias("y"))
    parts = closure.select(F.col("item").alias("z"), F.col("component").alias("y"))
    return own.unionByName(parts).distinct().join(cands, "y", "left_semi").select("z", "y")


def recipe_parts(items: DataFrame, closure: DataFrame, cands: DataFrame) -> DataFrame:
    """Candidates that are part of another buyable item."""
    upper = buyable(items).select(F.col("id").alias("item"))
    return (
        closure.join(upper, "item", "left_semi")
        .select(F.col("component").alias("y"))
        .distinct()
        .join(cands, "y", "left_semi")
    )


def broad_rules(rules: DataFrame, hero_traits: DataFrame, heroes: DataFrame, cfg: Config) -> DataFrame:
    """(rule, share) of rules whose enemy mechanic is found on too many heroes."""
    total = heroes.agg(F.count("*").alias("c")).scalar()
    owners = hero_traits.distinct().groupBy(F.col("mech").alias("enemy")).agg(F.count("*").alias("k"))
    share = F.round(F.coalesce("k", F.lit(0)) / F.greatest(total, F.lit(1)), 9)
    return (
        rules.select("rule", "enemy")
        .distinct()
        .join(owners, "enemy", "left")
        .select("rule", share.alias("share"))
        .where(F.col("share") > cfg.broad_rule_share)
    )


def mechanic_answers(
    rules: DataFrame, item_traits: DataFrame, item_tags: DataFrame, hero_traits: DataFrame, keys: DataFrame, cands: DataFrame
) -> DataFrame:
    """(kind, ctx, y, rule): item y answers an enemy item (x), a mechanic (m) or an enemy hero (e)."""
    by_rule = (
        rules.join(item_tags.withColumnRenamed("tag", "answer"), "answer")
        .select("rule", "enemy", F.col("id").alias("y"))
        .distinct()
        .join(cands, "y", "left_semi")
    )
    x = (
        item_traits.join(keys.withColumnRenamed("x", "id"), "id", "left_semi")
        .select(F.lit("x").alias("kind"), F.col("id").cast("string").alias("ctx"), F.col("mech").alias("enemy"))
    )
    m = rules.select(F.lit("m").alias("kind"), F.col("enemy").alias("ctx"), "enemy").distinct()
    e = hero_traits.select(F.lit("e").alias("kind"), F.col("hero").cast("string").alias("ctx"), F.col("mech").alias("enemy"))
    return x.unionByName(m).unionByName(e).join(by_rule, "enemy").select("kind", "ctx", "y", "rule").distinct()


def pick_rule(answers: DataFrame, broad: DataFrame) -> DataFrame:
    """One rule per (kind, ctx, y): narrow before broad, then by name; ``broad`` only if every rule is."""
    flags = answers.join(broad.select("rule", F.lit(True).alias("is_broad")), "rule", "left").withColumn(
        "is_broad", F.coalesce("is_broad", F.lit(False))
    )
    return flags.groupBy("kind", "ctx", "y").agg(
        F.min_by("rule", F.struct("is_broad", "rule")).alias("rule"), F.bool_and("is_broad").alias("broad")
    )


@dataclass
class ItemModel:
    """Settled dimensions; every table is a LocalRelation when it is small (see session.settle_dim)."""

    items: DataFrame
    closure: DataFrame
    candidates: DataFrame
    key_items: DataFrame
    expand: DataFrame
    parts: DataFrame
    x_mech: DataFrame
    answers: DataFrame
    broad: DataFrame
    heroes: DataFrame

    @property
    def spark(self) -> SparkSession:
        return self.items.sparkSession


def build_item_model(
    items: DataFrame,
    edges: DataFrame,
    item_traits: DataFrame,
    item_tags: DataFrame,
    heroes: DataFrame,
    hero_traits: DataFrame,
    rules: DataFrame,
    cfg: Config,
) -> ItemModel:
    closure = settle_dim(component_closure(edges))
    first = settle_dims(
        {
            "candidates": candidates(items, closure, cfg),
            "key_items": key_items(items, item_traits, cfg),
            "broad": broad_rules(rules, hero_traits, heroes, cfg),
        }
    )
    cands, keys, broad = first["candidates"], first["key_items"], first["broad"]
    rest = settle_dims(
        {
            "expand": expand_table(items, closure, cands),
            "parts": recipe_parts(items, closure, cands),
            "x_mech": item_traits.withColumnRenamed("id", "x").join(keys, "x", "left_semi").select("x", "mech").distinct(),
            "answers": pick_rule(mechanic_answers(rules, item_traits, item_tags, hero_traits, keys, cands), broad),
        }
    )
    return ItemModel(items, closure, cands, keys, broad=broad, heroes=heroes, **rest)
