"""Ranked answers: candidates, veto, threshold, confidence, order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skirmish.config import Config
from skirmish.functions.stats import lower, upper
from skirmish.operators.shrink import Spread

PLACE = ["bucket", "role", "hero", "ctx"]

# context level -> where to look for a mechanic rule: (kind, which part of the context)
RULE_KINDS = {"L1": (("x", 2), ("e", 1)), "L2": (("x", 0),), "L3": (("m", 0),), "hero": (("e", 0),)}


def _with_rule(table: DataFrame, level: str, answers: DataFrame) -> DataFrame:
    """First rule found over the kinds of this level, with its breadth."""
    rules: list[Column] = []
    broads: list[Column] = []
    for i, (kind, part) in enumerate(RULE_KINDS[level]):
        look = answers.where(F.col("kind") == kind).select(
            F.col("ctx").alias(f"k{i}"), F.col("y"), F.col("rule").alias(f"rule{i}"), F.col("broad").alias(f"broad{i}")
        )
        key = F.split_part("ctx", F.lit(":"), F.lit(part)) if part else F.col("ctx")
        table = table.withColumn(f"k{i}", key).join(look, [f"k{i}", "y"], "left").drop(f"k{i}")
        rules.append(F.col(f"rule{i}"))
        broads.append(F.col(f"broad{i}"))
    temp = [f"{c}{i}" for i in range(len(rules)) for c in ("rule", "broad")]
    return table.withColumn("rule_0", F.coalesce(*rules)).withColumn("broad_0", F.coalesce(*broads)).drop(*temp)


def confidence(cfg: Config, low: Column | None = None) -> Column:
    steps = F.when(F.col("games") >= cfg.conf_high, "high").when(F.col("games") >= cfg.conf_mid, "mid").otherwise("low")
    return steps if low is None else F.when(low, "low").otherwise(steps)


def rank_answers(
    smoothed: DataFrame, level: str, answers: DataFrame, eb: dict[str, Spread], cfg: Config, only_confident: bool = False
) -> DataFrame:
    """Top-N answers per (bucket, role, hero, context). ``smoothed`` is a stage table: it is read twice."""
    sd = smoothed.agg(F.stddev_samp("a_s").alias("a"), F.stddev_samp("b_s").alias("b")).first()
    sd_a, sd_b = sd["a"] or 1.0, sd["b"] or 1.0
    z = cfg.z90
    a_low = lower(F.col("a_s"), F.col("va_s"), z)
    ruled = _with_rule(smoothed.where(F.col("a_s").isNotNull()), level, answers)
    weak_broad = F.coalesce("broad_0", F.lit(False)) & ~F.coalesce(a_low > 0, F.lit(False))
    scored = (
        ruled.withColumn("rule", F.when(weak_broad, F.lit(None)).otherwise(F.col("rule_0")))
        .withColumn("score", F.col("a_s") / sd_a + F.lit(cfg.lam) * F.coalesce("b_s", F.lit(0.0)) / sd_b)
        .withColumn("conf", confidence(cfg, F.col("var_a").isNull() | (F.col("var_a") > eb["A"].tau2)))
        .withColumn(
            "by_lift", F.row_number().over(Window.partitionBy(*PLACE).orderBy(F.round("a_s", 9).desc(), F.col("y")))
        )
    )
    harmful = F.coalesce(upper(F.col("b_s"), F.col("vb_s"), z) * 100 < -cfg.veto_b, F.lit(False)) & F.col("vb_s").isNotNull()
    kept = scored.where((F.col("rule").isNotNull() | (F.col("by_lift") <= cfg.adaptation_top)) & ~harmful)
    if cfg.counter_min_a_pp is not None:
        kept = kept.where((a_low > 0) & (F.col("a_s") * 100 >= cfg.counter_min_a_pp))
    if only_confident:
        kept = kept.where(F.col("conf") != "low")
    order = [F.round("score", 9).desc(), F.col("y")]
    if cfg.mechanic_first:
        late = F.col("rule").isNull()
        if cfg.mechanic_first_min_a is not None:
            weak = F.col("a_s") <= cfg.mechanic_first_min_a
            if cfg.mechanic_first_b_significant:
                weak = weak & ~F.coalesce(lower(F.col("b_s"), F.col("vb_s"), z) > 0, F.lit(False))
            late = late | weak
        order.insert(0, late)
    placed = kept.withColumn("place", F.row_number().over(Window.partitionBy(*PLACE).orderBy(*order)))
    return placed.where(F.col("place") <= cfg.top_n).select(
        *PLACE, "place", "y", "score", "a_s", "b_s", "conf", "games", "rule"
    )


def ally_answers(smoothed: DataFrame, team_items: DataFrame, cfg: Config) -> DataFrame:
    """Items a hero clearly buys less often next to an ally who usually brings them (team items only)."""
    if cfg.counter_min_a_pp is None:
        smoothed = smoothed.where(F.lit(False))
    threshold = cfg.counter_min_a_pp or 0.0
    kept = smoothed.where(
        (upper(F.col("a_s"), F.col("va_s"), cfg.z90) < 0)
        & (F.col("a_s") * 100 <= -threshold)
        & (F.col("ctx") != F.col("hero").cast("string"))
    ).join(team_items.select("bucket", "y"), ["bucket", "y"], "left_semi")
    order = Window.partitionBy(*PLACE).orderBy(F.round("a_s", 9), F.col("y"))
    return kept.withColumn("place", F.row_number().over(order)).select(
        *PLACE, "place", "y", F.lit(0.0).alias("score"), "a_s", F.lit(None).cast("double").alias("b_s"),
        confidence(cfg).alias("conf"), "games", F.lit(None).cast("string").alias("rule"),
    )


def export_rows(answers: DataFrame) -> DataFrame:
    """Rounded, in percentage points, as written to the served table."""
    return answers.select(
        *PLACE, "place", "y",
        F.round("score", 2).alias("score"),
        F.round(F.col("a_s") * 100, 1).alias("a_pp"),
        F.round(F.coalesce("b_s", F.lit(0.0)) * 100, 1).alias("b_pp"),
        "conf",
        F.round("games").cast("bigint").alias("games"),
        F.coalesce("rule", F.lit("exp")).alias("source"),
    )
