"""Holdout agreement, threshold sweep, source comparison, benchmark hit rate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skirmish.config import DAY, SWEEP_PP
from skirmish.functions.stats import half_width, lower, upper

CELL = ["bucket", "role", "hero", "ctx", "y"]


def cutoff(matches: DataFrame, days: int) -> Column:
    return matches.agg((F.max("start_time") - days * DAY).alias("c")).scalar()


def _test(metrics: DataFrame) -> DataFrame:
    return metrics.select(*CELL, F.col("lift_a").alias("ta"), F.col("var_a").alias("tva"), F.col("diff_b").alias("tb"), F.col("var_b").alias("tvb"))


def _significant(value: str, var: str, z: float) -> Column:
    return F.abs(F.col(value)) > half_width(F.col(var), z)


def holdout_signs(train: DataFrame, test: DataFrame, z: float) -> DataFrame:
    """One row of counts: do the signs of A and B repeat on later days (all, and where significant)?"""
    j = train.select(*CELL, F.col("a_s").alias("a"), F.col("b_s").alias("b")).join(_test(test), CELL)
    out = []
    for name, v, t, tv in (("b", "b", "tb", "tvb"), ("a", "a", "ta", "tva")):
        known = (F.col(v) != 0) & F.col(t).isNotNull() & (F.col(t) != 0)
        same = F.signum(F.col(v)) == F.signum(F.col(t))
        sig = (F.col(v) != 0) & _significant(t, tv, z)
        for suffix, cond in (("checked", known), ("agree", known & same), ("sig", sig), ("sig_agree", sig & same)):
            out.append(F.count_if(cond).alias(f"{name}_{suffix}"))
    return j.agg(*out)


def ally_signs(train: DataFrame, test: DataFrame, z: float, min_pp: float) -> DataFrame:
    t = train.where(
        (F.col("ctx") != F.col("hero").cast("string")) & (upper(F.col("lift_a"), F.col("var_a"), z) < 0) & (F.col("lift_a") * 100 <= -min_pp)
    )
    j = t.select(*CELL, F.lit(1).alias("one")).join(_test(test), CELL, "left")
    return j.agg(
        F.count("*").alias("pairs"),
        F.count_if(F.col("ta").isNotNull() & (F.col("ta") != 0)).alias("checked"),
        F.count_if(F.col("ta") < 0).alias("agree"),
        F.count_if(_significant("ta", "tva", z)).alias("sig"),
        F.count_if(F.col("ta") < -half_width(F.col("tva"), z)).alias("sig_agree"),
    )


def threshold_sweep(train: DataFrame, test: DataFrame, z: float, thresholds: Sequence[float] = SWEEP_PP) -> DataFrame:
    """Per threshold: advice kept, sign agreement on later days, and hero pairs that keep any advice.

    Each training row carries the short array of thresholds it passes, so the table is read once.
    """
    row = train.select(*CELL, F.col("lift_a"), F.col("var_a"))
    ok = lower(F.col("lift_a"), F.col("var_a"), z) > 0
    passed = F.filter(F.array(*[F.lit(float(t)) for t in thresholds]), lambda t: ok & (F.col("lift_a") * 100 >= t))
    j = row.withColumn("pp", F.explode(passed)).join(_test(test), CELL, "left")
    normal = F.col("bucket") == "normal"
    per_pair = j.groupBy("pp", "bucket", "role", "hero", "ctx").agg(
        F.count_if(F.col("ta").isNotNull() & (F.col("ta") != 0)).alias("checked"),
        F.count_if(F.col("ta") > 0).alias("agree"),
        F.count_if(_significant("ta", "tva", z)).alias("sig"),
        F.count_if(F.col("ta") > half_width(F.col("tva"), z)).alias("sig_agree"),
    )
    total = row.where(normal).select("role", "hero", "ctx").distinct().agg(F.count("*").alias("c")).scalar()
    return per_pair.groupBy("pp").agg(
        *[F.sum(c).alias(c) for c in ("checked", "agree", "sig", "sig_agree")], F.count_if(normal).alias("pairs_kept")
    ).withColumn("pairs", total)


def compare_sources(advice: DataFrame, fact: DataFrame, z: float) -> DataFrame:
    """Per advice source: sign share where significant, first advice = best fact, mean fact of the first.

    ``advice``: src, cell columns, place, a_s. ``fact``: metrics of the same contexts on later days.
    """
    best = fact.where(F.col("lift_a").isNotNull()).groupBy("bucket", "role", "hero", "ctx").agg(
        F.max_by("y", F.struct("lift_a", (-F.col("y")).alias("o"))).alias("y_best")
    )
    j = advice.join(_test(fact), CELL).join(best, ["bucket", "role", "hero", "ctx"])
    sig = (F.col("a_s") != 0) & _significant("ta", "tva", z)
    first = F.col("place") == 1
    return j.groupBy("src").agg(
        F.count_if(sig).alias("sig"),
        F.count_if(sig & (F.signum("a_s") == F.signum("ta"))).alias("sig_agree"),
        F.count_if(first).alias("firsts"),
        F.count_if(first & (F.col("y") == F.col("y_best"))).alias("best_hits"),
        (F.avg(F.when(first, F.col("ta"))) * 100).alias("mean_first_pp"),
    )


def benchmark_pairs(answers: DataFrame, listed: DataFrame, buys: DataFrame, top: int = 3) -> DataFrame:
    """(hero, role, enemy, hit, confident, reachable, ...): one row per pair with answers and listed items.

    ``answers``: hero, role, ctx, place, y, a_s, conf, games of each hero's main role.
    ``listed``: ctx, y. ``buys``: hero, role, items array.
    """
    want = listed.groupBy("ctx").agg(F.collect_set("y").alias("listed"))
    rows = answers.groupBy("hero", "role", "ctx").agg(
        F.array_sort(F.collect_list(F.struct("place", "y", "a_s", "conf", "games"))).alias("rows")
    )
    j = rows.join(want, "ctx").join(buys.select("hero", "role", "items"), ["hero", "role"], "left")
    lead = F.transform(F.slice("rows", 1, top), lambda r: r["y"])
    reach = F.array_intersect("listed", F.coalesce("items", F.array().cast("array<int>")))
    return j.select(
        "hero", "role", F.col("ctx").alias("enemy"), "rows", reach.alias("reach"),
        F.arrays_overlap("listed", lead).alias("hit"),
        (F.col("rows")[0]["conf"] != "low").alias("confident"),
        (F.size(reach) > 0).alias("reachable"),
    )


def benchmark_shares(pairs: DataFrame) -> DataFrame:
    c, r, h = F.col("confident"), F.col("reachable"), F.col("hit")
    return pairs.agg(
        F.count("*").alias("pairs"), F.count_if(h).alias("hits"),
        F.count_if(c).alias("pairs_confident"), F.count_if(c & h).alias("hits_confident"),
        F.count_if(r).alias("pairs_reachable"), F.count_if(r & h).alias("hits_reachable"),
    )


def disagreements(pairs: DataFrame, limit: int = 10) -> DataFrame:
    """Most played reachable misses with a verdict on who is right."""
    miss = pairs.where(F.col("reachable") & ~F.col("hit"))
    found = F.filter("rows", lambda r: F.array_contains(F.col("reach"), r["y"]))
    best = F.array_max(F.transform(found, lambda r: F.struct(r["games"].alias("games"), r["y"].alias("y"), r["a_s"].alias("a"), r["place"].alias("pos"))))
    verdict = F.when(best.isNull(), "filtered").when(best["a"] <= 0, "not confirmed").otherwise("both right")
    out = miss.select("hero", "enemy", best["y"].alias("y"), best["pos"].alias("pos"), verdict.alias("verdict"), F.coalesce(best["games"], F.lit(0.0)).alias("weight"))
    return out.orderBy(F.col("weight").desc(), "hero", "enemy").limit(limit)


def report_cells(answers: DataFrame, targets: DataFrame, top: int = 3) -> DataFrame:
    """(hero, role, ctx, 1, 2, 3): top answers side by side, as text cells."""
    cell = F.format_string("**%s** A %+.1f, B %+.1f, %d", F.col("y").cast("string"), F.col("a_s") * 100, F.coalesce("b_s", F.lit(0.0)) * 100, F.round("games").cast("bigint"))
    rows = answers.where(F.col("place") <= top).join(targets, ["hero", "ctx"], "left_semi")
    return rows.groupBy("bucket", "hero", "role", "ctx").pivot("place", list(range(1, top + 1))).agg(F.first(cell))
