"""Empirical-Bayes spread and shrinkage towards a coarser level."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skirmish.config import Config

CELL = ["bucket", "role", "hero", "ctx", "y"]


@dataclass(frozen=True)
class Spread:
    tau2: float
    k: float
    estimated: bool


def spread_table(metrics: DataFrame, cfg: Config) -> DataFrame:
    """(metric, tau2, k, estimated) of A and B in one pass: the spread of the true values between cells by moments.

    Where too few cells tell or noise explains all, the default strength stands in.
    """
    one = lambda name, value, var, usual: F.struct(F.lit(name).alias("metric"), F.col(value).alias("value"), F.col(var).alias("noise"), F.col("games"), F.lit(float(usual)).alias("usual"))
    rows = metrics.select(F.inline(F.array(one("A", "lift_a", "var_a", cfg.k_a_default), one("B", "diff_b", "var_b", cfg.k_b_default))))
    clear = (F.col("noise") > 0) & (F.col("games") > 0)
    good = clear & F.col("value").isNotNull() & (F.col("games") >= cfg.eb_min_games)
    per_game = F.col("noise") * F.col("games")
    moments = rows.groupBy("metric", "usual").agg(
        F.count_if(good).alias("cells"), F.avg(F.when(good, per_game)).alias("sigma2"), F.avg(F.when(clear, per_game)).alias("any_sigma2"),
        (F.var_samp(F.when(good, F.col("value"))) - F.avg(F.when(good, F.col("noise")))).alias("between"),
    )
    told = F.coalesce((F.col("cells") >= 30) & (F.col("between") > 0) & (F.col("sigma2") > 0), F.lit(False))
    default = F.coalesce(F.nullif(F.col("any_sigma2"), F.lit(0.0)), F.lit(0.25)) / F.col("usual")
    return moments.select(
        "metric", F.when(told, F.col("between")).otherwise(default).alias("tau2"),
        F.when(told, F.col("sigma2") / F.col("between")).otherwise(F.col("usual")).alias("k"), told.alias("estimated"),
    )


def spreads(l2: DataFrame, cfg: Config) -> dict[str, Spread]:
    """``spread_table`` on the driver, two rows; a level without cells has the defaults."""
    found = {r["metric"]: Spread(r["tau2"], r["k"], r["estimated"]) for r in spread_table(l2, cfg).collect()}
    return {m: found.get(m) or Spread(0.25 / k, k, False) for m, k in (("A", cfg.k_a_default), ("B", cfg.k_b_default))}


def prior_from_mechanics(l2: DataFrame, l3: DataFrame, x_mech: DataFrame) -> DataFrame:
    """Item context: mean of the raw values of the mechanics that item has."""
    link = x_mech.select(F.col("x").cast("string").alias("ctx"), F.col("mech"))
    base = l3.select("bucket", "role", "hero", "y", F.col("ctx").alias("mech"), "lift_a", "diff_b")
    return (
        l2.select(*CELL)
        .join(link, "ctx")
        .join(base, ["bucket", "role", "hero", "y", "mech"])
        .groupBy(*CELL)
        .agg(F.avg("lift_a").alias("prior_a"), F.avg("diff_b").alias("prior_b"))
    )


def prior_from_items(l1: DataFrame, smoothed_l2: DataFrame) -> DataFrame:
    """Hero-with-item context: the smoothed value of the item alone."""
    base = smoothed_l2.select(
        "bucket", "role", "hero", "y", F.col("ctx").alias("item"), F.col("a_s").alias("prior_a"), F.col("b_s").alias("prior_b")
    )
    return (
        l1.select(*CELL, F.split_part("ctx", F.lit(":"), F.lit(2)).alias("item"))
        .join(base, ["bucket", "role", "hero", "y", "item"])
        .select(*CELL, "prior_a", "prior_b")
    )


def _pull(value: str, var: str, prior: str, tau2: float):
    v, t = F.col(var), F.lit(float(tau2))
    base = F.coalesce(F.col(prior), F.lit(0.0))
    est = (
        F.when(F.col(value).isNull(), base)
        .when(v.isNull() | (v <= 0), F.col(value))
        .otherwise((F.col(value) * t + base * v) / (t + v))
    )
    return est, F.when(v > 0, v * t / (t + v)).otherwise(v)


def smooth(metrics: DataFrame, eb: dict[str, Spread], prior: DataFrame | None = None) -> DataFrame:
    """Adds a_s, va_s, b_s, vb_s: each cell pulled to its prior (or zero) by its own variance."""
    if prior is None:
        joined = metrics.withColumns({p: F.lit(None).cast("double") for p in ("prior_a", "prior_b")})
    else:
        joined = metrics.join(prior, CELL, "left")
    a_s, va_s = _pull("lift_a", "var_a", "prior_a", eb["A"].tau2)
    b_s, vb_s = _pull("diff_b", "var_b", "prior_b", eb["B"].tau2)
    return joined.withColumns({"a_s": a_s, "va_s": va_s, "b_s": b_s, "vb_s": vb_s}).drop("prior_a", "prior_b")
