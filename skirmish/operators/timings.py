"""First purchases and their exact medians."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skirmish.config import DAY, TimingConfig
from skirmish.functions.game import role_of
from skirmish.operators.rows import max_scalar, newest_per_key


def sample_players(matches: DataFrame, cfg: TimingConfig) -> DataFrame:
    """Eligible matches (see sources.matches.eligible) with parsed logs, two teams of five, known net worth."""
    radiant = F.size(F.filter("players", lambda p: F.coalesce(p["player_slot"], F.lit(0)) < 128))
    kept = matches.where(
        F.col("lobby_type").isin(*cfg.allowed_lobbies)
        & (F.coalesce("version", F.lit(0)) > 0)
        & (radiant * 2 == F.size("players"))
        & ~F.exists("players", lambda p: p["net_worth"].isNull())
    )
    p = kept.select("match_id", "start_time", "patch", "bucket", "duration", F.explode("players").alias("p")).select(
        "match_id", "start_time", "patch", "bucket", "duration", "p.*"
    )
    side = F.coalesce("player_slot", F.lit(0)) < 128
    place = F.row_number().over(Window.partitionBy("match_id", side).orderBy(F.col("net_worth").desc(), "player_slot"))
    return p.withColumn("role", role_of(place))


def first_purchases(log: DataFrame, keys: list[str], clock: str, duration: str) -> DataFrame:
    """Earliest in-range purchase per key; NaN and out-of-game times are dropped."""
    c = F.col(clock)
    ok = c.isNotNull() & ~F.isnan(c.cast("double")) & c.between(0, F.col(duration))
    return log.where(ok).groupBy(*keys).agg(F.min(clock).alias(clock))


def fresh_samples(samples: DataFrame, cfg: TimingConfig, now: Column) -> DataFrame:
    """Newest patch only, not older than the maximum age."""
    patch = max_scalar(samples, F.col("patch"))
    return samples.where((F.col("patch").eqNullSafe(patch)) & (now - F.col("start_time") <= cfg.max_age_days * DAY))


def medians(samples: DataFrame, cfg: TimingConfig) -> DataFrame:
    """(hero, bucket, role, item, seconds, samples): exact median per role and over all roles.

    Clocks are whole seconds, so equal clocks are counted first; percentile with a frequency then
    works on at most one row per (cell, second), however hot the cell is.
    """
    keys = ["hero", "bucket", "item"]
    counted = samples.groupBy(*keys, "role", "clock").agg(F.count("*").alias("k"))
    both = counted.select(*keys, F.explode(F.array(F.col("role"), F.lit("all"))).alias("role"), "clock", "k")
    per_clock = both.groupBy(*keys, "role", "clock").agg(F.sum("k").alias("k"))
    out = per_clock.groupBy(*keys, "role").agg(
        F.percentile("clock", F.lit(0.5), F.col("k")).alias("seconds"), F.sum("k").alias("samples")
    )
    return out.where(F.col("samples") >= cfg.min_samples)


def look_up(asks: DataFrame, table: DataFrame, generated_at: int, now: int, cfg: TimingConfig) -> DataFrame:
    """Median of an exact key, nothing once the table has expired; never another role's value."""
    live = table if now - generated_at <= cfg.max_age_days * DAY else table.where(F.lit(False))
    a = asks.withColumn("role", F.coalesce("role", F.lit("all")))
    return a.join(live.where(F.col("samples") >= cfg.min_samples), ["hero", "bucket", "role", "item"], "left")


def keep_newest(kept: DataFrame, fresh: DataFrame | None, keys: list[str], limit: int) -> DataFrame:
    """The newest ``limit`` samples of each cell by (start_time, match_id), of what was kept and what is new."""
    both = kept if fresh is None else kept.unionByName(fresh)
    return newest_per_key(both, keys, "start_time", ["match_id"], limit, 30 * DAY)


def validate(table: DataFrame) -> DataFrame:
    """One row of problem counts over a timing table."""
    finite = F.col("seconds").isNotNull() & ~F.isnan("seconds") & (F.abs("seconds") < F.lit(float("inf")))
    return table.agg(
        F.count("*").alias("rows"),
        F.count_if(~F.col("bucket").isin("normal", "turbo")).alias("bad_bucket"),
        F.count_if(~F.col("role").isin("core", "offlane", "support", "all")).alias("bad_role"),
        F.count_if(~finite | (F.col("seconds") < 0)).alias("bad_seconds"),
        F.count_if(F.col("samples") <= 0).alias("bad_samples"),
    )
