"""Weighted contingency sums. One pass over the teams yields every margin of every level.

A player row is exploded by (each owned item and "any") x (each context and "any"); the sums of the
"any" rows are the margins. Map-side aggregation keeps the shuffle at the size of the key space
(bucket x role x hero x context x item), which does not grow with the number of matches.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skirmish.functions.stats import add
from skirmish.session import stage

STRATA = range(4)
KEYS = ["level", "bucket", "role", "hero", "ctx", "y"]
SUMS = [f"{m}{s}" for s in STRATA for m in ("n", "w")] + ["games"]


def count_teams(team_rows: DataFrame, rank_group: str | None = None, by_group: bool = False) -> DataFrame:
    """Sums per (level, bucket, role, hero, ctx, y); null ctx or y means "any".

    ``rank_group`` keeps the players of one group; ``by_group`` makes the group (null: none) one more key.
    """
    group = ["rank_group"] if by_group else []
    any_ctx = F.array(F.struct(F.lit(None).cast("string").alias("level"), F.lit(None).cast("string").alias("ctx")))
    players = team_rows.select(
        "bucket", "stratum", "wt", F.concat("ctxs", any_ctx).alias("ctxs"), F.explode("players").alias("p")
    )
    if rank_group is not None:
        players = players.where(F.col("p.rank_group") == rank_group)
    owned = players.select(
        "bucket", "stratum", "wt", "ctxs",
        F.col("p.role").alias("role"), F.col("p.hero").alias("hero"), *[F.col(f"p.{g}").alias(g) for g in group],
        F.when(F.col("p.win"), F.col("wt")).otherwise(F.lit(0.0)).alias("ww"),
        F.explode(F.concat(F.col("p.ys"), F.array(F.lit(None).cast("int")))).alias("y"),
    )
    cells = owned.select(
        F.explode("ctxs").alias("c"), "bucket", "role", "hero", "y", "stratum", "wt", "ww", *group
    ).select(F.col("c.level").alias("level"), "bucket", "role", "hero", F.col("c.ctx").alias("ctx"), "y", "stratum", "wt", "ww", *group)
    # Three sums a row while the rows are many; strata become columns on the few cells that are left.
    fine = cells.groupBy(*KEYS, *group, "stratum").agg(F.sum("wt").alias("n"), F.sum("ww").alias("w"), F.count("*").alias("games"))
    zero = F.lit(0.0)
    sums = [F.sum(F.when(F.col("stratum") == s, F.col(m)).otherwise(zero)).alias(f"{m}{s}") for s in STRATA for m in ("n", "w")]
    return fine.groupBy(*KEYS, *group).agg(*sums, F.sum("games").alias("games"))


def group_counts(team_rows: DataFrame, groups: Sequence[str]) -> dict[str | None, DataFrame]:
    """Staged sums of all games (``None``) and of each rank group, from one pass over the teams.

    The pass keys its sums by the player's own group; all games are the sum over the groups and over players without
    one, so no row is counted twice on the way and the second shuffle has the size of the key space.
    """
    parts = stage(count_teams(team_rows, by_group=True), "group_counts", ["rank_group"])
    return {None: stage(merge(parts), "counts"), **{g: parts.where(F.col("rank_group") == g).select(*KEYS, *SUMS) for g in groups}}


def merge(*parts: DataFrame) -> DataFrame:
    """Sum partial tables by key (partial sums of batches, days or shards)."""
    total = parts[0].select(*KEYS, *SUMS)
    for p in parts[1:]:
        total = total.unionByName(p.select(*KEYS, *SUMS))
    return total.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in SUMS])


def scaled(counts: DataFrame, factor: float) -> DataFrame:
    """Rebase the recency weights: every weighted sum times one constant."""
    weighted = [c for c in SUMS if c != "games"]
    return counts.select(*KEYS, *[(F.col(c) * F.lit(float(factor))).alias(c) for c in weighted], "games")


def by_class(counts: DataFrame, classes: DataFrame) -> DataFrame:
    """Re-grain hero sums to hero classes; ``hero`` then holds the class name."""
    joined = counts.join(classes.select(F.col("hero"), "cls"), "hero").drop("hero").withColumnRenamed("cls", "hero")
    return joined.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in SUMS])


# ---- margins ---------------------------------------------------------------------------------


def total_n(prefix: str = "n") -> Column:
    return add([F.col(f"{prefix}{s}") for s in STRATA])


def tot(counts: DataFrame) -> DataFrame:
    return counts.where(F.col("ctx").isNull() & F.col("y").isNull()).drop("level", "ctx", "y")


def gy(counts: DataFrame) -> DataFrame:
    return counts.where(F.col("ctx").isNull() & F.col("y").isNotNull()).drop("level", "ctx")


def gx(counts: DataFrame, level: str) -> DataFrame:
    return counts.where((F.col("level") == level) & F.col("y").isNull()).drop("level", "y")


def gxy(counts: DataFrame, level: str) -> DataFrame:
    return counts.where((F.col("level") == level) & F.col("y").isNotNull()).drop("level")


def long(margin: DataFrame) -> DataFrame:
    """One row per stratum that occurred: n, w."""
    keys = [c for c in margin.columns if c not in SUMS]
    cells = F.array(*[F.struct(F.lit(s).alias("stratum"), F.col(f"n{s}").alias("n"), F.col(f"w{s}").alias("w")) for s in STRATA])
    return margin.select(*keys, F.inline(cells)).where(F.col("n") > 0)


class Counts(Protocol):
    """A provider of sums: counted from games or read from a state folder."""

    def table(self, who: str = "hero") -> DataFrame: ...


class GivenCounts:
    """Sums that already are a table; class sums are derived from hero sums."""

    def __init__(self, counts: DataFrame, classes: DataFrame):
        self.counts, self.classes = counts, classes

    def table(self, who: str = "hero") -> DataFrame:
        if who == "hero":
            return self.counts.withColumn("hero", F.col("hero").cast("string"))
        return by_class(self.counts, self.classes)


# ---- overall tables ---------------------------------------------------------------------------


def overall_tot(counts: DataFrame) -> DataFrame:
    return long(tot(counts))


def overall_gy(counts: DataFrame) -> DataFrame:
    return gy(counts).select("bucket", "role", "hero", "y", total_n().alias("n"))


def overall_matchups(counts: DataFrame) -> DataFrame:
    g = gx(counts, "hero")
    return g.groupBy("bucket", "hero", F.col("ctx").cast("int").alias("enemy")).agg(
        F.sum(total_n("n")).alias("n"), F.sum(total_n("w")).alias("w")
    )
