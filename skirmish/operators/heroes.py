"""Hero classes, unfinished recipe parts, team items, role shares, match-ups, purchases."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skirmish.config import Config
from skirmish.functions.game import role_strength
from skirmish.operators.counts import gy, overall_matchups, total_n, tot


def role_counts(counts: DataFrame) -> DataFrame:
    return tot(counts).groupBy("hero", "role").agg(F.sum("games").alias("c"))


def hero_classes(roles: DataFrame, heroes: DataFrame) -> DataFrame:
    """(hero, cls, main_role): attribute and the role played most; core > offlane > support on a tie."""
    score = F.col("c") * 10 + role_strength(F.col("role"))
    main = roles.groupBy("hero").agg(F.max_by("role", score).alias("main_role"))
    attr = heroes.select("hero", "attr")
    return main.join(attr, "hero", "left").select(
        "hero", F.concat_ws("-", F.coalesce("attr", F.lit("all")), "main_role").alias("cls"), "main_role"
    )


def component_share(team_rows: DataFrame, parts: DataFrame) -> DataFrame:
    """How often the owners of a recipe part end the game with the part itself: (y, share, players, itself)."""
    owners = team_rows.select(F.explode("players").alias("p")).select(
        F.explode("p.ys").alias("y"), F.col("p.finals").alias("finals")
    )
    owners = owners.join(parts, "y", "left_semi")
    itself = F.array_contains("finals", F.col("y")).cast("int")
    return owners.groupBy("y").agg(F.count("*").alias("players"), F.sum(itself).alias("itself")).select(
        "y", (F.col("itself") / F.col("players")).alias("share"), "players", "itself"
    )


def unfinished(shares: DataFrame, cfg: Config) -> DataFrame:
    return shares.where(F.col("share") < cfg.component_final_share).select("y")


def team_counts(team_rows: DataFrame, owner_odds: DataFrame | None = None) -> DataFrame:
    """(bucket, y, pairs, expected): pairs of owners in one team, seen and expected if all bought alone.

    How often two (hero, role) play together is counted once for all items: pairs are made inside a team's row and
    summed before the shuffle, so it carries the key space. Only these counts meet the odds of the items. The pairs seen
    are counted inside a row, too.
    """
    players = F.transform("players", lambda p: F.struct(p["hero"].alias("hero"), p["role"].alias("role")))
    rest = lambda i: F.slice("mates_", i + 2, F.size("mates_"))
    both = lambda a, b: F.array_sort(F.array(a, b))
    pairs = F.flatten(F.transform("mates_", lambda a, i: F.transform(rest(i), lambda b: both(a, b))))
    mates = team_rows.select("bucket", players.alias("mates_")).select("bucket", F.explode(pairs).alias("m"))
    mates = mates.groupBy("bucket", F.col("m")[0].alias("a"), F.col("m")[1].alias("b")).agg(F.count("*").alias("times"))
    odds = owner_odds
    if odds is None:
        odds = purchase_odds(team_rows.select("bucket", F.explode("players").alias("p")).select("bucket", "p.role", "p.hero", "p.ys"))
    odds = odds.select("bucket", F.struct("hero", "role").alias("who"), "y", "p")
    of_a = odds.select("bucket", F.col("who").alias("a"), "y", F.col("p").alias("p_a"))
    of_b = odds.select("bucket", F.col("who").alias("b"), "y", F.col("p").alias("p_b"))
    met = mates.join(of_a, ["bucket", "a"]).join(of_b, ["bucket", "b", "y"])
    expected = met.groupBy("bucket", "y").agg(F.sum(F.col("times") * F.col("p_a") * F.col("p_b")).alias("expected"))
    owned = F.flatten(F.transform("players", lambda p: p["ys"]))
    seen = team_rows.select("bucket", owned.alias("all_")).select("bucket", "all_", F.explode(F.array_distinct("all_")).alias("y"))
    k = F.size(F.filter("all_", lambda x: x == F.col("y")))
    seen = seen.groupBy("bucket", "y").agg(F.sum(k * (k - 1) / 2).alias("pairs"))
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    return seen.join(expected, ["bucket", "y"], "left").select("bucket", "y", zero("pairs"), zero("expected"))


def purchase_odds(players: DataFrame) -> DataFrame:
    """(bucket, role, hero, y, p): share of the hero's games in the role that own the item."""
    key = ["bucket", "role", "hero"]
    marked = players.select(*key, F.explode(F.concat("ys", F.array(F.lit(None).cast("int")))).alias("y"))
    sums = marked.groupBy(*key, "y").agg(F.count("*").alias("k"))
    games = sums.where(F.col("y").isNull()).select(*key, F.col("k").alias("n"))
    return sums.where(F.col("y").isNotNull()).join(games, key).select(*key, "y", (F.col("k") / F.col("n")).alias("p"))


def classify_team_items(team_cnt: DataFrame, dropped: DataFrame, cfg: Config) -> DataFrame:
    """(bucket, y, ratio, expected, is_team) for items with enough expected pairs."""
    known = team_cnt.where(F.col("expected") >= cfg.team_item_min_pairs).join(dropped, "y", "left_anti")
    ratio = F.col("pairs") / F.col("expected")
    return known.select("bucket", "y", ratio.alias("ratio"), "expected", (ratio <= cfg.team_item_max_ratio).alias("is_team"))


def team_items(team_cnt: DataFrame, dropped: DataFrame, cfg: Config) -> DataFrame:
    return classify_team_items(team_cnt, dropped, cfg).where("is_team").select("bucket", "y")


# ---- what a hero is like as an enemy --------------------------------------------------------


def role_shares(counts: DataFrame) -> DataFrame:
    """(bucket, hero, role, share): weighted share of a hero's games in each role."""
    per_role = tot(counts).groupBy("bucket", "hero", "role").agg(F.sum(total_n()).alias("n"))
    all_roles = F.sum("n").over(Window.partitionBy("bucket", "hero"))
    return per_role.select("bucket", "hero", "role", (F.col("n") / all_roles).alias("share"))


def late_strength(counts: DataFrame) -> DataFrame:
    """(bucket, hero, late, n_late, n_early): win rate in the longest games minus the shortest."""
    s = tot(counts).groupBy("bucket", "hero").agg(*[F.sum(c).alias(c) for c in ("n0", "w0", "n3", "w3")])
    late = F.try_divide(F.col("w3"), F.col("n3")) - F.try_divide(F.col("w0"), F.col("n0"))
    return s.select("bucket", "hero", late.alias("late"), F.col("n3").alias("n_late"), F.col("n0").alias("n_early")).where(
        F.col("late").isNotNull()
    )


def matchups(counts: DataFrame, k_b: float) -> DataFrame:
    """(bucket, enemy, hero, delta, n): win-rate change against an enemy, shrunk to zero by k_b games."""
    t = tot(counts)
    wr = t.groupBy("bucket", "hero").agg((F.sum(total_n("w")) / F.sum(total_n("n"))).alias("wr"))
    m = overall_matchups(counts)
    delta = (F.col("w") / F.col("n") - F.col("wr")) * F.col("n") / (F.col("n") + F.lit(float(k_b)))
    return m.join(wr, ["bucket", "hero"]).select("bucket", "enemy", "hero", delta.alias("delta"), "n")


# ---- what a hero buys -----------------------------------------------------------------------


def bought_shares(counts: DataFrame) -> DataFrame:
    """(bucket, role, hero, y, k, n): weighted games with the item and in total."""
    who = ["bucket", "role", "hero"]
    t = tot(counts).select(*who, total_n().alias("n"))
    return gy(counts).select(*who, "y", total_n().alias("k")).join(t, who)


def buys(shares: DataFrame, dropped: DataFrame, cfg: Config) -> DataFrame:
    """(bucket, role, hero, items): items bought in at least the minimum share of games, by id."""
    kept = shares.where(F.col("k") >= cfg.min_buy_share * F.col("n")).join(dropped, "y", "left_anti")
    return kept.groupBy("bucket", "role", "hero").agg(F.sort_array(F.collect_list("y")).alias("items"))


def buy_shares(shares: DataFrame, cfg: Config) -> DataFrame:
    """(bucket, role, hero, items[(y, pct)]): purchase shares in percent, most frequent first."""
    kept = shares.where(F.col("k") >= cfg.buy_share_floor * F.col("n"))
    pct = F.round(F.col("k") * 100.0 / F.col("n"), 1)
    entry = F.struct((-F.col("k")).alias("o"), F.col("y").alias("y"), pct.alias("pct"))
    ordered = F.sort_array(F.collect_list(entry))
    return kept.groupBy("bucket", "role", "hero").agg(
        F.transform(ordered, lambda e: F.struct(e["y"].alias("y"), e["pct"].alias("pct"))).alias("items")
    )
