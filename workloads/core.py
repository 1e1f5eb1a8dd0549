"""Preparation, counting, lift, shrinkage and ranked answers on the driver tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skirmish.operators import answers as ans
from skirmish.operators import counts as cnt
from skirmish.operators import dims, heroes as hero_ops, lift, shrink
from skirmish.plans import prepare, recommend
from skirmish.session import settle_dim, stage
from workloads import tables as T
from workloads import twins as W
from workloads.registry import query

LINES, DIMS, GAMES = T.SQL_LINES, T.SQL_DIMS, T.sql_games()
BASE = (LINES, DIMS, GAMES)
KEEP_ALL, SHARES, CLASSES, TEAM = W.NO_ITEMS_LEFT_OUT, W.PARTS_LEFT_OUT, W.CLASSES, W.TEAM


def r6(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n), digits) for n in names})


def players_of(spark: SparkSession, d: str, model=None) -> DataFrame:
    games = prepare.player_games(T.matches(spark, d), T.CFG, T.ranks(spark, d))
    return games if model is None else prepare.with_owned(games, model)


def teams_of(spark: SparkSession, d: str, levels=T.CFG.levels, model=None) -> DataFrame:
    model = model or T.item_model(spark, d)
    return prepare.teams(players_of(spark, d, model), levels)


# ---- preparation -----------------------------------------------------------------------------


@query(
    "games_first_rows",
    T.with_sql(LINES, T.SQL_FIRST.format(where="true")) + "SELECT match_id, hero_id, start_time, net_worth, is_radiant, game_mode FROM first_rows",
)
def games_first_rows(spark, d):
    return prepare.unique_rows(T.matches(spark, d)).select(
        "match_id", "hero_id", "start_time", "net_worth", "is_radiant", "game_mode"
    )


@query(
    "games_prepared",
    T.with_sql(*BASE)
    + """SELECT match_id, start_time, hero, is_radiant, bucket, patch, rank_group, role, stratum, round(wt, 9) AS wt, win,
    array_to_string(list_sort(items), ',') AS items FROM pg""",
)
def games_prepared(spark, d):
    return players_of(spark, d).drop("duration").withColumns(
        {"wt": F.round("wt", 9), "items": F.array_join(F.array_sort("items"), ",")}
    )


@query(
    "games_scan_after_cutoff",
    T.with_sql(LINES, T.sql_plays("1.0::DOUBLE", "start_time >= 883612800 AND game_mode = 23"))
    + "SELECT bucket, role, patch, count(*) AS player_rows, count(DISTINCT match_id) AS matches FROM pg GROUP BY bucket, role, patch",
)
def games_scan_after_cutoff(spark, d):
    where = (F.col("start_time") >= 883612800) & (F.col("game_mode") == 23)
    pg = prepare.player_games(T.matches(spark, d), T.CFG, None, where)
    per_match = pg.groupBy("bucket", "role", "patch", "match_id").agg(F.count("*").alias("rows"))
    return per_match.groupBy("bucket", "role", "patch").agg(
        F.sum("rows").alias("player_rows"), F.count("*").alias("matches")
    )


@query("dataset_facts", T.with_sql(*BASE) + """
SELECT count(DISTINCT match_id) AS matches, count(*) AS player_rows,
       count(DISTINCT match_id) FILTER (WHERE rank_group IS NOT NULL) AS ranked,
       min(start_time) AS first_start, max(start_time) AS last_start,
       (SELECT arg_max(patch, c * 1000 + CAST(split_part(patch, '.', 2) AS INTEGER)) FROM (SELECT patch, count(*) AS c FROM pg GROUP BY patch)) AS patch
FROM pg""")
def dataset_facts(spark, d):
    return prepare.dataset_facts(players_of(spark, d))


@query("matches_per_bucket", T.with_sql(*BASE) + "SELECT bucket, count(DISTINCT match_id) AS matches FROM pg GROUP BY bucket")
def matches_per_bucket(spark, d):
    return prepare.matches_per_bucket(players_of(spark, d))


@query("match_best_rank", T.with_sql(LINES) + "SELECT match_id, max(avg_rank_tier) AS rank_tier FROM ranks GROUP BY match_id")
def match_best_rank(spark, d):
    return prepare.match_ranks(T.ranks(spark, d))


# ---- dimensions (joined to the facts that use them) -------------------------------------------


@query("item_tree_owners", T.with_sql(*BASE) + """
SELECT c.item, c.component, count(*) AS players
FROM (SELECT DISTINCT match_id, is_radiant, hero, unnest(items) AS z FROM pg) p JOIN closure c ON c.item = p.z
GROUP BY c.item, c.component""")
def item_tree_owners(spark, d):
    """Closure of the component graph, and in how many inventories each pair shows up."""
    it = settle_dim(T.items(spark, d))
    closure = settle_dim(dims.component_closure(T.edges(it)))
    owned = players_of(spark, d).select(F.explode(F.array_distinct("items")).alias("item"))
    return owned.join(closure, "item").groupBy("item", "component").agg(F.count("*").alias("players"))


@query("candidate_owners", T.with_sql(*BASE) + """
SELECT p.z AS id, z.id IS NOT NULL AS known, c.y IS NOT NULL AS candidate, k.x IS NOT NULL AS key_item, q.y IS NOT NULL AS part, count(*) AS players
FROM (SELECT unnest(items) AS z FROM pg) p LEFT JOIN items z ON z.id = p.z LEFT JOIN cands c ON c.y = p.z
LEFT JOIN key_items k ON k.x = p.z LEFT JOIN parts q ON q.y = p.z GROUP BY ALL""")
def candidate_owners(spark, d):
    m = T.item_model(spark, d)
    per_item = players_of(spark, d).select(F.explode("items").alias("id")).groupBy("id").agg(F.count("*").alias("players"))

    def flag(df: DataFrame, column: str, name: str) -> DataFrame:
        return df.select(F.col(column).alias("id"), F.lit(True).alias(name)).distinct()

    out = per_item
    for df, column, name in ((m.items, "id", "known"), (m.candidates, "y", "candidate"), (m.key_items, "x", "key_item"), (m.parts, "y", "part")):
        out = out.join(flag(df, column, name), "id", "left").withColumn(name, F.coalesce(name, F.lit(False)))
    return out.select("id", "known", "candidate", "key_item", "part", "players")


@query("mechanic_answer_owners", T.with_sql(*BASE) + """
SELECT a.kind, a.ctx, a.y, a.rule, a.broad, count(o.y) AS owners FROM rule_of a LEFT JOIN owned_y o ON o.y = a.y GROUP BY ALL""")
def mechanic_answer_owners(spark, d):
    """Rules by context and answer item (narrow before broad), with the number of owners of the answer."""
    m = T.item_model(spark, d)
    owners = prepare.owned_answers(players_of(spark, d, m)).groupBy("y").agg(F.count("*").alias("owners"))
    return m.answers.join(owners, "y", "left").select(
        "kind", "ctx", "y", "rule", "broad", F.coalesce("owners", F.lit(0)).alias("owners")
    )


@query("owned_answers", T.with_sql(*BASE) + "SELECT match_id, is_radiant, hero, y FROM owned_y")
def owned_answers(spark, d):
    return prepare.owned_answers(players_of(spark, d, T.item_model(spark, d)))


@query("owned_key_items", T.with_sql(*BASE) + "SELECT match_id, is_radiant, hero, x FROM owned_x")
def owned_key_items(spark, d):
    return prepare.owned_keys(players_of(spark, d, T.item_model(spark, d)))


# ---- contexts --------------------------------------------------------------------------------

CTX_NAMES = {"hero": "enemy_hero", "ally": "ally_hero", "L1": "enemy_hero_item", "L2": "enemy_item", "L3": "enemy_mechanic"}


def _context_query(level: str):
    def run(spark, d):
        return prepare.contexts(teams_of(spark, d, (level,)), level)

    return run


for _level, _name in CTX_NAMES.items():
    query(f"context_{_name}", T.with_sql(*BASE) + W.faced(_level))(_context_query(_level))

# ---- counts ----------------------------------------------------------------------------------


def counts_of(spark, d, levels=T.CFG.levels) -> DataFrame:
    return cnt.count_teams(teams_of(spark, d, levels))


@query("count_totals", T.with_sql(*BASE, KEEP_ALL, W.sums(None)) + W.part_of_sums(False, False))
def count_totals(spark, d):
    return r6(cnt.long(cnt.tot(counts_of(spark, d, ()))), "n", "w", digits=5)


@query("count_owned", T.with_sql(*BASE, KEEP_ALL, W.sums(None)) + W.part_of_sums(False, True))
def count_owned(spark, d):
    return r6(cnt.long(cnt.gy(counts_of(spark, d, ()))), "n", "w", digits=5)


def _count_gx(level):
    return lambda spark, d: r6(cnt.long(cnt.gx(counts_of(spark, d, (level,)), level)), "n", "w", digits=5)


def _count_gxy(level):
    return lambda spark, d: r6(cnt.long(cnt.gxy(counts_of(spark, d, (level,)), level)), "n", "w", digits=5)


for _level, _name in CTX_NAMES.items():
    query(f"count_{_name}", T.with_sql(*BASE, KEEP_ALL, W.sums(_level)) + W.part_of_sums(True, False))(_count_gx(_level))
    query(f"count_{_name}_owned", T.with_sql(*BASE, KEEP_ALL, W.sums(_level)) + W.part_of_sums(True, True))(_count_gxy(_level))


# ---- lift ------------------------------------------------------------------------------------


ROUNDED = "round(lift_a, 6) AS lift_a, round(var_a, 6) AS var_a, round(diff_b, 6) AS diff_b, round(var_b, 6) AS var_b, round(games, 5) AS games"


def metrics_of(spark, d, level: str, who: str = "hero", model=None, min_ctx: float = 0.0) -> DataFrame:
    """Level metrics from scratch, unfinished recipe parts dropped."""
    model = model or T.item_model(spark, d)
    rows = stage(teams_of(spark, d, (level,), model), "teams")
    counts = cnt.count_teams(rows)
    dropped = settle_dim(hero_ops.unfinished(hero_ops.component_share(rows, model.parts), T.CFG))
    counts = stage(recommend.drop_items(counts, dropped), "counts")
    classes = settle_dim(hero_ops.hero_classes(hero_ops.role_counts(counts), model.heroes)) if who == "cls" else None
    return lift.level_metrics(cnt.GivenCounts(counts, classes).table(who), level, T.CFG.min_buy_share, min_ctx)


def rounded_metrics(m: DataFrame) -> DataFrame:
    return r6(r6(m, "lift_a", "var_a", "diff_b", "var_b"), "games", digits=5)


def _lift(level, who="hero", min_ctx=0.0):
    return lambda spark, d: rounded_metrics(metrics_of(spark, d, level, who, None, min_ctx))


for _level, _name in CTX_NAMES.items():
    _floor = T.CFG.conf_mid if _level == "L1" else 0.0
    query(f"lift_{_name}", T.with_sql(*BASE, SHARES, W.level(_level, "met", min_ctx=_floor))
          + f"SELECT bucket, role, CAST(hero AS VARCHAR) AS hero, ctx, y, {ROUNDED} FROM met")(_lift(_level, "hero", _floor))
for _level in ("L2", "hero"):
    query(f"lift_class_{CTX_NAMES[_level]}", T.with_sql(*BASE, SHARES, CLASSES, W.level(_level, "met", "cls"))
          + f"SELECT bucket, role, hero, ctx, y, {ROUNDED} FROM met")(_lift(_level, "cls"))


# ---- shrinkage and answers ---------------------------------------------------------------------

ANSWER_COLS = W.ANSWER_COLS
S_L2 = (*BASE, *W.S_L2)


def _spreads(spark, d, model, levels):
    rows = stage(teams_of(spark, d, levels, model), "teams")
    dropped = settle_dim(hero_ops.unfinished(hero_ops.component_share(rows, model.parts), T.CFG))
    counts = stage(recommend.drop_items(cnt.count_teams(rows), dropped), "counts")
    table = cnt.GivenCounts(counts, None).table()
    l2 = stage(lift.level_metrics(table, "L2", T.CFG.min_buy_share), "l2")
    return rows, counts, table, l2, shrink.spreads(l2, T.CFG), dropped


@query("spread_of_effects", T.with_sql(*BASE, SHARES, W.level("L2", "met_l2"), W.spread("met_l2")) + "SELECT metric, round(tau2, 8) AS tau2, round(k, 4) AS k FROM spread")
def spread_of_effects(spark, d):
    l2 = stage(metrics_of(spark, d, "L2"), "l2")
    return r6(r6(shrink.spread_table(l2, T.CFG), "tau2", digits=8), "k", digits=4).drop("estimated")


SMOOTH_COLS = "bucket, role, CAST(hero AS VARCHAR) AS hero, ctx, y, round(a_s, 6) AS a_s, round(va_s, 7) AS va_s, round(b_s, 6) AS b_s, round(vb_s, 7) AS vb_s"


def _smooth_rows(df):
    return r6(r6(df.select("bucket", "role", "hero", "ctx", "y", "a_s", "va_s", "b_s", "vb_s"), "a_s", "b_s"), "va_s", "vb_s", digits=7)


@query("shrunk_enemy_item", T.with_sql(*S_L2) + f"SELECT {SMOOTH_COLS} FROM s_l2")
def shrunk_enemy_item(spark, d):
    model = T.item_model(spark, d)
    _, _, table, l2, eb, _ = _spreads(spark, d, model, ("L3", "L2"))
    l3 = stage(lift.level_metrics(table, "L3", T.CFG.min_buy_share), "l3")
    return _smooth_rows(shrink.smooth(l2, eb, shrink.prior_from_mechanics(l2, l3, model.x_mech)))


S_L1 = (*S_L2, W.level("L1", "met_l1", min_ctx=T.CFG.conf_mid), W.ITEMS_PRIOR, W.shrunk("met_l1", "s_l1", "items_prior", "split_part(s.ctx, ':', 2)"))


@query("shrunk_enemy_hero_item", T.with_sql(*S_L1) + f"SELECT {SMOOTH_COLS} FROM s_l1")
def shrunk_enemy_hero_item(spark, d):
    model = T.item_model(spark, d)
    _, _, table, l2, eb, _ = _spreads(spark, d, model, ("L3", "L2", "L1"))
    l3 = stage(lift.level_metrics(table, "L3", T.CFG.min_buy_share), "l3")
    s_l2 = stage(shrink.smooth(l2, eb, shrink.prior_from_mechanics(l2, l3, model.x_mech)), "s_l2")
    l1 = stage(lift.level_metrics(table, "L1", T.CFG.min_buy_share, T.CFG.conf_mid), "l1")
    return _smooth_rows(shrink.smooth(l1, eb, shrink.prior_from_items(l1, s_l2)))


def _answer_rows(df):
    return r6(r6(df, "score", "games", digits=5), "a_s", "b_s")


def recs_of(spark, d, cfg=T.SOLO, where=None, tables=recommend.ALL_TABLES):
    return recommend.recommendations(T.matches(spark, d), T.item_model(spark, d, cfg), cfg, T.ranks(spark, d), where, None, tables)


def _one(spark, d, name, cfg=T.SOLO):
    return _answer_rows(recs_of(spark, d, cfg, None, (name,))[name])


@query("answers_enemy_item", T.with_sql(*S_L2, W.ranked("s_l2", [("x", "s.ctx")])) + f"SELECT {ANSWER_COLS} FROM placed WHERE place <= 6")
def answers_enemy_item(spark, d):
    return _one(spark, d, "item")


@query("answers_enemy_hero_item", T.with_sql(*S_L1, W.ranked("s_l1", [("x", "split_part(s.ctx, ':', 2)"), ("e", "split_part(s.ctx, ':', 1)")], True))
       + f"SELECT {ANSWER_COLS} FROM placed WHERE place <= 6")
def answers_enemy_hero_item(spark, d):
    return _one(spark, d, "item_hero", T.CFG)


S_HERO = (*BASE, SHARES, W.level("L2", "met_l2"), W.spread("met_l2"), W.level("hero", "met_h"), W.shrunk("met_h", "s_h"))


@query("answers_enemy_hero", T.with_sql(*S_HERO, W.ranked("s_h", [("e", "s.ctx")])) + f"SELECT {ANSWER_COLS} FROM placed WHERE place <= 6")
def answers_enemy_hero(spark, d):
    return _one(spark, d, "hero")


ALL_AND_GROUPS = ("all", *T.CFG.rank_groups)


def _each_group(select, *parts) -> str:
    """SQL: one block of CTEs for all games and for each rank group, over ``games_of``."""
    blocks = []
    for g in ALL_AND_GROUPS:
        games_of = "games_of AS (SELECT * FROM pg" + ("" if g == "all" else f" WHERE rank_group = '{g}'") + ")"
        blocks.append(f"SELECT '{g}' AS rank_group, * FROM (" + T.with_sql(games_of, *parts) + select + ")")
    return T.with_sql(*BASE, SHARES) + " UNION ALL ".join(blocks)


def _any_group(frames: dict) -> DataFrame:
    named = [df.select(F.lit(g or "all").alias("rank_group"), "*") for g, df in frames.items()]
    return reduce(DataFrame.unionByName, named)


@query("rank_group_counts", _each_group(W.part_of_sums(True, True), W.sums("hero", games="games_of")).replace(SHARES, KEEP_ALL))
def rank_group_counts(spark, d):
    frames = cnt.group_counts(teams_of(spark, d, ("hero",)), list(T.CFG.rank_groups))
    return _any_group({g: r6(cnt.long(cnt.gxy(c, "hero")), "n", "w", digits=5) for g, c in frames.items()})


@query("rank_group_answers", _each_group(f"SELECT {ANSWER_COLS} FROM placed WHERE place <= 6", W.level("L2", "met_l2", games="games_of"), W.spread("met_l2"),
       W.level("hero", "met_h", games="games_of"), W.shrunk("met_h", "s_h"), W.ranked("s_h", [("e", "s.ctx")])))
def rank_group_answers(spark, d):
    cfg = T.SOLO.with_(store_rank_groups=True)
    recs = recommend.group_recommendations(T.matches(spark, d), T.item_model(spark, d), cfg, T.ranks(spark, d), ("hero",))
    return _any_group({g: _answer_rows(r["hero"]) for g, r in recs.items()})


@query("answers_class_enemy_hero", T.with_sql(*BASE, SHARES, CLASSES, W.level("L2", "met_l2"), W.spread("met_l2"), W.level("hero", "met_h", "cls"),
       W.shrunk("met_h", "s_h"), W.ranked("s_h", [("e", "s.ctx")])) + f"SELECT {ANSWER_COLS} FROM placed WHERE place <= 6")
def answers_class_enemy_hero(spark, d):
    return _one(spark, d, "hero_class")


@query("answers_ally", T.with_sql(*BASE, SHARES, TEAM, W.level("L2", "met_l2"), W.spread("met_l2"), W.level("ally", "met_a"), W.shrunk("met_a", "s_a")) + """
SELECT bucket, role, hero::VARCHAR AS hero, ctx, row_number() OVER (PARTITION BY bucket, role, hero, ctx ORDER BY round(a_s, 9), y)::INTEGER AS place, y,
       0::DOUBLE AS score, round(a_s, 6) AS a_s, NULL::DOUBLE AS b_s, if(games < 20, 'low', if(games < 60, 'mid', 'high')) AS conf,
       round(games, 5) AS games, NULL::VARCHAR AS rule
FROM s_a SEMI JOIN team_items USING (bucket, y)
WHERE ctx <> hero::VARCHAR AND a_s * 100 <= -1 AND a_s < -1.645 * sqrt(greatest(coalesce(va_s, 0), 0))""")
def answers_ally(spark, d):
    return _one(spark, d, "ally")


# ---- heroes ----------------------------------------------------------------------------------


@query("hero_classes", T.with_sql(*BASE, CLASSES) + "SELECT hero, cls, main_role FROM classes")
def hero_classes(spark, d):
    return hero_ops.hero_classes(hero_ops.role_counts(counts_of(spark, d, ())), T.heroes(spark, d))


@query("component_share", T.with_sql(*BASE, SHARES) + "SELECT y, round(share, 6) AS share, players, itself FROM component_share")
def component_share(spark, d):
    m = T.item_model(spark, d)
    return r6(hero_ops.component_share(teams_of(spark, d, (), m), m.parts), "share")


@query("team_pairs", T.with_sql(*BASE, SHARES, TEAM) + "SELECT bucket, y, pairs, round(expected, 5) AS expected FROM team_pairs")
def team_pairs(spark, d):
    return r6(hero_ops.team_counts(stage(teams_of(spark, d, ()), "teams")), "expected", digits=5)


@query("team_items", T.with_sql(*BASE, SHARES, TEAM) + """
SELECT bucket, y, round(pairs / expected, 6) AS ratio, round(expected, 5) AS expected, pairs / expected <= 0.98 AS is_team
FROM team_pairs ANTI JOIN dropped USING (y) WHERE expected >= 2""")
def team_items(spark, d):
    m = T.item_model(spark, d)
    rows = stage(teams_of(spark, d, (), m), "teams")
    dropped = hero_ops.unfinished(hero_ops.component_share(rows, m.parts), T.CFG)
    return r6(r6(hero_ops.classify_team_items(hero_ops.team_counts(rows), dropped, T.CFG), "ratio"), "expected", digits=5)


@query("role_shares", T.with_sql(*BASE) + """
SELECT bucket, hero, role, round(n / sum(n) OVER (PARTITION BY bucket, hero), 6) AS share FROM
(SELECT bucket, hero, role, sum(wt) AS n FROM pg GROUP BY ALL)""")
def role_shares(spark, d):
    return r6(hero_ops.role_shares(counts_of(spark, d, ())), "share")


@query("late_strength", T.with_sql(*BASE) + """
SELECT bucket, hero, round(late, 6) AS late, round(n_late, 5) AS n_late, round(n_early, 5) AS n_early FROM (
  SELECT bucket, hero, sum(wt * win::INT) FILTER (WHERE stratum = 3) / nullif(sum(wt) FILTER (WHERE stratum = 3), 0)
    - sum(wt * win::INT) FILTER (WHERE stratum = 0) / nullif(sum(wt) FILTER (WHERE stratum = 0), 0) AS late,
    sum(wt) FILTER (WHERE stratum = 3) AS n_late, sum(wt) FILTER (WHERE stratum = 0) AS n_early
  FROM pg GROUP BY ALL) WHERE late IS NOT NULL""")
def late_strength(spark, d):
    return r6(r6(hero_ops.late_strength(counts_of(spark, d, ())), "late"), "n_late", "n_early", digits=5)


@query("hero_matchups", T.with_sql(*BASE) + """
, hw AS (SELECT bucket, hero, sum(wt * win::INT) / sum(wt) AS wr FROM pg GROUP BY ALL),
mu AS (SELECT g.bucket, g.hero, e.hero AS enemy, sum(g.wt) AS n, sum(g.wt * g.win::INT) AS w FROM pg g JOIN pg e ON e.match_id = g.match_id AND e.is_radiant <> g.is_radiant GROUP BY ALL)
SELECT mu.bucket, mu.enemy, mu.hero, round((mu.w / mu.n - hw.wr) * mu.n / (mu.n + 800.0), 6) AS delta, round(mu.n, 5) AS n FROM mu JOIN hw USING (bucket, hero)""")
def hero_matchups(spark, d):
    return r6(r6(hero_ops.matchups(counts_of(spark, d, ("hero",)), 800.0), "delta"), "n", digits=5)


@query("overall_owned", T.with_sql(*BASE) + """
SELECT p.bucket, p.role, p.hero, o.y, round(sum(p.wt), 5) AS n FROM pg p JOIN owned_y o USING (match_id, is_radiant, hero) GROUP BY ALL""")
def overall_owned(spark, d):
    return r6(cnt.overall_gy(counts_of(spark, d, ())), "n", digits=5)


BUYS = """
bt AS (SELECT bucket, role, hero, sum(wt) AS n FROM pg GROUP BY ALL),
bo AS (SELECT p.bucket, p.role, p.hero, o.y, sum(p.wt) AS k FROM pg p JOIN owned_y o USING (match_id, is_radiant, hero) GROUP BY ALL)"""


@query("hero_buys", T.with_sql(*BASE, SHARES, BUYS) + """
SELECT bucket, role, hero, array_to_string(list(y ORDER BY y), ',') AS items FROM bo JOIN bt USING (bucket, role, hero)
WHERE k >= 0.03 * n AND y NOT IN (SELECT y FROM dropped) GROUP BY ALL""")
def hero_buys(spark, d):
    m = T.item_model(spark, d)
    rows = stage(teams_of(spark, d, (), m), "teams")
    dropped = hero_ops.unfinished(hero_ops.component_share(rows, m.parts), T.CFG)
    out = hero_ops.buys(hero_ops.bought_shares(stage(cnt.count_teams(rows), "counts")), dropped, T.CFG)
    return out.withColumn("items", F.array_join("items", ","))


@query("hero_buy_shares", T.with_sql(*BASE, BUYS) + """
SELECT bucket, role, hero, y, round(100.0 * k / n, 1) AS pct, row_number() OVER (PARTITION BY bucket, role, hero ORDER BY k DESC, y) AS place
FROM bo JOIN bt USING (bucket, role, hero) WHERE k >= 0.01 * n""")
def hero_buy_shares(spark, d):
    out = hero_ops.buy_shares(hero_ops.bought_shares(stage(counts_of(spark, d, ()), "counts")), T.CFG)
    return out.select("bucket", "role", "hero", F.posexplode("items").alias("pos", "e")).select(
        "bucket", "role", "hero", F.col("e.y").alias("y"), F.col("e.pct").alias("pct"), (F.col("pos") + 1).cast("bigint").alias("place")
    )


# The flagship, also used by entry().
def flagship(spark, d):
    """Which items do players of a hero buy more often against an enemy hero?"""
    return _one(spark, d, "hero")
