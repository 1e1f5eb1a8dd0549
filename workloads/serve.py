"""Serving, validation, text, profiles and reports on the driver tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from skirmish.config import HintConfig
from skirmish.functions import game, text as tx
from skirmish.functions.stats import percent
from skirmish.operators import advise as adv
from skirmish.operators import counts as cnt
from skirmish.operators import cube as cube_ops
from skirmish.operators import heroes as hero_ops
from skirmish.operators import hints, lift, profile, reports, tags, threats, timings, uplift, validate, wiki
from skirmish.operators.rows import top_per_key
from skirmish.plans import prepare, recommend
from skirmish.session import settle_dim, size_shuffles, small_table, stage
from skirmish.sources import keyed, slices
from workloads import tables as T
from workloads import tables2 as T2
from workloads import twins as W
from workloads.core import BASE, BUYS, CLASSES, DIMS, GAMES, LINES, S_HERO, SHARES, counts_of, players_of, r6, recs_of, teams_of
from workloads.registry import query

EV = T2.SQL_EVENTS

# ---- count cube --------------------------------------------------------------------------------

CUBE = """
pl AS (
  SELECT p.match_id, p.is_radiant, p.hero, p.bucket, p.win, p.items, l.duration, p.role,
         row_number() OVER (PARTITION BY p.match_id, p.is_radiant ORDER BY l.net_worth DESC, p.hero) AS place
  FROM pg p JOIN first_rows l ON l.match_id = p.match_id AND l.hero_id = p.hero
),
mine AS (SELECT match_id, hero, y AS item FROM owned_y),
foes AS (SELECT p.match_id, p.hero, 'hero' AS t, CAST(e.hero AS VARCHAR) AS ctx FROM pl p JOIN pl e ON e.match_id = p.match_id AND e.is_radiant <> p.is_radiant
  UNION SELECT p.match_id, p.hero, 'trait', h.mech FROM pl p JOIN pl e ON e.match_id = p.match_id AND e.is_radiant <> p.is_radiant JOIN hero_traits h ON h.hero = e.hero
  UNION SELECT p.match_id, p.hero, 'item', CAST(x.x AS VARCHAR) FROM pl p JOIN owned_x x ON x.match_id = p.match_id AND x.is_radiant <> p.is_radiant),
cube AS (
  SELECT "table", bucket, hero, ctx, item, count(*) AS games, CAST(sum(win::INT) AS BIGINT) AS wins FROM (
    SELECT 'hero' AS "table", bucket, hero, '' AS ctx, '' AS item, win FROM pl
    UNION ALL SELECT 'base', bucket, p.hero, '', CAST(item AS VARCHAR), win FROM pl p JOIN mine USING (match_id, hero)
    UNION ALL SELECT CASE t WHEN 'hero' THEN 'pair' ELSE t || '_games' END, bucket, p.hero, ctx, '', win FROM pl p JOIN foes USING (match_id, hero)
    UNION ALL SELECT 'vs_' || t, bucket, p.hero, ctx, CAST(item AS VARCHAR), win FROM pl p JOIN foes USING (match_id, hero) JOIN mine USING (match_id, hero)
    UNION ALL SELECT 'length', bucket, hero, CASE WHEN duration < 1800 THEN 'short' ELSE 'long' END, '', win FROM pl WHERE duration < 1800 OR duration > 2400
  ) GROUP BY ALL
)"""
CUBE_BASE = (*BASE, CUBE)


def cube_players(spark, d, model=None):
    """Player rows for the cube: enemies, their traits and items, own answers, all distinct."""
    model = model or T.item_model(spark, d)
    full = prepare.teams(prepare.with_owned(prepare.player_games(T.matches(spark, d), T.CFG), model), ("hero", "L2"))
    traits = {}
    for r in T.hero_traits(T.heroes(spark, d)).collect():
        traits.setdefault(r["hero"], []).append(r["mech"])
    lookup = F.create_map(*[x for h, ms in sorted(traits.items()) for x in (F.lit(str(h)), F.array(*map(F.lit, sorted(ms))))])
    ctx = lambda level: F.transform(F.filter("ctxs", lambda c: c["level"] == level), lambda c: c["ctx"])
    none = F.array().cast("array<string>")
    rows = full.withColumns({"enemies": ctx("hero"), "enemy_items": ctx("L2")}).withColumn(
        "enemy_traits", F.array_distinct(F.flatten(F.transform("enemies", lambda e: F.coalesce(lookup[e], none))))
    )
    return rows.select("match_id", "is_radiant", "bucket", "duration", "enemies", "enemy_items", "enemy_traits", F.explode("players").alias("p")).select(
        "bucket", F.col("p.hero").alias("hero"), F.col("p.win").alias("win"), "duration", F.col("p.ys").alias("answers"), "enemies", "enemy_traits", "enemy_items",
        "match_id", "is_radiant",
    )


def cube_of(spark, d):
    return cube_ops.count_cube(cube_players(spark, d))


@query("count_cube", T.with_sql(*CUBE_BASE) + 'SELECT "table", bucket, hero, ctx, item, games, wins FROM cube')
def count_cube(spark, d):
    return cube_of(spark, d)


@query("count_cube_pruned", T.with_sql(*CUBE_BASE) + 'SELECT "table", count(*) AS cells, CAST(sum(games) AS BIGINT) AS games FROM cube WHERE games >= 20 GROUP BY "table"')
def count_cube_pruned(spark, d):
    return cube_ops.prune(cube_of(spark, d), 20).groupBy("table").agg(F.count("*").alias("cells"), F.sum("games").alias("games"))


def farm_of(spark, d):
    rows = prepare.unique_rows(T.matches(spark, d))
    place = F.row_number().over(Window.partitionBy("match_id", "is_radiant").orderBy(F.col("net_worth").desc(), "hero_id"))
    return cube_ops.farm(rows.select(F.when(F.col("game_mode") == 23, "turbo").otherwise("normal").alias("bucket"), F.col("hero_id").alias("hero"), place.alias("place")))


@query("farm_places", T.with_sql(*CUBE_BASE) + """
SELECT bucket, hero, round(sum(place) / count(*), 6) AS farm_rank, round(avg(win::INT) * 100, 6) AS winrate FROM pl GROUP BY ALL""")
def farm_places(spark, d):
    return r6(cube_ops.rates(farm_of(spark, d), cube_of(spark, d)), "farm_rank", "winrate")


# ---- uplift and tiered advice --------------------------------------------------------------------

ASKS = """
asks AS (
  SELECT c.custkey AS request, 'normal' AS bucket, CAST(c.custkey % 12 + 1 AS INTEGER) AS hero, CAST((c.custkey + e) % 12 + 1 AS INTEGER) AS enemy, e AS slot
  FROM (SELECT DISTINCT o_custkey AS custkey FROM orders) c, (VALUES (1), (5)) x(e)
)"""


def asks(spark, d):
    """Two threats for the hero of every customer."""
    c = T.read(spark, d, "orders").select(F.col("o_custkey").alias("request")).distinct()
    return c.select("request", F.lit("normal").alias("bucket"), (F.col("request") % 12 + 1).cast("int").alias("hero"), F.explode(F.array(F.lit(1), F.lit(5))).alias("slot")).withColumn(
        "enemy", ((F.col("request") + F.col("slot")) % 12 + 1).cast("int"))


UPLIFT = """
hero_n AS (SELECT bucket, hero, games AS hn FROM cube WHERE "table" = 'hero'),
base_n AS (SELECT bucket, hero, item, games AS bn, wins AS bw FROM cube WHERE "table" = 'base'),
cand AS (
  SELECT a.request, a.bucket, a.hero, a.enemy, b.item, b.bn, b.bw, b.bn / h.hn AS share FROM asks a JOIN hero_n h USING (bucket, hero) JOIN base_n b USING (bucket, hero)
  WHERE b.bn >= 5 AND b.bn / h.hn >= 0.03
),
looks AS (
  SELECT c.*, t.tier, t.o, t.ctx, coalesce(v.games, 0) AS cn, coalesce(v.wins, 0) AS cw, coalesce(g.games, 0) AS gn
  FROM cand c JOIN (SELECT hero AS enemy, 'hero' AS tier, 0 AS o, CAST(hero AS VARCHAR) AS ctx, 'vs_hero' AS tb, 'pair' AS tg FROM heroes
                    UNION ALL SELECT hero, 'trait', 2, mech, 'vs_trait', 'trait_games' FROM hero_traits) t USING (enemy)
  LEFT JOIN cube v ON v."table" = t.tb AND v.bucket = c.bucket AND v.hero = c.hero AND v.ctx = t.ctx AND v.item = c.item
  LEFT JOIN cube g ON g."table" = t.tg AND g.bucket = c.bucket AND g.hero = c.hero AND g.ctx = t.ctx
),
sc AS (
  SELECT *, (cn / nullif(gn, 0) - share) * 100 AS delta,
    (cn / nullif(gn, 0) - share) * 100 - 1.64 * sqrt(greatest(cn / nullif(gn, 0), share, 0.01) * (1 - greatest(cn / nullif(gn, 0), share, 0.01)) / nullif(gn, 0)) * 100 AS low,
    coalesce(cn >= 50 AND bn > 0 AND (cw / nullif(cn, 0) - bw / bn) + 1.64 * sqrt(cw / nullif(cn, 0) * (1 - cw / nullif(cn, 0)) / nullif(cn, 0) + bw / bn * (1 - bw / bn) / bn) < 0, false) AS bad
  FROM looks
),
best AS (
  SELECT request, enemy, item, any_value(share) AS share, arg_min(struct_pack(s := low, t := tier, d := delta, g := gn), struct_pack(l := -low, o := o, x := ctx)) FILTER (WHERE gn >= 20 AND low > 0) AS b
  FROM sc GROUP BY request, enemy, item HAVING NOT bool_or(bad)
),
up AS (SELECT request, enemy, item, coalesce(b.s, share - 1.0) AS score, coalesce(b.t, 'mechanic') AS tier FROM best),
keyed AS (SELECT *, score + CASE WHEN tier <> 'mechanic' THEN greatest(1, sum((tier <> 'mechanic')::INT) OVER (PARTITION BY request, item)) - 1 ELSE 0 END AS k FROM up),
placed AS (SELECT k.*, row_number() OVER (PARTITION BY request, enemy ORDER BY round(k, 9) DESC, coalesce(i.cost, 0), k.item) AS place
  FROM keyed k LEFT JOIN items i ON CAST(i.id AS VARCHAR) = k.item)"""


@query("uplift_recommendations", T.with_sql(*CUBE_BASE, ASKS, UPLIFT) + "SELECT request, enemy, item, tier, round(score, 6) AS score, CAST(place AS INTEGER) AS place FROM placed WHERE place <= 2")
def uplift_recommendations(spark, d):
    cube = stage(cube_of(spark, d), "cube")
    he = settle_dim(T.heroes(spark, d))

    def look(df, tier, ctx, table, total):
        return df.select(F.col("hero").alias("threat"), F.struct(F.lit(tier).alias("tier"), F.lit(table).alias("table"), F.lit(total).alias("total"), F.col(ctx).cast("string").alias("ctx")).alias("c"))

    looks = look(he, "hero", "hero", "vs_hero", "pair").unionByName(look(T.hero_traits(he), "trait", "mech", "vs_trait", "trait_games"))
    per_threat = looks.groupBy("threat").agg(F.collect_list("c").alias("contexts"))
    base = cube.where("table = 'base'").select("bucket", "hero", "item")
    wanted = asks(spark, d).withColumnRenamed("enemy", "threat").join(base, ["bucket", "hero"]).join(per_threat, "threat").drop("slot")
    scores = uplift.uplift_scores(wanted, cube, T.UPLIFT)
    costs = T.items(spark, d).select(F.col("id").cast("string").alias("item"), "cost")
    out = uplift.recommend_uplift(scores, costs, T.UPLIFT)
    return r6(out.select("request", F.col("threat").alias("enemy"), "item", "tier", "score", "place"), "score")


@query("tiered_item_advice", T.with_sql(*CUBE_BASE, ASKS) + """
, q AS (SELECT a.request, a.bucket, a.hero, b.item, a.slot, a.enemy, b.games AS bn, b.wins AS bw, CAST((a.request % 20) + 1 AS VARCHAR) AS ei, 'm' || (a.request % 3) AS tr
  FROM asks a JOIN cube b ON b."table" = 'base' AND b.bucket = a.bucket AND b.hero = a.hero WHERE b.games >= 5),
j AS (SELECT q.*, i.games AS gi, i.wins AS wi, h.games AS gh, h.wins AS wh, t.games AS gt, t.wins AS wt FROM q
  LEFT JOIN cube i ON i."table" = 'vs_item' AND i.bucket = q.bucket AND i.hero = q.hero AND i.ctx = q.ei AND i.item = q.item
  LEFT JOIN cube h ON h."table" = 'vs_hero' AND h.bucket = q.bucket AND h.hero = q.hero AND h.ctx = CAST(q.enemy AS VARCHAR) AND h.item = q.item
  LEFT JOIN cube t ON t."table" = 'vs_trait' AND t.bucket = q.bucket AND t.hero = q.hero AND t.ctx = q.tr AND t.item = q.item),
v AS (SELECT request, slot, item, CASE WHEN gi >= 20 OR gh >= 20 THEN 'hero' WHEN gt >= 20 THEN 'trait' ELSE 'base' END AS tier,
  CASE WHEN gi >= 20 THEN gi WHEN gh >= 20 THEN gh WHEN gt >= 20 THEN gt ELSE bn END AS games,
  (CASE WHEN gi >= 20 THEN wi WHEN gh >= 20 THEN wh WHEN gt >= 20 THEN wt ELSE bw END) * 100.0::DOUBLE AS w100, bw * 100.0::DOUBLE / bn AS bwr FROM j)
SELECT request, slot, tier, count(*) AS items, CAST(sum(games) AS BIGINT) AS games, round(max(w100 / games - CASE WHEN tier = 'base' THEN 0 ELSE bwr END), 1) AS best FROM v GROUP BY request, slot, tier""")
def tiered_item_advice(spark, d):
    cube = stage(cube_of(spark, d), "cube")
    base = cube.where("table = 'base'").select("bucket", "hero", "item")
    q = asks(spark, d).join(base, ["bucket", "hero"]).select(
        "request", "slot", "bucket", "hero", "item", F.col("enemy").cast("string").alias("enemy_hero"),
        (F.col("request") % 20 + 1).cast("string").alias("enemy_item"), F.concat(F.lit("m"), (F.col("request") % 3).cast("string")).alias("trait"),
    )
    out = uplift.tiered_advice(q, cube, 20, 5, ("request", "slot"))
    wr = cube.where("table = 'base'").select("bucket", "hero", "item", percent(F.col("wins"), F.col("games")).alias("bwr"))
    who = asks(spark, d).select("request", "slot", "bucket", "hero")
    j = out.join(who, ["request", "slot"]).join(wr, ["bucket", "hero", "item"])
    return j.groupBy("request", "slot", "tier").agg(
        F.count("*").alias("items"), F.sum("games").alias("games"), F.round(F.max(F.coalesce("delta", F.col("bwr"))), 1).alias("best")
    )


# ---- threats ---------------------------------------------------------------------------------

THREAT = """
rs AS (SELECT bucket, hero, role, n / sum(n) OVER (PARTITION BY bucket, hero) AS share FROM (SELECT bucket, hero, role, sum(wt) AS n FROM pg GROUP BY ALL)),
prof AS (SELECT bucket, hero, coalesce(max(share) FILTER (WHERE role = 'core'), 0) AS c, coalesce(max(share) FILTER (WHERE role = 'offlane'), 0) AS o,
  coalesce(max(share) FILTER (WHERE role = 'support'), 0) AS s, arg_max(role, struct_pack(a := share, b := role)) AS main FROM rs GROUP BY ALL),
late AS (SELECT bucket, hero, sum(wt * win::INT) FILTER (WHERE stratum = 3) / nullif(sum(wt) FILTER (WHERE stratum = 3), 0)
    - sum(wt * win::INT) FILTER (WHERE stratum = 0) / nullif(sum(wt) FILTER (WHERE stratum = 0), 0) AS late,
    sum(wt) FILTER (WHERE stratum = 3) AS nl, sum(wt) FILTER (WHERE stratum = 0) AS ne FROM pg GROUP BY ALL),
hw AS (SELECT bucket, hero, sum(wt * win::INT) / sum(wt) AS wr FROM pg GROUP BY ALL),
mu AS (SELECT g.bucket, g.hero, e.hero AS enemy, sum(g.wt) AS n, sum(g.wt * g.win::INT) AS w FROM pg g JOIN pg e ON e.match_id = g.match_id AND e.is_radiant <> g.is_radiant GROUP BY ALL),
vs AS (SELECT mu.bucket, mu.enemy, mu.hero, round((mu.w / mu.n - hw.wr) * mu.n / (mu.n + 800.0) * 100, 2) AS pp, mu.n FROM mu JOIN hw USING (bucket, hero)),
tq AS (SELECT a.request, a.enemy, p.c, p.o, p.s, p.main, 1.5 * p.c + 3.0 * p.o + 4.5 * p.s AS farm,
   CASE WHEN least(round(l.nl), round(l.ne)) >= 5 THEN round(l.late * 100, 2) END AS lp, CASE WHEN round(v.n) >= 5 THEN v.pp END AS vp
  FROM asks a LEFT JOIN prof p ON p.bucket = a.bucket AND p.hero = a.enemy LEFT JOIN late l ON l.bucket = a.bucket AND l.hero = a.enemy
  LEFT JOIN vs v ON v.bucket = a.bucket AND v.enemy = a.enemy AND v.hero = a.hero)"""


@query("threat_ranking", T.with_sql(*BASE, ASKS, THREAT) + """
SELECT request, enemy, round(coalesce(3.0 * (3.0 - farm), 0) + coalesce(0.5 * greatest(0, lp) * (c + o), 0) + coalesce(-0.5 * vp, 0), 2) AS score,
  concat_ws(',', CASE WHEN main = 'core' AND farm <= 1.8 THEN 'carry' ELSE coalesce(main, 'core') END, CASE WHEN lp >= 3.0 THEN 'late' END, CASE WHEN -vp >= 3.0 THEN 'matchup' END) AS reasons FROM tq""")
def threat_ranking(spark, d):
    counts = stage(counts_of(spark, d, ("hero",)), "counts")
    prof = threats.threat_profile(hero_ops.role_shares(counts), hero_ops.late_strength(counts))
    q = asks(spark, d).select("request", "bucket", F.col("hero").alias("my_hero"), "enemy")
    out = threats.rank_threats(q, stage(prof, "profile"), hero_ops.matchups(counts, 800.0), T.THREAT)
    return out.select("request", "enemy", "score", "reasons")


@query("threat_ranking_counts", T.with_sql(*CUBE_BASE, ASKS) + """
, f AS (SELECT bucket, hero, sum(place) / count(*) AS farm FROM pl GROUP BY ALL),
le AS (SELECT bucket, hero, max(games) FILTER (WHERE ctx = 'short') AS sg, max(wins) FILTER (WHERE ctx = 'short') AS sw, max(games) FILTER (WHERE ctx = 'long') AS lg, max(wins) FILTER (WHERE ctx = 'long') AS lw
  FROM cube WHERE "table" = 'length' GROUP BY ALL),
x AS (SELECT a.request, a.enemy, f.farm, CASE WHEN sg >= 5 AND lg >= 5 THEN lw * 100.0 / lg - sw * 100.0 / sg END AS late, CASE WHEN p.games >= 5 THEN p.wins * 100.0 / p.games END AS mine, h.wins * 100.0 / h.games AS wr
  FROM asks a LEFT JOIN f ON f.bucket = a.bucket AND f.hero = a.enemy LEFT JOIN le ON le.bucket = a.bucket AND le.hero = a.enemy
  LEFT JOIN cube h ON h."table" = 'hero' AND h.bucket = a.bucket AND h.hero = a.enemy LEFT JOIN cube p ON p."table" = 'pair' AND p.bucket = a.bucket AND p.hero = a.hero AND p.ctx = CAST(a.enemy AS VARCHAR))
SELECT request, enemy, round(coalesce(3.0 * (3.0 - farm), 0) + coalesce(0.5 * late, 0) + coalesce(0.5 * (50 - mine), 0) + coalesce(0.5 * (wr - 50), 0), 1)::DOUBLE AS score,
  concat_ws(',', CASE WHEN farm <= 1.8 THEN 'carry' WHEN farm <= 2.8 THEN 'core' WHEN farm IS NOT NULL THEN 'support' END, CASE WHEN late >= 3.0 THEN 'late' END, CASE WHEN mine <= 47 THEN 'matchup' END) AS reasons FROM x""")
def threat_ranking_counts(spark, d):
    q = asks(spark, d).select("request", "bucket", F.col("hero").alias("my_hero"), "enemy")
    out = threats.cube_threats(q, stage(cube_of(spark, d), "cube"), farm_of(spark, d), T.THREAT, digits=1)
    return out.select("request", "enemy", "score", "reasons")


@query("catalogue_threats", """
SELECT s_suppkey AS supplier, round((coalesce(wr - 50, 0) + CASE WHEN core THEN 3.0 ELSE 0 END + 0.5 * coalesce(50 - mine, 0)) * CASE WHEN NOT core THEN 0.4 ELSE 1 END, 2)::DOUBLE AS score,
  CASE WHEN 0.5 * coalesce(50 - mine, 0) > greatest(coalesce(wr - 50, 0), 0) THEN 'matchup' WHEN wr >= 52 THEN 'winrate' ELSE 'core' END AS reason
FROM (SELECT s_suppkey, s_suppkey % 3 = 0 AS core, CASE WHEN s_suppkey % 5 > 0 THEN 40 + s_suppkey % 25 END AS wr, CASE WHEN s_suppkey % 7 > 0 THEN 35 + s_suppkey % 30 END AS mine FROM supplier)""")
def catalogue_threats(spark, d):
    k = F.col("s_suppkey")
    s = T.read(spark, d, "supplier").select(
        k.alias("supplier"), (k % 3 == 0).alias("is_core"), (k % 3 != 0).alias("is_support"),
        F.when(k % 5 > 0, 40 + k % 25).alias("wr"), F.when(k % 7 > 0, 35 + k % 30).alias("mine"),
    )
    out = threats.catalogue_score(s, {"winrate": 1.0, "core": 3.0, "matchup": 0.5}, 0.4, 52.0)
    return out.select("supplier", "score", "reason")


# ---- purchase timings --------------------------------------------------------------------------

BUYLOG = """
bl AS (SELECT DISTINCT l.match_id, l.hero_id AS hero, l.start_time, l.duration, CASE WHEN l.game_mode = 23 THEN 'turbo' ELSE 'normal' END AS bucket, g.role, unnest(l.items) AS item, l.net_worth % 4000 - 200 AS clock
  FROM lines l JOIN pg g ON g.match_id = l.match_id AND g.hero = l.hero_id),
fp AS (SELECT match_id, hero, start_time, bucket, role, item, min(clock) AS clock FROM bl WHERE clock BETWEEN 0 AND duration GROUP BY ALL)"""


def first_buys(spark, d):
    lines = T.match_lines(spark, d)
    role = players_of(spark, d).select("match_id", "hero", "role", "bucket")
    log = lines.select("match_id", F.col("hero_id").alias("hero"), "start_time", "duration", F.explode("items").alias("item"), (F.col("net_worth") % 4000 - 200).alias("clock"))
    j = log.join(role, ["match_id", "hero"])
    return timings.first_purchases(j, ["match_id", "hero", "start_time", "bucket", "role", "item"], "clock", "duration")


@query("first_purchases", T.with_sql(*BASE, BUYLOG) + "SELECT match_id, hero, start_time, bucket, role, item, clock FROM fp")
def first_purchases(spark, d):
    return first_buys(spark, d)


@query("purchase_medians", T.with_sql(*BASE, BUYLOG) + """
, s AS (SELECT * FROM fp WHERE start_time >= (SELECT max(start_time) FROM fp) - 1500 * 86400)
SELECT hero, bucket, coalesce(role, 'all') AS role, item, CAST(median(clock) AS DOUBLE) AS seconds, count(*) AS samples, CAST(floor(median(clock) / 60 + 0.5) AS INTEGER) AS minute
FROM s GROUP BY GROUPING SETS ((hero, bucket, role, item), (hero, bucket, item)) HAVING count(*) >= 5""")
def purchase_medians(spark, d):
    """Exact medians per role and over all roles, newest window only."""
    rows = stage(first_buys(spark, d), "first_buys").withColumn("patch", F.lit(1))
    now = rows.agg(F.max("start_time").alias("m")).scalar()
    cfg = T.TimingConfig(min_samples=5, max_age_days=1500)
    out = timings.medians(timings.fresh_samples(rows, cfg, now), cfg)
    return out.withColumn("minute", game.nearest_minute(F.col("seconds"))).select("hero", "bucket", "role", "item", "seconds", "samples", "minute")


@query("timing_table_problems", T.with_sql(*BASE, BUYLOG) + """
SELECT count(*) AS rows, 0::BIGINT AS bad_bucket, 0::BIGINT AS bad_role, 0::BIGINT AS bad_seconds, 0::BIGINT AS bad_samples
FROM (SELECT 1 FROM fp GROUP BY GROUPING SETS ((hero, bucket, role, item), (hero, bucket, item)) HAVING count(*) >= 5)""")
def timing_table_problems(spark, d):
    return timings.validate(timings.medians(first_buys(spark, d), T.TIMING))


# ---- served advice and hints -------------------------------------------------------------------


@query("served_advice")
def served_advice(spark, d):
    """Bought / now / later for two threats of every customer (checked against brute force in tests)."""
    model = T.item_model(spark, d, T.SOLO)
    recs = recommend.recommendations(T.matches(spark, d), model, T.SOLO, None, tables=("item", "hero", "ally"))
    tables = {k: stage(recs[k], k) for k in ("item", "hero", "ally")}
    q = asks(spark, d)
    req = q.where("slot = 1").select("request", "bucket", F.col("hero").cast("string").alias("hero"), F.lit(None).cast("string").alias("role_mode"))
    req = stage(adv.resolve_roles(req, tables["hero"], recs["classes"]), "requests").withColumns({
        "my_items": F.array((F.col("request") % 25 + 1).cast("int"), (100 + F.col("request") % 10).cast("int")),
        "minutes": (F.col("request") % 40).cast("double"), "allies": F.array((F.col("request") % 7 + 1).cast("int")),
    })
    th = q.select("request", "enemy", F.array((F.col("request") % 20 + 1).cast("int"), (100 + F.col("request") % 9).cast("int")).alias("enemy_items")).join(
        req.select("request", "bucket", "hero", "role"), "request")
    rows = adv.answer_rows(th, tables)
    costs = model.items.select(F.col("id").alias("y"), "cost")
    return adv.advise(rows, req, model.closure, costs, T.ADVICE, adv.ally_taken(req, tables["ally"]))


HINT_TABLES = """
props AS (SELECT id AS x, mech AS prop, CAST(substr(mech, 2) AS INTEGER) AS ord_p, id % 5 <> 0 AS verified FROM item_traits),
hr AS (SELECT enemy AS prop, answer, row_number() OVER (ORDER BY rule, answer) AS ord_r FROM rules),
ctr AS (SELECT tag AS answer, id AS y, id AS ord_c, id % 7 <> 0 AS verified FROM item_tags WHERE id < 200),
vs_item AS (SELECT p.x, p.prop, r.answer, c.y, ord_p, ord_r, ord_c FROM props p JOIN hr r USING (prop) JOIN ctr c USING (answer) WHERE p.verified AND c.verified)"""
HINT_CHOICE = """
hs AS (SELECT hero, y, round(100.0 * sum(k) / sum(n), 6) AS share FROM bo JOIN bt USING (bucket, role, hero) GROUP BY hero, y),
hq AS (SELECT a.request, a.hero, CAST(a.request % 25 + 1 AS INTEGER) AS x FROM asks a WHERE slot = 1),
hi AS (SELECT q.request, q.hero, v.y, min(struct_pack(a := ord_p, b := ord_r, c := ord_c)) AS ord, arg_min(answer, struct_pack(a := ord_p, b := ord_r, c := ord_c)) AS answer, count(DISTINCT prop) AS covers
  FROM hq q JOIN vs_item v ON v.x = q.x WHERE v.y <> 100 + q.request % 10 GROUP BY ALL),
hj AS (SELECT i.*, s.share, coalesce(s.share, 0) >= {floor} AS good FROM hi i LEFT JOIN hs s ON s.hero = i.hero AND s.y = i.y),
hk AS (SELECT *, bool_or(good) OVER (PARTITION BY request) AS any_good FROM hj),
hp AS (SELECT *, row_number() OVER (PARTITION BY request ORDER BY good DESC, CASE WHEN any_good THEN -coalesce(share, 0) ELSE -covers END, ord) AS place FROM hk)"""


def _hint_choice(floor: float):
    def run(spark, d):
        it = settle_dim(T.items(spark, d))
        props = T.item_traits(it).select(F.col("id").alias("x"), F.col("mech").alias("prop"), F.substring("mech", 2, 2).cast("int").alias("ord_p"), (F.col("id") % 5 != 0).alias("verified"))
        rule = small_table(spark, [(e, a, i + 1) for i, (_, e, a) in enumerate(sorted(T.RULES, key=lambda r: (r[0], r[2])))], "prop string, answer string, ord_r int")
        ctr = T.item_tags(it).where("id < 200").select(F.col("tag").alias("answer"), F.col("id").alias("y"), F.col("id").alias("ord_c"), (F.col("id") % 7 != 0).alias("verified"))
        vs = settle_dim(hints.counters_vs_item(props, rule, ctr))
        q = asks(spark, d).where("slot = 1").select("request", "hero", (F.col("request") % 25 + 1).cast("int").alias("x"))
        sums = hero_ops.bought_shares(stage(counts_of(spark, d, ()), "counts")).groupBy("hero", "y").agg(
            F.round(F.sum("k") * 100.0 / F.sum("n"), 6).alias("share"))
        shares = q.select("request", "hero").join(sums, "hero").select("request", "y", "share")
        owned = q.select("request", (100 + F.col("request") % 10).cast("int").alias("y"))
        out = hints.choose(q.join(vs, "x").select("request", "y", "answer", "prop", "ord"), shares, owned, HintConfig(min_own_share=floor))
        return out.select("request", "place", "y", "answer", "share", "rare")

    return run


for _name, _floor in (("item_hints", 2.0), ("item_hints_rare", 25.0)):
    query(_name, T.with_sql(*BASE, BUYS, ASKS, HINT_TABLES, HINT_CHOICE.format(floor=_floor)) + """
SELECT request, CAST(place AS INTEGER) AS place, y, answer, share, NOT any_good AS rare FROM hp
WHERE CASE WHEN any_good THEN good AND place <= 2 ELSE place = 1 END""")(_hint_choice(_floor))


@query("likely_parents", T.with_sql(*BASE, BUYS) + """
, sh AS (SELECT hero, y, sum(k) / sum(n) AS share FROM bo JOIN bt USING (bucket, role, hero) GROUP BY ALL)
SELECT s.hero, c.component AS part, arg_max(c.item, struct_pack(a := s.share, b := -c.item)) AS parent FROM closure c JOIN sh s ON s.y = c.item WHERE s.share > 0 GROUP BY ALL""")
def likely_parents(spark, d):
    """What a hero will build from a part: the parent item they buy most often."""
    m = T.item_model(spark, d)
    sums = hero_ops.bought_shares(stage(counts_of(spark, d, ()), "counts")).groupBy("hero", "y").agg((F.sum("k") / F.sum("n")).alias("share"))
    parts = m.closure.select(F.col("component").alias("part"), F.col("item").alias("parent"), F.col("item").alias("ord"))
    heroes = m.heroes.select("hero")
    return hints.pick_parent(sums.select("hero").distinct().join(heroes, "hero").join(parts.join(sums.select(F.col("y").alias("parent"), "hero").distinct(), "parent"), "hero"), sums).select("hero", "part", "parent")


@query("same_inventory_pairs", T.with_sql(*BASE) + """
SELECT count(*) AS pairs, count(*) FILTER (WHERE c = len(list_distinct(b)) AND len(b) >= 2 OR c >= 0.6 * greatest(len(a), len(b))) AS alike FROM (
  SELECT a.items AS a, b.items AS b, len(list_intersect(a.items, b.items)) AS c FROM pg a JOIN pg b ON a.match_id = b.match_id AND a.is_radiant AND NOT b.is_radiant)""")
def same_inventory_pairs(spark, d):
    pg = players_of(spark, d)
    a = pg.where("is_radiant").select("match_id", F.col("items").alias("mine"))
    b = pg.where("not is_radiant").select("match_id", F.col("items").alias("seen"))
    return a.join(b, "match_id").agg(F.count("*").alias("pairs"), F.count_if(hints.similar_inventory(F.col("mine"), F.col("seen"), 0.6)).alias("alike"))


# ---- validation ------------------------------------------------------------------------------

SPLIT = 946684800
TRAIN_TEST = (LINES, DIMS, GAMES, W.NO_ITEMS_LEFT_OUT,
              f"pg_tr AS (SELECT * FROM pg WHERE start_time < {SPLIT})", f"pg_te AS (SELECT * FROM pg WHERE start_time >= {SPLIT})")


def _halves(spark, d, level):
    model = T.item_model(spark, d)
    players = prepare.with_owned(players_of(spark, d, None), model)
    out = []
    for cond in (F.col("start_time") < SPLIT, F.col("start_time") >= SPLIT):
        counts = stage(cnt.count_teams(prepare.teams(players.where(cond), (level,))), "counts")
        out.append(stage(lift.level_metrics(cnt.GivenCounts(counts, None).table(), level, T.CFG.min_buy_share), "metrics"))
    return out


@query("threshold_sweep", T.with_sql(*TRAIN_TEST, W.level("hero", "tr", games="pg_tr"), W.level("hero", "te", games="pg_te")) + """
, j AS (SELECT t.*, thr.pp, s.lift_a AS ta, s.var_a AS tva FROM tr t JOIN (VALUES (0.0), (0.5), (1.0), (1.5), (2.0), (3.0), (5.0)) thr(pp)
  ON t.lift_a - 1.645 * sqrt(greatest(t.var_a, 0)) > 0 AND t.lift_a * 100 >= thr.pp LEFT JOIN te s USING (bucket, role, hero, ctx, y))
SELECT pp::DOUBLE AS pp, count(*) FILTER (WHERE ta <> 0) AS checked, count(*) FILTER (WHERE ta > 0) AS agree, count(*) FILTER (WHERE abs(ta) > 1.645 * sqrt(greatest(coalesce(tva, 0), 0))) AS sig,
  count(*) FILTER (WHERE ta > 1.645 * sqrt(greatest(coalesce(tva, 0), 0))) AS sig_agree, count(DISTINCT CASE WHEN bucket = 'normal' THEN role || '/' || hero || '/' || ctx END) AS pairs_kept,
  (SELECT count(*) FROM (SELECT DISTINCT role, hero, ctx FROM tr WHERE bucket = 'normal')) AS pairs FROM j GROUP BY pp""")
def threshold_sweep(spark, d):
    train, test = _halves(spark, d, "hero")
    return validate.threshold_sweep(train, test, 1.645)


@query("ally_holdout", T.with_sql(*TRAIN_TEST, W.level("ally", "tr", games="pg_tr"), W.level("ally", "te", games="pg_te")) + """
, t AS (SELECT * FROM tr WHERE ctx <> CAST(hero AS VARCHAR) AND lift_a + 1.645 * sqrt(greatest(coalesce(var_a, 0), 0)) < 0 AND lift_a * 100 <= -1.0)
SELECT (SELECT count(*) FROM t) AS pairs, count(*) FILTER (WHERE s.lift_a <> 0) AS checked, count(*) FILTER (WHERE s.lift_a < 0) AS agree,
  count(*) FILTER (WHERE abs(s.lift_a) > 1.645 * sqrt(greatest(coalesce(s.var_a, 0), 0))) AS sig, count(*) FILTER (WHERE s.lift_a < -1.645 * sqrt(greatest(coalesce(s.var_a, 0), 0))) AS sig_agree
FROM t JOIN te s USING (bucket, role, hero, ctx, y)""")
def ally_holdout(spark, d):
    train, test = _halves(spark, d, "ally")
    return validate.ally_signs(train, test, 1.645, 1.0)


@query("holdout_signs", T.with_sql(*TRAIN_TEST, W.level("L2", "tr", games="pg_tr"), W.level("L2", "te", games="pg_te")) + """
, j AS (SELECT t.lift_a AS a, t.diff_b AS b, s.lift_a AS ta, s.var_a AS tva, s.diff_b AS tb, s.var_b AS tvb FROM tr t JOIN te s USING (bucket, role, hero, ctx, y))
SELECT count(*) FILTER (WHERE b <> 0 AND tb <> 0) AS b_checked, count(*) FILTER (WHERE b <> 0 AND tb <> 0 AND sign(b) = sign(tb)) AS b_agree,
  count(*) FILTER (WHERE b <> 0 AND abs(tb) > 1.645 * sqrt(greatest(coalesce(tvb, 0), 0))) AS b_sig, count(*) FILTER (WHERE b <> 0 AND abs(tb) > 1.645 * sqrt(greatest(coalesce(tvb, 0), 0)) AND sign(b) = sign(tb)) AS b_sig_agree,
  count(*) FILTER (WHERE a <> 0 AND ta <> 0) AS a_checked, count(*) FILTER (WHERE a <> 0 AND ta <> 0 AND sign(a) = sign(ta)) AS a_agree,
  count(*) FILTER (WHERE a <> 0 AND abs(ta) > 1.645 * sqrt(greatest(coalesce(tva, 0), 0))) AS a_sig, count(*) FILTER (WHERE a <> 0 AND abs(ta) > 1.645 * sqrt(greatest(coalesce(tva, 0), 0)) AND sign(a) = sign(ta)) AS a_sig_agree FROM j""")
def holdout_signs(spark, d):
    train, test = _halves(spark, d, "L2")
    return validate.holdout_signs(train.withColumns({"a_s": F.col("lift_a"), "b_s": F.col("diff_b")}), test, 1.645)


def _benchmark(spark, d):
    recs = recs_of(spark, d, T.SOLO, None, ("hero",))
    main = recs["classes"].select(F.col("hero").cast("string").alias("hero"), F.col("main_role").alias("role"))
    answers = recs["hero"].where("bucket = 'normal'").join(main, ["hero", "role"], "left_semi")
    sup = T.read(spark, d, "supplier")
    listed = sup.select((F.col("s_suppkey") % 12 + 1).cast("string").alias("ctx"), (100 + F.col("s_nationkey") % 10).cast("int").alias("y")).distinct()
    buys = recs["buys"].where("bucket = 'normal'").withColumn("hero", F.col("hero").cast("string"))
    return stage(validate.benchmark_pairs(answers, listed, buys), "pairs")


BENCH = T.with_sql(*S_HERO, CLASSES, BUYS, W.ranked("s_h", [("e", "s.ctx")])) + """
, lead AS (
  SELECT hero, role, ctx, list(y ORDER BY place) AS ys, list(conf ORDER BY place) AS confs
  FROM placed JOIN classes USING (hero) WHERE place <= 6 AND bucket = 'normal' AND role = main_role GROUP BY ALL
),
listed AS (SELECT (s_suppkey % 12 + 1)::VARCHAR AS ctx, list(DISTINCT (100 + s_nationkey % 10)::INTEGER) AS ask FROM supplier GROUP BY ALL),
bench AS (
  SELECT lead.*, list_has_any(ask, ys[1:3]) AS hit, confs[1] <> 'low' AS confident,
         list_intersect(ask, coalesce((SELECT list(y) FROM bo JOIN bt USING (bucket, role, hero) ANTI JOIN dropped USING (y)
                                       WHERE bucket = 'normal' AND role = lead.role AND hero = lead.hero AND k >= 0.03 * n), [])) AS reach
  FROM lead JOIN listed USING (ctx)
)
"""


@query("benchmark_hit_rate", BENCH + """
SELECT count(*) AS pairs, count(*) FILTER (hit) AS hits, count(*) FILTER (confident) AS pairs_confident, count(*) FILTER (confident AND hit) AS hits_confident,
       count(*) FILTER (len(reach) > 0) AS pairs_reachable, count(*) FILTER (len(reach) > 0 AND hit) AS hits_reachable FROM bench""")
def benchmark_hit_rate(spark, d):
    return validate.benchmark_shares(_benchmark(spark, d))


@query("benchmark_disagreements", BENCH + """
, missed AS (
  SELECT b.hero, b.ctx AS enemy, max({'games': p.games, 'y': p.y, 'a': p.a_s, 'pos': p.place}) FILTER (p.y IS NOT NULL) AS best
  FROM bench b LEFT JOIN placed p ON p.hero = b.hero AND p.role = b.role AND p.ctx = b.ctx AND p.bucket = 'normal' AND p.place <= 6 AND list_contains(b.reach, p.y)
  WHERE len(reach) > 0 AND NOT hit GROUP BY ALL
)
SELECT hero::VARCHAR AS hero, enemy, best.y AS y, best.pos::INTEGER AS pos, if(best IS NULL, 'filtered', if(best.a <= 0, 'not confirmed', 'both right')) AS verdict, round(coalesce(best.games, 0), 5) AS weight
FROM missed ORDER BY coalesce(best.games, 0) DESC, hero::VARCHAR, enemy LIMIT 10""")
def benchmark_disagreements(spark, d):
    return r6(validate.disagreements(_benchmark(spark, d)), "weight", digits=5)


@query("answer_report", T.with_sql(*S_HERO, W.ranked("s_h", [("e", "s.ctx")])) + """
SELECT bucket, hero, role, ctx, max(cell) FILTER (place = 1) AS first, max(cell) FILTER (place = 2) AS second, max(cell) FILTER (place = 3) AS third
FROM (SELECT bucket, hero::VARCHAR AS hero, role, ctx, place, printf('**%d** A %+.1f, B %+.1f, %d', y, a_s * 100, coalesce(b_s, 0) * 100, round(games)::BIGINT) AS cell FROM placed WHERE place <= 3)
GROUP BY ALL""")
def answer_report(spark, d):
    """Top-3 answers side by side for every hero pair."""
    hero = stage(recs_of(spark, d, T.SOLO, None, ("hero",))["hero"], "hero")
    out = validate.report_cells(hero, hero.select("hero", "ctx").distinct())
    return out.withColumnsRenamed({"1": "first", "2": "second", "3": "third"})


SLICE = """SELECT '{name}' AS "table", bucket, role, hero::VARCHAR AS hero, ctx, place::INTEGER AS place, y, round(score, 2) AS score, round(a_s * 100, 1) AS a_pp,
       round(coalesce(b_s, 0) * 100, 1) AS b_pp, conf, round(games)::BIGINT AS games, coalesce(rule, 'exp') AS source FROM placed_{name} SEMI JOIN often USING (bucket, role, hero) WHERE place <= 6"""


@query("hero_slices", T.with_sql(*BASE, *W.S_L2, W.level("hero", "met_h"), W.shrunk("met_h", "s_h"), W.ranked("s_h", [("e", "s.ctx")], tag="_hero"), W.ranked("s_l2", [("x", "s.ctx")], tag="_item"), """
often AS (SELECT bucket, role, hero FROM pg GROUP BY bucket, role, hero QUALIFY sum(wt) >= 0.1 * sum(sum(wt)) OVER (PARTITION BY bucket, hero))""") + SLICE.format(name="hero") + " UNION ALL " + SLICE.format(name="item"))
def hero_slices(spark, d):
    """Answers written as one folder per hero (rare roles dropped), coded, every slice read back and decoded."""
    from skirmish.operators.answers import export_rows
    from skirmish.session import scratch_path

    recs = recs_of(spark, d, T.SOLO, None, ("hero", "item"))
    path = scratch_path(spark, "slices")
    sources = ["exp"] + sorted({r[0] for r in T.RULES})
    tables = {n: slices.encode(export_rows(slices.common_roles(recs[n], recs["roles"], 0.1)), sources) for n in ("hero", "item")}
    slices.write_slices(tables, path)
    out = slices.decode(slices.read_all(spark, path), sources)
    return out.select("table", "bucket", "role", F.col("hero").cast("string").alias("hero"), "ctx", "place", "y", "score", "a_pp", "b_pp", "conf", "games", "source")


# ---- text ------------------------------------------------------------------------------------

PAGES = """
wl AS (SELECT o.o_orderkey AS page, l.l_linenumber AS ln, p.p_name AS name, p.p_brand AS brand FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey JOIN part p ON p.p_partkey = l.l_partkey)"""


def wiki_pages(spark, d):
    """One page per order: list lines that name parts by templates and brands by links."""
    l = T.read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    p = T.read(spark, d, "part").select("p_partkey", "p_name", "p_brand")
    partitions = size_shuffles(spark, l.count())
    j = l.join(p, l.l_partkey == p.p_partkey).repartition(partitions, "l_orderkey")  # a number, or small ones would be put together

    def line(x):
        text = F.format_string("* {{I|%s|30px}} and [[%s|the brand]] stop it, unlike [[break]] or {{I|zzz}}", x["p_name"], x["p_brand"])
        return F.struct(x["l_linenumber"], text.alias("t"))

    own = j.groupBy("l_orderkey").agg(F.collect_list(F.struct("l_linenumber", "p_name", "p_brand")).alias("own"))
    rows = own.select("l_orderkey", F.transform(F.sort_array(F.transform("own", line)), lambda x: x["t"]).alias("lines"))
    text = F.concat(F.lit("Intro\n==Good against==\n* none\n==Bad against...==\n{{Hero label|Axe}}\n===Items===\n"), F.array_join("lines", "\n"), F.lit("\n===Others===\n* {{H|Lion}}\n"))
    return rows.select(F.col("l_orderkey").alias("page"), text.alias("text"))


@query("page_counter_items", T.with_sql(PAGES) + """
SELECT page, ln - 1 - (SELECT 0) AS line, lower(name) AS item, 1 AS pos FROM (SELECT page, row_number() OVER (PARTITION BY page ORDER BY ln, name || '|', brand || ']') AS ln, name, brand FROM wl)
UNION ALL SELECT page, ln - 1, lower(brand), 2 FROM (SELECT page, row_number() OVER (PARTITION BY page ORDER BY ln, name || '|', brand || ']') AS ln, name, brand FROM wl)""")
def page_counter_items(spark, d):
    """Items that open the list lines of the "Bad against" section, in order."""
    names = T.read(spark, d, "part").select(F.explode(F.array("p_name", "p_brand")).alias("n"))
    known = names.select(tx.normal_name(F.col("n")).alias("item")).distinct()
    items = wiki.lead_items(wiki.counter_lines(wiki_pages(spark, d), "page"), ["page", "line"], known)
    return items.select("page", F.col("line").cast("bigint").alias("line"), "item", F.col("pos") + 1).toDF("page", "line", "item", "pos")


@query("page_mentions", T.with_sql(PAGES) + """
SELECT item, count(*) AS mentions, count(DISTINCT page) AS pages FROM (SELECT page, name AS item FROM wl UNION ALL SELECT page, brand FROM wl
UNION ALL SELECT page, 'break' FROM wl UNION ALL SELECT page, 'zzz' FROM wl) GROUP BY item""")
def page_mentions(spark, d):
    """Mentions of an item and the pages with it; a page is a row, so its items are made distinct there."""
    lines = F.filter(F.split("text", "\n"), lambda x: x.contains("stop it"))
    own = wiki_pages(spark, d).select(F.flatten(F.transform(lines, tx.mentions)).alias("own"))

    def part(items, mentions, pages):
        return F.transform(items, lambda x: F.struct(x.alias("item"), F.lit(mentions).alias("mentions"), F.lit(pages).alias("pages")))

    rows = own.select(F.inline(F.concat(part(F.col("own"), 1, 0), part(F.array_distinct("own"), 0, 1))))
    return rows.groupBy("item").agg(F.sum("mentions").alias("mentions"), F.sum("pages").alias("pages"))


@query("page_plain_text", T.with_sql(PAGES) + """
SELECT page, substr(sha1(string_agg('* ' || name || ' and the brand stop it, unlike break or zzz', '|' ORDER BY ln, name)), 1, 10) AS text_key FROM wl GROUP BY page""")
def page_plain_text(spark, d):
    lines = wiki_pages(spark, d).select("page", F.filter(F.split("text", "\n"), lambda x: x.contains("stop it")).alias("ls"))
    return lines.select("page", tx.fingerprint(F.array_join(F.transform("ls", tx.plain_text), "|")).alias("text_key"))


@query("document_fingerprints", "SELECT doc_id, substr(sha1(text), 1, 10) AS text_key, length(text) AS chars FROM documents")
def document_fingerprints(spark, d):
    return T.read(spark, d, "documents").select("doc_id", tx.fingerprint(F.col("text")).alias("text_key"), F.length("text").cast("bigint").alias("chars"))


@query("evidence_words", """
SELECT doc_id, a || ' + ' || b AS evidence FROM (SELECT doc_id,
  CASE WHEN contains(t, 'the ') THEN 'the ' WHEN contains(t, 'der ') THEN 'der ' WHEN contains(t, ' le ') THEN ' le ' END AS a,
  CASE WHEN contains(t, 'with') THEN 'with' WHEN contains(t, 'license') THEN 'license' WHEN contains(t, ' et ') THEN ' et ' END AS b
  FROM (SELECT doc_id, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS t FROM documents)) WHERE a IS NOT NULL AND b IS NOT NULL""")
def evidence_words(spark, d):
    """A word of every group must occur somewhere in the whole text."""
    groups = [["the ", "der ", " le "], ["with", "license", " et "]]
    docs = T.read(spark, d, "documents").select("doc_id", tx.evidence(F.col("text"), groups).alias("evidence"))
    return docs.where(F.col("evidence").isNotNull())


@query("page_evidence", """
SELECT page_id, contains(b, 'the') AS has_the FROM (SELECT page_id, lower(regexp_replace(html, 'href', ' ', 'gi')) AS b FROM pages)""")
def page_evidence(spark, d):
    p = T.read(spark, d, "pages").select("page_id", tx.page_body(F.col("html"), F.lit("href")).alias("body"))
    return p.select("page_id", tx.evidence(F.col("body"), [["the"]]).isNotNull().alias("has_the"))


@query("numbers_mentioned", """
SELECT doc_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(text, '\\b(\\d{2})\\b', 1), lambda x: x::INTEGER))), ',') AS numbers
FROM documents WHERE len(regexp_extract_all(text, '\\b(\\d{2})\\b', 1)) > 0""")
def numbers_mentioned(spark, d):
    docs = T.read(spark, d, "documents").select("doc_id", tx.numbers_mentioned(F.col("text"), r"\b(\d{2})\b").alias("n"))
    return docs.where(F.size("n") > 0).select("doc_id", F.array_join(F.array_distinct("n"), ",").alias("numbers"))


TAG_SPECS = {
    "license": {"desc": ["licen[sc]e", "copyright"], "exclude": ["all rights"]},
    "contact": {"desc": ["@", r"\d{3}-\d{3}"], "exclude": []},
    "german": {"desc": [" und ", " der "], "exclude": [" the "], "min_count": 2},
}


@query("tags_by_source", """
SELECT source, tag FROM (SELECT source, unnest([CASE WHEN sum(l::INT) >= 1 THEN 'license' END, CASE WHEN sum(c::INT) >= 1 THEN 'contact' END, CASE WHEN sum(g::INT) >= 2 THEN 'german' END]) AS tag FROM (
  SELECT source, (regexp_matches(t, 'licen[sc]e') OR regexp_matches(t, 'copyright')) AND NOT regexp_matches(t, 'all rights') AS l,
    regexp_matches(t, '@') OR regexp_matches(t, '\\d{3}-\\d{3}') AS c, (contains(t, ' und ') OR contains(t, ' der ')) AND NOT contains(t, ' the ') AS g
  FROM (SELECT source, lower(text) AS t FROM documents)) GROUP BY source) WHERE tag IS NOT NULL""")
def tags_by_source(spark, d):
    """Pattern tags per owner with include, exclude and a minimum number of hits."""
    return tags.tag_descriptions(T.read(spark, d, "documents"), TAG_SPECS, "source", "text")


@query("best_key_per_name", "SELECT name, arg_min(k, struct_pack(t := regexp_matches(k, '_\\d+$'), l := length(k), k := k)) AS key, count(*) AS keys FROM (SELECT lower(replace(p_name, '_', ' ')) AS name, 'p_' || p_partkey || CASE WHEN p_partkey % 3 = 0 THEN 'x' ELSE '' END AS k FROM part) GROUP BY name")
def best_key_per_name(spark, d):
    k = F.concat(F.lit("p_"), F.col("p_partkey").cast("string"), F.when(F.col("p_partkey") % 3 == 0, "x").otherwise(""))
    p = T.read(spark, d, "part").select(tx.normal_name(F.col("p_name")).alias("name"), k.alias("key"))
    return tags.best_key_per_name(p, "name", "key")


@query("reason_coverage", """
SELECT count(*) AS total, count(*) FILTER (WHERE quality IS NOT NULL AND doc_id % 5 > 0 AND quality = 1) AS found, count(*) FILTER (WHERE quality IS NULL) AS missing,
  count(*) FILTER (WHERE quality IS NOT NULL AND doc_id % 5 = 0) AS stale FROM documents LEFT JOIN labels USING (doc_id)""")
def reason_coverage(spark, d):
    docs = T.read(spark, d, "documents").select("doc_id", "text")
    key = F.when(F.col("doc_id") % 5 > 0, tx.fingerprint(F.col("text"))).otherwise("changed")
    lab = T.read(spark, d, "labels").join(docs, "doc_id").select("doc_id", key.alias("text_key"), F.when(F.col("quality") == 1, "good").otherwise("none").alias("kind"))
    return reports.reason_coverage(docs, lab, ["doc_id"])


# ---- profiles, logs, reports -------------------------------------------------------------------


@query("props_field_profile", """
WITH v AS (SELECT event_id, json_extract_string(props, '$.k') AS s FROM events), f AS (SELECT s, count(*) AS k, min(event_id) AS f FROM v WHERE s IS NOT NULL GROUP BY s)
SELECT 'k' AS path, (SELECT CAST(sum(k) AS BIGINT) FROM f) AS count, (SELECT string_agg(s, ',' ORDER BY f, s) FROM (SELECT * FROM f ORDER BY f, s LIMIT 8)) AS samples""")
def props_field_profile(spark, d):
    e = T.read(spark, d, "events").select("event_id", "props")
    out = profile.field_profile(profile.path_values(e, "props", "k long", ["event_id"]), "event_id")
    return out.select("path", "count", F.array_join("samples", ",").alias("samples"))


@query("nested_field_profile", T.with_sql(LINES) + """
, f AS (SELECT path, s, count(*) AS k, min(match_id) AS f FROM (
  SELECT 'm.id' AS path, CAST(match_id AS VARCHAR) AS s, match_id FROM (SELECT DISTINCT match_id FROM lines)
  UNION ALL SELECT 'slot#[].hero', CAST(hero_id AS VARCHAR), match_id FROM lines) GROUP BY ALL)
SELECT path, CAST(sum(k) AS BIGINT) AS count, string_agg(s, ',' ORDER BY f, s) FILTER (WHERE rn <= 8) AS samples FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY f, s) AS rn FROM f) GROUP BY path""")
def nested_field_profile(spark, d):
    """Records of unknown shape: variant values opened level by level."""
    per = T.match_lines(spark, d).groupBy("match_id").agg(F.collect_list(F.struct(F.col("hero_id").alias("hero"))).alias("slot0"))
    j = per.select("match_id", F.to_json(F.struct(F.struct(F.col("match_id").alias("id")).alias("m"), "slot0")).alias("j"))
    out = profile.field_profile(profile.any_path_values(j, "j", ["match_id"]), "match_id")
    return out.select("path", "count", F.array_join("samples", ",").alias("samples"))


def _item_files(spark, d):
    """Parts as keyed files, an object a brand: costs, parts of a recipe, abilities in lists of lists of three depths."""
    from skirmish.session import scratch_path

    p = T.read(spark, d, "part")
    one = F.concat(F.lit("["), F.col("p_size").cast("string"), F.lit(","), (F.col("p_partkey") % 7).cast("string"), F.lit("]"))
    deep = F.when(F.col("p_partkey") % 3 == 0, one).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("[["), F.col("p_size").cast("string"), F.lit("],[[9,[8]],[]]]"))).otherwise(F.lit("5"))
    entry = F.concat(
        F.lit('"part'), "p_partkey", F.lit('":{"id":'), "p_partkey", F.lit(',"cost":'), F.floor("p_retailprice"), F.lit(',"quality":"'), "p_type",
        F.lit('","components":["'), F.concat_ws('","', "p_name", "p_brand"), F.lit('"],"abilities":'), deep, F.lit("}"),
    )
    path = scratch_path(spark, "items")
    files = p.select("p_brand", entry.alias("e")).groupBy("p_brand").agg(F.concat(F.lit("{"), F.array_join(F.collect_list("e"), ","), F.lit(',"version":7}')).alias("value"))
    files.select("value").write.text(path)
    return keyed.read_keyed(spark, path, "id bigint; cost bigint; quality string; components array<string>", whole=False)


@query("keyed_items", """
SELECT 'part' || p_partkey AS key, p_partkey AS id, CAST(floor(p_retailprice) AS BIGINT) AS cost, p_type AS quality, p_name || ',' || p_brand AS components FROM part""")
def keyed_items(spark, d):
    """A dimension of files that hold one object keyed by name, as rows; entries that are no objects are left out."""
    return _item_files(spark, d).select("key", "id", "cost", "quality", F.array_join("components", ",").alias("components"))


@query("nested_lists", """
SELECT 'part' || p_partkey AS key, v AS value, count(*) AS times FROM (
  SELECT p_partkey, unnest(CASE p_partkey % 3 WHEN 0 THEN [p_size, p_partkey % 7] WHEN 1 THEN [p_size, 9, 8] ELSE [5] END)::BIGINT AS v FROM part) GROUP BY ALL""")
def nested_lists(spark, d):
    """Lists inside lists of any shape, flattened to their elements."""
    items = _item_files(spark, d).select("key", F.variant_get("raw", "$.abilities", "variant").alias("abilities"))
    flat = profile.list_items(items, "abilities", ["key"], 4)
    return flat.groupBy("key", F.variant_get("item", "$", "bigint").alias("value")).agg(F.count("*").alias("times"))


@query("match_spans", T.with_sql(EV) + "SELECT user_id, count(*) AS packets, arg_min(k, event_id) AS first_clock, arg_max(k, event_id) AS last_clock FROM ev GROUP BY user_id")
def match_spans(spark, d):
    return profile.match_spans(T2.events(spark, d), "user_id", "k", "event_id")


@query("first_occurrences", "SELECT role, min(conv_id * 1000 + turn) AS first FROM conversations GROUP BY role")
def first_occurrences(spark, d):
    c = T.read(spark, d, "conversations").withColumn("o", F.col("conv_id") * 1000 + F.col("turn"))
    return profile.distinct_in_order(c, "role", "o")


@query("log_intervals", T.with_sql(EV) + """
SELECT count(*) AS intervals, min(h) AS low, max(h) AS high, arg_max(k::DOUBLE, event_id) AS limits, min(p) AS pause_low, max(p) AS pause_high, arg_max(p, event_id) AS pause_last, median(h) AS median
FROM (SELECT event_id, k, (k * 100)::DOUBLE AS h, k % 7 + 0.5::DOUBLE AS p FROM ev WHERE event_type = 'view')""")
def log_intervals(spark, d):
    """Progress lines of a text log, by pattern; other lines are ignored."""
    e = T2.events(spark, d)
    line = F.format_string("%d мин: 1.5 запросов/мин, %d матчей/час, 429 за отрезок 0 (всего %d), пауза %s сек", F.col("event_id"), F.col("k") * 100, F.col("k"), (F.col("k") % 7 + 0.5).cast("string"))
    text = e.select("event_id", F.when(F.col("event_type") == "view", line).otherwise(F.col("event_type")).alias("value"))
    return reports.log_summary(reports.parse_log(text), "event_id")


@query("run_report", """
SELECT count(*) AS runs, CAST(sum(matches) AS BIGINT) + 7 AS matches, CAST(sum(bytes) AS BIGINT) AS bytes, max(tag) AS tag FROM (
  SELECT CAST(o_custkey AS VARCHAR) AS tag, o_orderkey % 100 AS matches, o_orderkey % 1000 AS bytes FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1)""")
def run_report(spark, d):
    o = T.read(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("tag"), F.col("o_orderkey").alias("updated_at"), (F.col("o_orderkey") % 100).alias("matches"), (F.col("o_orderkey") % 1000).alias("bytes"))
    return reports.run_totals(reports.latest_runs(o), F.lit(7), F.lit(0))


@query("unfinished_runs", T.with_sql(EV) + """
SELECT user_id AS tag, count(*) AS parts, max(sec) AS last, 2400000 - max(sec) < 1800 AS running, round(count(*) / greatest((max(sec) - 0) / 3600.0, 1e-6), 6)::DOUBLE AS per_hour FROM ev
WHERE user_id NOT IN (SELECT user_id FROM ev WHERE event_type = 'signup' AND k % 9 = 0) GROUP BY user_id""")
def unfinished_runs(spark, d):
    e = T2.events(spark, d)
    parts = e.select(F.col("user_id").alias("tag"), F.col("sec").alias("updated_at"))
    done = e.where("event_type = 'signup' and k % 9 = 0").select(F.col("user_id").alias("tag")).distinct()
    out = reports.liveness(reports.part_groups(parts, done), F.lit(2400000))
    return out.withColumn("per_hour", F.round(reports.throughput(F.col("parts"), F.lit(0), F.col("last")), 6))


@query("artifact_freshness", T.with_sql(EV) + """
SELECT max(sec) FILTER (WHERE event_type = 'view') AS data_at, max(sec) FILTER (WHERE event_type = 'error') AS recs_at,
  max(sec) FILTER (WHERE event_type = 'view') > max(sec) FILTER (WHERE event_type = 'error') AS should_compute, 2700000 - max(sec) FILTER (WHERE event_type = 'error') > 86400 AS stale FROM ev""")
def artifact_freshness(spark, d):
    name = F.when(F.col("event_type") == "view", F.concat(F.lit("matches-"), "event_id", F.lit(".parquet"))).when(F.col("event_type") == "error", "recs").otherwise("other")
    return reports.freshness(T2.events(spark, d).select(name.alias("name"), F.col("sec").alias("updated_at")), F.lit(2700000))


@query("clock_labels", T.with_sql(EV) + """
SELECT event_id, CASE WHEN c < 0 THEN '-' ELSE '' END || (abs(c) // 60) || ':' || lpad(CAST(abs(c) % 60 AS VARCHAR), 2, '0') AS label, CAST(floor(c / 300.0) AS BIGINT) % 2 <> 0 AS night
FROM (SELECT event_id, CAST(sec % 4000 - 500 AS INTEGER) AS c FROM ev)""")
def clock_labels(spark, d):
    c = (F.col("sec") % 4000 - 500).cast("int")
    return T2.events(spark, d).select("event_id", game.clock_text(c).alias("label"), game.is_night(c, 300).alias("night"))
