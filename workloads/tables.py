"""Stand-ins: the driver tables seen as matches, items, heroes and ranks.

Spark side and SQL side are written next to each other; both use integer arithmetic only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skirmish.config import DAY, AdviceConfig, Config, ThreatConfig, TimingConfig, UpliftConfig
from skirmish.operators.dims import ItemModel, build_item_model
from skirmish.session import join_side, settle_dim, size_shuffles, small_table

# Parameters scaled to the span (1992-2001) and density of the driver tables.
CFG = Config(
    half_life_days=1500.0,
    eb_min_games=20.0,
    conf_high=60.0,
    conf_mid=20.0,
    team_item_min_pairs=2.0,
    team_item_max_ratio=0.98,
    counter_min_a_pp=1.0,
    extra_candidates=("item_204",),
    exclude_tree_of="item_203",
    keep_from_excluded=("item_103",),
    component_final_share=0.4,
    levels=("L3", "L2", "L1", "hero", "ally"),
)
SOLO = CFG.with_(levels=("L3", "L2", "hero", "ally"))
PATCHES = [("7.30", "1994-01-01"), ("7.31", "1996-01-01"), ("7.32", "1998-01-01"), ("7.33", "2000-01-01")]
RULES = [
    ("r0", "m0", "t1"), ("r1", "m1", "t2"), ("r2", "m2", "t0"), ("r3", "m3", "t3"),
    ("r4", "m4", "t1"), ("r5", "m5", "t0"), ("r5", "m5", "t2"), ("r6", "m6", "t2"), ("r7", "m7", "t3"),
]


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def epoch(ts: Column) -> Column:
    return F.unix_timestamp(ts)


# ---- matches ---------------------------------------------------------------------------------


def match_lines(spark: SparkSession, d: str) -> DataFrame:
    """Order lines with the match columns and a few originals kept for single operators.

    Parts come first, so that the join with orders, the window and all that follows by match share one shuffle.
    """
    lines = read(spark, d, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice"
    )
    orders = read(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    parts = read(spark, d, "part").select("p_partkey", "p_brand", "p_size")
    size_shuffles(spark, lines.count())
    parts = join_side(parts, parts.count())
    j = lines.join(parts, lines.l_partkey == parts.p_partkey).join(orders, lines.l_orderkey == orders.o_orderkey)
    longest = F.max("l_quantity").over(Window.partitionBy("l_orderkey"))
    start = epoch(F.col("o_orderdate"))
    patch = F.lit(PATCHES[0][0])
    for name, day in PATCHES:
        patch = F.when(F.col("o_orderdate") >= F.lit(day).cast("timestamp_ntz"), name).otherwise(patch)
    return j.select(
        F.col("l_orderkey").alias("match_id"),
        start.alias("start_time"),
        (600 + 60 * longest.cast("int")).alias("duration"),
        F.when(F.col("o_orderpriority") == "1-URGENT", 23).otherwise(22).alias("game_mode"),
        (F.col("o_custkey") % 2 == 0).alias("radiant_win"),
        patch.alias("patch"),
        (F.col("l_linenumber") % 2 == 1).alias("is_radiant"),
        (F.col("l_suppkey") % 12 + 1).cast("int").alias("hero_id"),
        F.array(
            F.substring("p_brand", 7, 4).cast("int"),
            (F.lit(100) + F.col("p_size") % 10).cast("int"),
            (F.lit(200) + F.col("l_partkey") % 7).cast("int"),
        ).alias("items"),
        F.floor("l_extendedprice").cast("bigint").alias("net_worth"),
        F.col("l_linenumber").alias("slot"),
        F.col("o_custkey").alias("custkey"),
    )


def matches(spark: SparkSession, d: str) -> DataFrame:
    return match_lines(spark, d).drop("slot", "custkey")


def ranks(spark: SparkSession, d: str) -> DataFrame:
    orders = read(spark, d, "orders").select("o_orderkey", "o_custkey")
    cust = read(spark, d, "customer").select("c_custkey", "c_nationkey")
    cust = join_side(cust.where("c_nationkey % 5 <> 0"), cust.count())
    return orders.join(cust, orders.o_custkey == cust.c_custkey).select(
        F.col("o_orderkey").alias("match_id"),
        (10 + F.col("c_nationkey") * 3).cast("int").alias("avg_rank_tier"),
        (F.col("o_orderkey") % 10).cast("int").alias("num_rank_tier"),
    )


SQL_LINES = """
lines AS (
  SELECT l.l_orderkey AS match_id, CAST(epoch(o.o_orderdate) AS BIGINT) AS start_time,
         600 + 60 * CAST(max(l.l_quantity) OVER (PARTITION BY l.l_orderkey) AS INTEGER) AS duration,
         CASE WHEN o.o_orderpriority = '1-URGENT' THEN 23 ELSE 22 END AS game_mode,
         o.o_custkey % 2 = 0 AS radiant_win,
         CASE WHEN o.o_orderdate >= TIMESTAMP '2000-01-01' THEN '7.33' WHEN o.o_orderdate >= TIMESTAMP '1998-01-01' THEN '7.32'
              WHEN o.o_orderdate >= TIMESTAMP '1996-01-01' THEN '7.31' ELSE '7.30' END AS patch,
         l.l_linenumber % 2 = 1 AS is_radiant, CAST(l.l_suppkey % 12 + 1 AS INTEGER) AS hero_id,
         [CAST(substr(p.p_brand, 7) AS INTEGER), CAST(100 + p.p_size % 10 AS INTEGER), CAST(200 + l.l_partkey % 7 AS INTEGER)] AS items,
         CAST(floor(l.l_extendedprice) AS BIGINT) AS net_worth, l.l_linenumber AS slot, o.o_custkey AS custkey
  FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey JOIN part p ON p.p_partkey = l.l_partkey
),
ranks AS (
  SELECT o.o_orderkey AS match_id, CAST(10 + c.c_nationkey * 3 AS INTEGER) AS avg_rank_tier,
         CAST(o.o_orderkey % 10 AS INTEGER) AS num_rank_tier
  FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey WHERE c.c_nationkey % 5 <> 0
)"""

# ---- items, heroes, rules --------------------------------------------------------------------


def items(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part").select(
        F.explode(
            F.array(
                F.substring("p_brand", 7, 4).cast("int"),
                (F.lit(100) + F.col("p_size") % 10).cast("int"),
                (F.lit(200) + F.col("p_partkey") % 7).cast("int"),
            )
        ).alias("id")
    ).distinct()
    return p.select(
        "id",
        F.concat(F.lit("item_"), F.col("id").cast("string")).alias("key"),
        (400 + 100 * ((F.col("id") * 37) % 40)).cast("int").alias("cost"),
        (F.col("id") < 200).alias("created"),
        F.lit("rare").alias("qual"),
        F.lit(0).alias("tier"),
    )


def edges(item_rows: DataFrame) -> DataFrame:
    mid = item_rows.where("id between 100 and 109").select(
        F.col("id").alias("item"), (F.lit(200) + (F.col("id") - 100) % 7).cast("int").alias("component")
    )
    top = item_rows.where("id < 100 and id % 3 = 0").select(
        F.col("id").alias("item"), (F.lit(100) + F.col("id") % 10).cast("int").alias("component")
    )
    return mid.unionByName(top)


def item_traits(item_rows: DataFrame) -> DataFrame:
    a = item_rows.where("id % 4 < 2").select("id", F.concat(F.lit("m"), (F.col("id") % 5).cast("string")).alias("mech"))
    b = item_rows.where("id % 6 = 0").select("id", F.concat(F.lit("m"), (5 + F.col("id") % 3).cast("string")).alias("mech"))
    return a.unionByName(b).distinct()


def item_tags(item_rows: DataFrame) -> DataFrame:
    return item_rows.select("id", F.concat(F.lit("t"), (F.col("id") % 4).cast("string")).alias("tag"))


def heroes(spark: SparkSession, d: str) -> DataFrame:
    h = read(spark, d, "supplier").select((F.col("s_suppkey") % 12 + 1).cast("int").alias("hero")).distinct()
    attr = F.when(F.col("hero") % 4 == 0, "str").when(F.col("hero") % 4 == 1, "agi").when(F.col("hero") % 4 == 2, "int")
    return h.select("hero", F.coalesce(attr, F.lit("all")).alias("attr"))


def hero_traits(hero_rows: DataFrame) -> DataFrame:
    def one(condition: str, mech: str) -> DataFrame:
        return hero_rows.where(condition).select("hero", F.lit(mech).alias("mech"))

    return one("hero % 3 = 0", "m0").unionByName(one("hero % 2 = 0", "m1")).unionByName(one("hero % 4 = 1", "m2"))


def rules(spark: SparkSession) -> DataFrame:
    return small_table(spark, RULES, "rule string, enemy string, answer string")


def item_model(spark: SparkSession, d: str, cfg: Config = CFG) -> ItemModel:
    it, he = settle_dim(items(spark, d)), settle_dim(heroes(spark, d))
    return build_item_model(it, edges(it), item_traits(it), item_tags(it), he, hero_traits(he), rules(spark), cfg)


SQL_DIMS = """
items AS (
  SELECT DISTINCT id, 'item_' || id AS key, 400 + 100 * ((id * 37) % 40) AS cost, id < 200 AS created FROM (
    SELECT unnest([CAST(substr(p_brand, 7) AS INTEGER), CAST(100 + p_size % 10 AS INTEGER), CAST(200 + p_partkey % 7 AS INTEGER)]) AS id
    FROM part)
),
edges AS (
  SELECT id AS item, 200 + (id - 100) % 7 AS component FROM items WHERE id BETWEEN 100 AND 109
  UNION ALL SELECT id, 100 + id % 10 FROM items WHERE id < 100 AND id % 3 = 0
),
item_traits AS (
  SELECT id, 'm' || (id % 5) AS mech FROM items WHERE id % 4 < 2 UNION
  SELECT id, 'm' || (5 + id % 3) FROM items WHERE id % 6 = 0
),
item_tags AS (SELECT id, 't' || (id % 4) AS tag FROM items),
heroes AS (
  SELECT DISTINCT hero, CASE hero % 4 WHEN 0 THEN 'str' WHEN 1 THEN 'agi' WHEN 2 THEN 'int' ELSE 'all' END AS attr
  FROM (SELECT CAST(s_suppkey % 12 + 1 AS INTEGER) AS hero FROM supplier)
),
hero_traits AS (
  SELECT hero, 'm0' AS mech FROM heroes WHERE hero % 3 = 0 UNION ALL SELECT hero, 'm1' FROM heroes WHERE hero % 2 = 0
  UNION ALL SELECT hero, 'm2' FROM heroes WHERE hero % 4 = 1
),
rules(rule, enemy, answer) AS (VALUES """ + ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in RULES) + """),
closure AS (
  SELECT item, component FROM edges UNION SELECT c.item, e.component FROM closure c JOIN edges e ON e.item = c.component
),
cands AS (
  SELECT id AS y FROM items
  WHERE ((created AND cost >= 1000) OR key = 'item_204')
    AND (id NOT IN (SELECT item FROM closure WHERE component = 203) OR key = 'item_103')
),
key_items AS (
  SELECT id AS x FROM items WHERE id IN (SELECT id FROM item_traits) OR (created AND cost >= 2000)
),
expand AS (
  SELECT DISTINCT z, y FROM (SELECT id AS z, id AS y FROM items UNION ALL SELECT item, component FROM closure)
  WHERE y IN (SELECT y FROM cands)
),
parts AS (SELECT DISTINCT component AS y FROM closure WHERE component IN (SELECT y FROM cands)),
x_mech AS (SELECT DISTINCT id AS x, mech FROM item_traits WHERE id IN (SELECT x FROM key_items)),
broad AS (
  SELECT DISTINCT rule FROM rules r WHERE (SELECT count(DISTINCT hero) FROM hero_traits t WHERE t.mech = r.enemy)
    > 0.4 * (SELECT count(*) FROM heroes)
),
rule_of AS (
  SELECT kind, ctx, id AS y, first(rule ORDER BY is_broad, rule) AS rule, bool_and(is_broad) AS broad
  FROM (SELECT rule, enemy, answer, rule IN (FROM broad) AS is_broad FROM rules)
  JOIN (SELECT 'x' AS kind, x::VARCHAR AS ctx, mech AS enemy FROM x_mech UNION SELECT 'm', enemy, enemy FROM rules
        UNION SELECT 'e', hero::VARCHAR, mech FROM hero_traits) USING (enemy)
  JOIN item_tags ON tag = answer SEMI JOIN cands ON id = cands.y GROUP BY kind, ctx, id
)"""

# ---- prepared games, as SQL -------------------------------------------------------------------


#: One row for a hero in a match: the earliest, then the richest.
SQL_FIRST = """
first_rows AS (SELECT DISTINCT ON (match_id, hero_id) * FROM lines WHERE {where} ORDER BY match_id, hero_id, start_time, net_worth DESC, is_radiant, items)"""


def sql_plays(weight: str | None = None, where: str = "true") -> str:
    """CTE pg over the match lines. A player's place in their team by wealth gives the role, a list of edges the stratum."""
    wt = weight or f"2 ** ((start_time - max(start_time) OVER ()) / (1500 * {DAY}))"
    return SQL_FIRST.format(where=where) + f"""
,
best_rank AS (SELECT match_id, max(avg_rank_tier) AS tier FROM ranks GROUP BY match_id),
pg AS (
  SELECT f.match_id, start_time, hero_id AS hero, is_radiant, if(game_mode = 23, 'turbo', 'normal') AS bucket, patch, g.name AS rank_group,
         ['core', 'core', 'offlane', 'support'][least(4, row_number() OVER (PARTITION BY f.match_id, is_radiant ORDER BY net_worth DESC, hero_id))] AS role,
         len(list_filter(if(game_mode = 23, [900, 1320, 1800], [1500, 2100, 2700]), lambda edge: duration >= edge))::INTEGER AS stratum,
         {wt} AS wt, is_radiant = radiant_win AS win, items
  FROM first_rows f LEFT JOIN best_rank b ON b.match_id = f.match_id
  LEFT JOIN (VALUES ('G1', 10, 39), ('G2', 40, 59), ('G3', 60, 89)) g(name, low, high) ON tier BETWEEN low AND high
)"""


#: The answers and the key items that each player is credited with.
SQL_OWNED = """
held AS (SELECT match_id, is_radiant, hero, unnest(items) AS z FROM pg),
owned_y AS (SELECT DISTINCT match_id, is_radiant, hero, y FROM held JOIN expand USING (z)),
owned_x AS (SELECT DISTINCT match_id, is_radiant, hero, x FROM held JOIN key_items ON x = z)"""


def sql_games() -> str:
    return sql_plays() + "," + SQL_OWNED


def with_sql(*ctes: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(c.strip() for c in ctes) + "\n"


ADVICE = AdviceConfig()
THREAT = ThreatConfig(min_length_games=5.0, min_pair_games=5.0)
UPLIFT = UpliftConfig(min_pair_games=20, min_base_games=5, wr_filter_games=50)
TIMING = TimingConfig(min_samples=5, max_age_days=3650)
LAST_DAY = DAY
