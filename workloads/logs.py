"""Hints replayed from text logs, with SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from skirmish.operators import replay
from skirmish.session import scratch_path, stage
from workloads import tables as T
from workloads import tables2 as T2
from workloads.registry import query


def _lines(spark, d):
    """A log line an event, on disk as text: markers, own hero, items; some lines are no log lines."""
    e = T2.events(spark, d)
    k = F.col("k")
    text = (
        F.when(k % 13 == 0, F.concat(F.lit("New match "), k))
        .when(k % 13 == 1, F.lit("Start"))
        .when(k % 13 == 2, F.concat(F.lit("Own hero: h"), k % 5))
        .otherwise(F.concat(F.lit("h"), k % 5, F.lit(" new items: item_"), k % 7, F.lit(", item_"), (k * 3) % 11))
    )
    stamp = F.date_format(F.timestamp_seconds(F.col("sec") + 1704067200), "yyyy-MM-dd HH:mm:ss")
    line = F.concat(stamp, F.lit(","), F.lpad((F.col("event_id") % 1000).cast("string"), 3, "0"), F.when(F.col("event_id") % 17 == 3, " DEBUG ").otherwise(" INFO "), F.lit("desk"), F.col("user_id") % 50, F.lit(": "), text)
    path = scratch_path(spark, "log")
    e.select(line.alias("value")).write.text(path)
    return stage(replay.with_segments(replay.read_log(spark, path)), "log_lines")


def _threats(spark, d):
    of = (F.col("p_partkey") % 11).alias("i")
    return T.read(spark, d, "part").select(of).distinct().where("i in (0, 2, 5)").select(F.concat(F.lit("item_"), "i").alias("item"), (F.col("i") % 2 == 0).alias("has_props"))


def _parents(spark, d):
    of = (F.col("s_suppkey") % 5).alias("i")
    return T.read(spark, d, "supplier").select(of).distinct().where("i < 3").select(F.concat(F.lit("h"), "i").alias("hero"), F.lit("item_3").alias("item"), F.lit("item_5").alias("parent"))


SQL_LINES = """
line AS (
  SELECT 'desk' || (user_id % 50) AS desk, sec, event_id % 1000 AS ms, k,
         CASE k % 13 WHEN 0 THEN 'New match ' || k WHEN 1 THEN 'Start' WHEN 2 THEN 'Own hero: h' || (k % 5)
              ELSE 'h' || (k % 5) || ' new items: item_' || (k % 7) || ', item_' || ((k * 3) % 11) END AS text
  FROM ev WHERE event_id % 17 <> 3 AND k IS NOT NULL
),
placed AS (
  SELECT *, count_if(k % 13 < 2) OVER (PARTITION BY desk ORDER BY sec, ms, text ROWS UNBOUNDED PRECEDING) AS segment FROM line
)"""
SQL_REPLAY = """
seen AS (
  SELECT desk, segment, sec, ms, hero, item, count(*) AS n
  FROM (SELECT *, 'h' || (k % 5) AS hero, unnest(['item_' || (k % 7), 'item_' || ((k * 3) % 11)]) AS item FROM placed WHERE k % 13 > 2) GROUP BY ALL
),
threat AS (SELECT DISTINCT 'item_' || (p_partkey % 11) AS item, p_partkey % 11 % 2 = 0 AS has_props FROM part WHERE p_partkey % 11 IN (0, 2, 5)),
made AS (SELECT DISTINCT 'h' || (s_suppkey % 5) AS hero, 'item_3' AS item, 'item_5' AS parent FROM supplier WHERE s_suppkey % 5 < 3),
aimed AS (
  SELECT s.*, t.item IS NOT NULL AS threat, coalesce(t.item, p.item) AS target, coalesce(t.has_props, p.has_props) AS has_props
  FROM seen s LEFT JOIN threat t USING (item) LEFT JOIN made m ON m.hero = s.hero AND m.item = s.item LEFT JOIN threat p ON p.item = m.parent
),
told AS (SELECT *, row_number() OVER (PARTITION BY desk, segment, hero, target ORDER BY sec, ms, item) = 1 AND target IS NOT NULL AS said FROM aimed)"""


@query("log_matches", T.with_sql(T2.SQL_EVENTS, SQL_LINES) + """
SELECT desk, segment::BIGINT AS segment, max(CASE WHEN k % 13 = 0 THEN k::VARCHAR END) AS "match",
       arg_max(CASE WHEN k % 13 = 2 THEN 'h' || (k % 5) END, (sec, ms, text)) FILTER (k % 13 = 2) AS own, min(sec)::BIGINT AS started, count(*) AS lines
FROM placed GROUP BY desk, segment""")
def log_matches(spark, d):
    """Matches of each desk's log, between markers."""
    lines = _lines(spark, d)
    counted = lines.groupBy("desk", "segment").agg(F.count("*").alias("lines"))
    got = replay.matches_of(lines).withColumn("started", F.unix_timestamp("started") - 1704067200)
    return got.join(counted, ["desk", "segment"])


@query("hint_replay", T.with_sql(T2.SQL_EVENTS, SQL_LINES, SQL_REPLAY) + """
SELECT desk, segment::BIGINT AS segment, sum(n)::BIGINT AS items, count_if(said)::BIGINT AS hinted, count_if(said AND NOT has_props)::BIGINT AS no_property,
       coalesce(sum(n) FILTER (threat), 0)::BIGINT AS threats, coalesce(sum(n - said::INTEGER) FILTER (threat), 0)::BIGINT AS already_said
FROM told GROUP BY desk, segment""")
def hint_replay(spark, d):
    """Hints that the logged items would bring, totals of each match."""
    return replay.replay_totals(replay.replay(replay.sightings(_lines(spark, d)), _threats(spark, d), _parents(spark, d)), "desk", "segment")
