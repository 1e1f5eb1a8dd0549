"""Recorded packets, their events, and bounded newest rows, with SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from skirmish.operators import profile, rows, timings
from skirmish.session import scratch_path, stage
from skirmish.streaming import packets
from workloads import tables as T
from workloads import tables2 as T2
from workloads.registry import query

EV = T2.SQL_EVENTS


def _packets(spark, d):
    """A packet an event, on disk as JSON lines: menu, play and pause; items in counted and other slots; a kill is repeated in
    the next packet with its names in another order; some lines are cut."""
    e = T2.events(spark, d)
    q = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    state = F.when(F.col("k") % 9 == 0, "DOTA_GAMERULES_STATE_INIT").when(F.col("k") % 9 == 1, "DOTA_GAMERULES_STATE_PRE_GAME").otherwise("DOTA_GAMERULES_STATE_GAME_IN_PROGRESS")
    kill = F.when(F.col("event_type") == "error", F.concat(F.lit('{"event_type":"kill","game_time":'), F.col("sec") + 90, F.lit(',"by":{"slot":'), F.col("k") % 5, F.lit(',"team":2}}')))
    again = F.when(F.col("event_type") == "error", F.concat(F.lit('{"by":{"team":2,"slot":'), F.col("k") % 5, F.lit('},"game_time":'), F.col("sec") + 90, F.lit(',"event_type":"kill"}')))
    text = F.concat(
        F.lit('{"t":'), F.col("sec") + F.col("again"), F.lit(',"data":{"map":{"matchid":'), q(F.when(F.col("k") % 9 == 0, "0").otherwise((F.col("user_id") + 1).cast("string"))),
        F.lit(',"clock_time":'), F.col("sec") % 7200, F.lit(',"game_time":'), F.col("sec") + 90, F.lit(',"game_state":'), q(state), F.lit(',"paused":'), (F.col("k") % 11 == 0).cast("string"),
        F.lit('},"player":{"gold_from_income":'), F.col("k") * 10, F.lit('},"hero":{"name":"h'), F.col("k") % 12, F.lit('"},"items":{"slot0":{"name":"item_'), F.col("k") % 7,
        F.lit('"},"slot1":{"name":"item_'), F.col("k") % 3, F.lit('"},"stash0":{"name":"empty"},"backpack0":{"name":"item_99"}},"events":['),
        F.coalesce(F.when(F.col("again") == 0, kill).otherwise(again), F.lit("")), F.lit("]}}"),
    )
    lines = e.withColumn("again", F.explode(F.when(F.col("event_type") == "error", F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    line = F.when((F.col("event_id") % 40 == 7) & (F.col("event_type") != "error"), F.substring(text, 1, 60)).otherwise(text)
    path = scratch_path(spark, "packets")
    lines.select(line.alias("value")).write.text(path)
    return stage(packets.parse_packets(packets.read_packets(spark, path, streaming=False)), "states")


SQL_PACKETS = """
pkt AS (
  SELECT *, unnest(CASE WHEN event_type = 'error' THEN [0, 1] ELSE [0] END) AS again FROM ev WHERE NOT (event_id % 40 = 7 AND event_type <> 'error')
),
seen AS (
  SELECT *, CASE WHEN k % 9 <> 0 THEN (user_id + 1)::VARCHAR END AS match_id, (sec % 7200)::INTEGER AS clock,
         CASE k % 9 WHEN 0 THEN 'DOTA_GAMERULES_STATE_INIT' WHEN 1 THEN 'DOTA_GAMERULES_STATE_PRE_GAME' ELSE 'DOTA_GAMERULES_STATE_GAME_IN_PROGRESS' END AS game_state, k % 11 = 0 AS paused
  FROM pkt
)"""


@query("parsed_packets", T.with_sql(EV, SQL_PACKETS) + """
SELECT match_id, clock, game_state, paused, 'h' || (k % 12) AS hero, k * 10 AS income,
       array_to_string(list_sort(list_distinct([(k % 7)::VARCHAR, (k % 3)::VARCHAR])), ',') AS own_items, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS events, count(*) AS packets
FROM seen GROUP BY ALL""")
def parsed_packets(spark, d):
    """Recorded packets as typed states; cut lines are dropped, only counted slots hold own items."""
    s = _packets(spark, d).select(
        "match_id", "clock", "game_state", "paused", "hero", "income", F.array_join("own_items", ",").alias("own_items"), F.size("events").alias("events")
    )
    return s.groupBy(*s.columns).agg(F.count("*").alias("packets"))


@query("new_packet_events", T.with_sql(EV, SQL_PACKETS) + """
SELECT DISTINCT match_id, 'kill' AS event_type, clock, sec + 90.0::DOUBLE AS game_time, k % 5 AS slot FROM seen WHERE event_type = 'error' AND game_state <> 'DOTA_GAMERULES_STATE_INIT' AND NOT paused""")
def new_packet_events(spark, d):
    """Events of active packets, each once: a copy in the next packet is the same whatever the order of its names."""
    events = packets.match_events(packets.active(_packets(spark, d)))
    kept = packets.new_events(events, ["match_id", "event_type", "game_time", "payload"])
    return kept.select("match_id", "event_type", "clock", "game_time", F.get_json_object("payload", "$.by.slot").cast("int").alias("slot"))


@query("packet_blocks", T.with_sql(EV, SQL_PACKETS) + """
SELECT block, count(*) AS packets FROM (
  SELECT unnest(['packet', if(match_id IS NULL, 'menu', 'match'), if(paused, 'paused', 'running')]) AS block FROM seen) GROUP BY block""")
def packet_blocks(spark, d):
    """How many recorded packets hold each kind of content."""
    blocks = F.array(F.lit("packet"), F.when(F.col("match_id").isNull(), "menu").otherwise("match"), F.when(F.col("paused"), "paused").otherwise("running"))
    return profile.block_counts(_packets(spark, d).withColumn("blocks", blocks), "blocks")


@query("newest_samples", T.with_sql(T.SQL_LINES) + """
SELECT hero_id AS hero, game_mode, match_id, start_time FROM (SELECT DISTINCT hero_id, game_mode, match_id, start_time FROM lines)
QUALIFY row_number() OVER (PARTITION BY hero_id, game_mode ORDER BY start_time DESC, match_id DESC) <= 200""")
def newest_samples(spark, d):
    """The newest 200 matches of each hero and mode, kept over three batches: the same as from scratch."""
    samples = T.matches(spark, d).select(F.col("hero_id").alias("hero"), "game_mode", "match_id", "start_time").distinct()
    samples, kept = stage(samples, "samples"), None
    for batch in range(3):
        fresh = samples.where(F.pmod(F.xxhash64("match_id"), F.lit(3)) == batch)
        kept = stage(timings.keep_newest(fresh if kept is None else kept, None if kept is None else fresh, ["hero", "game_mode"], 200), "kept")
    return kept.select("hero", "game_mode", "match_id", "start_time")


@query("last_hints", T.with_sql(EV) + """
SELECT user_id, event_type, k, sec, event_id FROM (SELECT user_id, event_type, k, max(sec) AS sec, arg_max(event_id, (sec, event_id)) AS event_id FROM ev GROUP BY ALL)
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY sec DESC, event_id DESC) <= 5""")
def last_hints(spark, d):
    """The last five different hints of each player."""
    e = T2.events(spark, d).select("user_id", "event_type", "k", "sec", "event_id")
    return rows.last_distinct(e, ["user_id"], ["event_type", "k"], "sec", ["event_id"], 5, 86400.0)
