"""More stand-ins: telemetry, alerts and inventories from events; JSON matches from order lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from workloads import tables as T


def events(spark: SparkSession, d: str) -> DataFrame:
    """(event_id, user_id, event_type, props, k, at): seconds since 2024-01-01 as the clock."""
    e = T.read(spark, d, "events")
    return e.select(
        "event_id", "user_id", "event_type", "props", "value",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        (F.unix_timestamp("ts") - 1704067200).alias("sec"),
        F.col("ts").cast("timestamp").alias("ts"),
    )


SQL_EVENTS = """
ev AS (
  SELECT event_id, user_id, event_type, props, value, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
         CAST(floor(epoch(ts)) AS BIGINT) - 1704067200 AS sec FROM events
)"""


def events_stream(spark: SparkSession, d: str) -> DataFrame:
    schema = T.read(spark, d, "events").schema
    e = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    return e.select(
        "event_id", "user_id", "event_type", "props", "value",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        (F.unix_timestamp("ts") - 1704067200).alias("sec"),
        F.col("ts").cast("timestamp").alias("ts"),
    )


def match_json(spark: SparkSession, d: str) -> DataFrame:
    """One JSON text per order: four-player matches from order lines (an order has at most seven lines)."""
    lines = T.match_lines(spark, d)
    player = F.struct(
        F.when((F.col("slot") == 3) & (F.col("net_worth") % 17 == 0), 0).otherwise(F.col("hero_id")).alias("hero_id"),
        (F.col("slot") % 2 * 128 + F.col("slot")).alias("player_slot"),
        F.col("items")[0].alias("item_0"),
        F.lit(0).alias("item_1"),
        F.col("items")[1].alias("item_2"),
        F.col("items")[2].alias("backpack_1"),
        F.col("net_worth"),
        (F.col("net_worth") % 40000).alias("gold_per_min"),
        (F.col("net_worth") % 200).alias("kills"),
        F.when(F.col("net_worth") % 23 == 0, 2).otherwise(0).alias("leaver_status"),
        F.lit(12345).alias("account_id"),
    )
    head = ["match_id", "start_time", "duration", "radiant_win"]
    mode = F.when(F.col("custkey") % 7 == 0, 4).otherwise(F.col("game_mode"))
    per = lines.groupBy(*head, mode.alias("game_mode")).agg(F.sort_array(F.collect_list(F.struct("slot", player.alias("p")))).alias("ps"))
    players = F.transform("ps", lambda x: x["p"])
    return per.select(F.to_json(F.struct(*head, "game_mode", F.lit(7).alias("lobby_type"), players.alias("players"))).alias("value"))


SQL_JSON_ROWS = """
jl AS (
  SELECT *, CASE WHEN slot = 3 AND net_worth % 17 = 0 THEN 0 ELSE hero_id END AS hid,
         CASE WHEN net_worth % 23 = 0 THEN 2 ELSE 0 END AS leaver, CASE WHEN custkey % 7 = 0 THEN 4 ELSE game_mode END AS mode2
  FROM lines
),
jok AS (
  SELECT match_id FROM jl GROUP BY match_id
  HAVING count(*) = 4 AND min(hid) > 0 AND max(leaver) <= 1 AND min(mode2) IN (1, 22, 23)
     AND min(duration) >= CASE WHEN min(mode2) = 23 THEN 600 ELSE 900 END
)"""


def patch_names(spark: SparkSession) -> DataFrame:
    from datetime import datetime, timezone

    from skirmish.session import small_table

    rows = [(n, int(datetime.fromisoformat(day).replace(tzinfo=timezone.utc).timestamp()), i) for i, (n, day) in enumerate(T.PATCHES)]
    return small_table(spark, rows, "name string, since bigint, ord int")
