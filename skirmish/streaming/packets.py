"""Telemetry packets: parsing, event dedupe, first-seen, mode detection, change detection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skirmish.schemas import PACKET

IN_MATCH = ("DOTA_GAMERULES_STATE_PRE_GAME", "DOTA_GAMERULES_STATE_GAME_IN_PROGRESS")
SLOT_PREFIXES = ("slot", "stash", "neutral")
ITEM_PREFIX = "item_"


def read_packets(spark: SparkSession, path: str, streaming: bool = True, files_per_trigger: int = 16) -> DataFrame:
    """Recorded JSON lines, as a stream replayed in file order or as a batch; broken lines are dropped."""
    if streaming:
        return spark.readStream.schema(PACKET).option("mode", "DROPMALFORMED").option("maxFilesPerTrigger", files_per_trigger).json(path)
    return spark.read.schema(PACKET).option("mode", "DROPMALFORMED").json(path)


def own_items(items: Column) -> Column:
    """Set of item keys in counted slots, prefix removed."""
    slots = F.map_filter(items, lambda k, v: k.rlike("^(" + "|".join(SLOT_PREFIXES) + ")") & v["name"].startswith(ITEM_PREFIX))
    names = F.transform(F.map_values(slots), lambda v: F.substr(v["name"], F.lit(len(ITEM_PREFIX) + 1)))
    return F.array_sort(F.array_distinct(names))


def parse_packets(packets: DataFrame) -> DataFrame:
    """Packet to typed state. Events carry the match clock: game time minus (game time - clock)."""
    m = F.col("data.map")
    offset = m["game_time"] - m["clock_time"]
    event_type = "event_type string, game_time double"

    def one(e: Column) -> Column:
        head = F.from_json(e, event_type)
        clock = F.coalesce((head["game_time"] - offset).cast("int"), m["clock_time"], F.lit(0))
        return F.struct(head["event_type"].alias("event_type"), clock.alias("clock"), head["game_time"].alias("game_time"), e.alias("payload"))

    known = F.filter(F.coalesce("data.events", F.array().cast("array<string>")), lambda e: F.get_json_object(e, "$.event_type").isNotNull())
    match_id = F.when(~m["matchid"].isin("", "0"), m["matchid"])
    return packets.select(
        F.timestamp_seconds("t").alias("ts"),
        match_id.alias("match_id"),
        m["clock_time"].alias("clock"),
        m["game_state"].alias("game_state"),
        F.coalesce(m["paused"], F.lit(False)).alias("paused"),
        m["daytime"].alias("daytime"),
        F.col("data.hero.name").alias("hero"),
        F.col("data.hero.alive").alias("alive"),
        F.col("data.player.gold_from_income").alias("income"),
        own_items(F.col("data.items")).alias("own_items"),
        F.transform(known, one).alias("events"),
    )


def active(states: DataFrame) -> DataFrame:
    """Packets the timers see: in a match, not paused, clock known."""
    return states.where(F.col("game_state").isin(*IN_MATCH) & ~F.col("paused") & F.col("clock").isNotNull())


def match_events(states: DataFrame) -> DataFrame:
    """(ts, match_id, event_type, clock, game_time, payload) of each event of each packet; ``payload`` is canonical JSON, names in
    order at every level, so that copies of an event are equal texts."""
    events = states.select("ts", "match_id", F.inline("events"))
    return events.withColumn("payload", F.coalesce(F.to_json(F.try_parse_json("payload")), "payload"))


def new_events(events: DataFrame, keys: Sequence[str], time: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """First copy of every event: packets repeat events, so copies arrive close together."""
    if events.isStreaming:
        return events.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(keys))
    return events.dropDuplicates(list(keys))


def first_seen(events: DataFrame, keys: Sequence[str], time: str = "ts", delay: str = "3 hours") -> DataFrame:
    """First sighting per key (match, hero, item): exact minimum in batch, first arrival on a stream."""
    if events.isStreaming:
        return events.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(keys))
    return events.groupBy(*keys).agg(F.min(time).alias(time))


def detect_mode(states: DataFrame, match: str, clock: str, income: str, order: str, lo: int = 30, hi: int = 300, per_sec: float = 2.25) -> DataFrame:
    """Mode of a match from its first packet in [lo, hi]: passive income per second.

    In a batch ``order`` may be a struct, so that packets of one second have an order too.
    """
    usable = states.where(F.col(clock).between(lo, hi) & F.col(income).isNotNull())
    mode = F.when(F.col(income) / F.col(clock) > per_sec, "turbo").otherwise("normal")
    if states.isStreaming:
        return usable.withColumn("mode", mode).withWatermark(order, "3 hours").dropDuplicatesWithinWatermark([match]).select(match, clock, "mode")
    return usable.withColumn("mode", mode).groupBy(match).agg(F.min_by(F.struct(clock, "mode"), order).alias("m")).select(match, "m.*")


def packet_sessions(events: DataFrame, key: str, time: str, gap: str) -> DataFrame:
    """Sessions of packets without a match id."""
    return events.groupBy(key, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("packets")).select(
        key, F.col("w.start").alias("first_at"), F.col("w.end").alias("closed_at"), "packets"
    )
