"""Replay of hints from text logs: typed lines, matches between markers, first sightings, totals.

A log may hold years of one desk, so matches are numbered by a running sum over slices of time, and first sightings
are combined before the shuffle; no key is ordered in one task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skirmish.operators.rows import running_sum_sliced

# Fixed value: the form of a log line.
LINE = r"^(\S+ \S+),(\d+) INFO (\S+): (.*)$"


@dataclass(frozen=True)
class LogWords:
    """How the log says things."""

    match: str = r"^New match\s*(.*)$"
    start: str = r"^Start$"
    items: str = r"^(\S+) new items: (.+)$"
    own: str = r"^Own hero: (.+)$"
    between: str = r",\s*"


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """``desk, at, ms, text`` of the lines that are log lines; ``desk`` is the name before the message."""
    lines = spark.read.text(path).where(F.col("value").rlike(LINE))
    part = lambda i: F.regexp_extract("value", LINE, i)
    at = F.try_to_timestamp(part(1), F.lit("yyyy-MM-dd HH:mm:ss"))
    typed = lines.select(part(3).alias("desk"), at.alias("at"), part(2).cast("int").alias("ms"), part(4).alias("text"))
    return typed.where("at is not null")


def day_of(at: Column) -> Column:
    """Start of the day of a time, in the session's zone."""
    return F.date_trunc("day", at)


def with_segments(lines: DataFrame, words: LogWords = LogWords(), slice_width: float = 86400.0) -> DataFrame:
    """``segment``: how many markers (new match, start) the desk has had, this line's included. Lines of one ms go by text."""
    marker = F.col("text").rlike(words.match) | F.col("text").rlike(words.start)
    timed = lines.withColumn("sec_", F.unix_timestamp("at"))
    return running_sum_sliced(timed, ["desk"], "sec_", ["sec_", "ms", "text"], marker.cast("long"), slice_width, "segment").drop("sec_")


def matches_of(lines: DataFrame, words: LogWords = LogWords()) -> DataFrame:
    """``desk, segment, match, own, started`` of each segment: its match by the marker, the last hero named as one's own."""
    said = lambda pattern: F.nullif(F.regexp_extract("text", pattern, 1), F.lit(""))
    own = said(words.own)
    place = F.struct("at", "ms", "text")
    return lines.groupBy("desk", "segment").agg(
        F.max(said(words.match)).alias("match"), F.max_by(own, F.when(own.isNotNull(), place)).alias("own"), F.min("at").alias("started")
    )


def sightings(lines: DataFrame, words: LogWords = LogWords()) -> DataFrame:
    """``desk, segment, at, ms, hero, item, n``: items as the log names them, repeats at one time in ``n``."""
    seen = lines.where(F.col("text").rlike(words.items)).select(
        "desk", "segment", "at", "ms", F.regexp_extract("text", words.items, 1).alias("hero"),
        F.explode(F.split(F.regexp_extract("text", words.items, 2), words.between)).alias("item"),
    )
    return seen.groupBy(*seen.columns).agg(F.count("*").alias("n"))


def replay(seen: DataFrame, threats: DataFrame, parents: DataFrame | None = None) -> DataFrame:
    """``sightings`` with ``threat, target, has_props, said``.

    ``threats``: ``item, has_props``, unique. ``parents``: ``hero, item, parent``, what a hero makes of a part (see
    ``hints.pick_parent``), unique. The target is the item where it is a threat, else the parent where that is one. A hint
    is said (true) at the first sighting of the target by this hero in the segment, the least item on a tie; later ones
    are false; without a target it is null.
    """
    known = threats.select("item", "has_props")
    rows = seen.join(known.select("item", F.lit(True).alias("threat"), F.col("has_props").alias("own_props")), "item", "left")
    if parents is not None:
        rows = rows.join(parents.select("hero", "item", "parent"), ["hero", "item"], "left")
        rows = rows.join(known.select(F.col("item").alias("parent"), F.col("item").alias("made"), F.col("has_props").alias("made_props")), "parent", "left")
    else:
        rows = rows.withColumns({"made": F.lit(None).cast("string"), "made_props": F.lit(None).cast("boolean")})
    rows = rows.select(
        *seen.columns, F.coalesce("threat", F.lit(False)).alias("threat"), F.when(F.col("threat"), F.col("item")).otherwise(F.col("made")).alias("target"),
        F.when(F.col("threat"), F.col("own_props")).otherwise(F.col("made_props")).alias("has_props"),
    )
    keys = ["desk", "segment", "hero", "target"]
    first = rows.where("target is not null").groupBy(*keys).agg(F.min(F.struct("at", "ms", "item")).alias("first_"))
    told = rows.join(first, keys, "left").withColumn("said", F.struct("at", "ms", "item") == F.col("first_"))
    return told.drop("first_")


def replay_totals(replayed: DataFrame, *by: str) -> DataFrame:
    """Items seen, hints, hints for items without a property, threats, threats whose hint had been said before."""
    n = F.col("n")
    count = lambda when, times=F.lit(1): F.coalesce(F.sum(F.when(when, times)), F.lit(0)).cast("long")
    return replayed.groupBy(*by).agg(
        F.sum(n).cast("long").alias("items"), count(F.col("said")).alias("hinted"), count(F.col("said") & ~F.col("has_props")).alias("no_property"),
        count(F.col("threat"), n).alias("threats"), count(F.col("threat"), n - F.coalesce("said", F.lit(False)).cast("long")).alias("already_said"),
    )
