"""Collection reports, log summaries, liveness and freshness, reason coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skirmish.functions.text import fingerprint
from skirmish.operators.rows import first_per_key

# The progress line of the collector's log.
LOG_LINE = r"(\d+) мин: ([\d.]+) запросов/мин, (\d+) матчей/час, 429 за отрезок (\d+) \(всего (\d+)\), пауза ([\d.]+) сек"
STALE_MIN, RECS_STALE_H, TIMING_STALE_H, MIN_RUN_H = 30, 24, 48, 11


def latest_runs(updates: DataFrame, version: str = "updated_at") -> DataFrame:
    """Latest row per run tag (run statistics are appended, never edited)."""
    return first_per_key(updates, ["tag"], [F.col(version).desc()])


def run_totals(runs: DataFrame, legacy: Column, broken: Column) -> DataFrame:
    """One row: runs, matches over all runs plus older and broken ones, bytes, the newest tag."""
    return runs.agg(
        F.count("*").alias("runs"), (F.sum("matches") + legacy + broken).alias("matches"), F.sum("bytes").alias("bytes"), F.max("tag").alias("tag")
    )


def parse_log(lines: DataFrame, column: str = "value", pattern: str = LOG_LINE) -> DataFrame:
    """Typed progress rows from log text; other lines are dropped by the same pattern."""
    names = ["minute", "per_minute", "per_hour", "limits", "limits_total", "pause"]
    hit = lines.where(F.col(column).rlike(pattern))
    keep = [c for c in lines.columns if c != column]
    return hit.select(*keep, *[F.regexp_extract(column, pattern, i + 1).cast("double").alias(n) for i, n in enumerate(names)])


def log_summary(rows: DataFrame, order: str) -> DataFrame:
    """Intervals, matches per hour (min, median, max), limits at the end, pauses."""
    per_rate = rows.groupBy("per_hour").agg(F.count("*").alias("k"))
    median = per_rate.agg(F.percentile("per_hour", F.lit(0.5), F.col("k")).alias("m")).scalar()
    return rows.agg(
        F.count("*").alias("intervals"), F.min("per_hour").alias("low"), F.max("per_hour").alias("high"),
        F.max_by("limits_total", order).alias("limits"), F.min("pause").alias("pause_low"), F.max("pause").alias("pause_high"),
        F.max_by("pause", order).alias("pause_last"),
    ).withColumn("median", median)


def part_groups(parts: DataFrame, runs: DataFrame) -> DataFrame:
    """(tag, parts, last): unfinished runs, that have parts but no summary."""
    return parts.groupBy("tag").agg(F.count("*").alias("parts"), F.max("updated_at").alias("last")).join(runs.select("tag"), "tag", "left_anti")


def liveness(groups: DataFrame, now: Column) -> DataFrame:
    """Adds ``running``: the last part is younger than the stale limit; otherwise the run is broken."""
    return groups.withColumn("running", now - F.col("last") < STALE_MIN * 60)


def throughput(matches: Column, started: Column, last: Column) -> Column:
    return matches / F.greatest((last - started) / 3600.0, F.lit(1e-6))


def freshness(assets: DataFrame, now: Column) -> DataFrame:
    """One row: newest data and artifact times, whether to compute, and whether the artifact is stale."""
    data = F.max(F.when(F.col("name").rlike(r"^(matches|ranks)-.*\.parquet$"), F.col("updated_at")))
    recs = F.max(F.when(F.col("name") == "recs", F.col("updated_at")))
    return assets.agg(data.alias("data_at"), recs.alias("recs_at")).select(
        "data_at", "recs_at",
        (F.col("recs_at").isNull() | F.col("data_at").isNull() | (F.col("data_at") > F.col("recs_at"))).alias("should_compute"),
        F.coalesce(now - F.col("recs_at") > RECS_STALE_H * 3600, F.lit(True)).alias("stale"),
    )


def should_collect(last_start: Column, now: Column, min_hours: float = MIN_RUN_H) -> Column:
    return F.coalesce((now - last_start) / 3600.0 >= min_hours, F.lit(True))


def reason_coverage(pairs: DataFrame, reasons: DataFrame, keys: list[str]) -> DataFrame:
    """One row: pairs, found, missing, stale (the text changed since the reason was written)."""
    r = reasons.select(*keys, F.col("text_key").alias("r_key"), "kind")
    j = pairs.join(r, keys, "left")
    missing = F.col("r_key").isNull()
    stale = ~missing & (F.col("r_key") != fingerprint(F.col("text")))
    return j.agg(
        F.count("*").alias("total"), F.count_if(~missing & ~stale & (F.col("kind") != "none")).alias("found"),
        F.count_if(missing).alias("missing"), F.count_if(stale).alias("stale"),
    )
