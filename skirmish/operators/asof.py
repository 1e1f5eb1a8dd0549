"""Time joins: the name in force at a moment, the nearest point, events due in a window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skirmish.operators.rows import around_sliced
from skirmish.session import pull_small

MAX_INLINE_DATES = 2_000
SLICE_SEC = 3600.0


def effective_name(df: DataFrame, time: str, names: DataFrame, out: str) -> DataFrame:
    """Name with the last date not after ``time``; the first name of the list before any date.

    ``names`` is (name, since epoch seconds, ord: position in the list). A short calendar becomes
    one array literal looked up per row; a longer one is joined by day.
    """
    rows = pull_small(names.select("name", "since", "ord"), MAX_INLINE_DATES)
    if rows is not None:
        dated = sorted(rows, key=lambda r: (r["since"], r["ord"]))
        first = min(rows, key=lambda r: r["ord"])["name"]
        calendar = F.array(*[F.struct(F.lit(int(r["since"])).alias("s"), F.lit(r["name"]).alias("n")) for r in dated])
        past = F.filter(calendar, lambda e: e["s"] <= F.col(time))
        return df.withColumn(out, F.coalesce(F.try_element_at(past, F.lit(-1))["n"], F.lit(first)))
    first = names.agg(F.min_by("name", "ord")).scalar()
    days = names.groupBy(F.col("since").alias("from_")).agg(F.max_by("name", "ord").alias("n_"))
    spans = days.withColumn("to_", F.lead("from_").over(Window.orderBy("from_")))
    joined = df.join(spans, (F.col(time) >= F.col("from_")) & (F.col("to_").isNull() | (F.col(time) < F.col("to_"))), "left")
    return joined.withColumn(out, F.coalesce("n_", first)).drop("from_", "to_", "n_")


def nearest_point(
    targets: DataFrame, points: DataFrame, target_id: str, target_time: str, point_id: str, point_time: str, tolerance: int
) -> DataFrame:
    """For each target the point closest in time, if within ``tolerance`` (ties: earlier, then smaller id).

    Points are thinned to one a moment; then one sorted pass in slices of time gives each target the points on either
    side, so the work is linear in the rows for any tolerance.
    """
    thin = points.groupBy(point_time).agg(F.min(point_id).alias(point_id)).withColumnRenamed(point_time, target_time)
    sides = around_sliced(targets.select(target_id, target_time), thin, [], target_time, [point_id], SLICE_SEC)
    now = F.col(target_time)
    side = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col(f"{c}.{target_time}") - now).alias("gap"), F.col(f"{c}.{target_time}").alias("at"), F.col(f"{c}.{point_id}").alias("id")))
    best = F.least(side("before_"), side("after_"))
    near = sides.withColumn("b_", F.when(best["gap"] <= tolerance, best))
    return near.select(target_id, target_time, F.col("b_.id").alias(point_id), F.col("b_.at").alias(point_time), F.col("b_.gap").alias("gap"))


def schedule(specs: DataFrame, lo: Column, hi: Column) -> DataFrame:
    """Adds ``occurrences`` array<struct<index, event_time>> of each timer between the clocks lo and hi.

    ``specs`` is (event_id, kind, first, interval, until, times, ...); after-trigger timers are
    handled by ``trigger_alerts``.
    """
    stop = F.least(hi, F.coalesce(F.col("until"), hi))
    n = F.floor((stop - F.col("first")) / F.col("interval")).cast("int")
    start = F.greatest(F.lit(0), F.ceil((lo - F.col("first")) / F.col("interval")).cast("int"))
    periodic = F.when(
        n >= start,
        F.transform(
            F.sequence(start, n),
            lambda k: F.struct(k.alias("index"), (F.col("first") + k * F.col("interval")).cast("int").alias("event_time")),
        ),
    ).otherwise(F.array().cast("array<struct<index:int,event_time:int>>"))
    listed = F.transform("times", lambda t, i: F.struct(i.alias("index"), t.alias("event_time")))
    return specs.withColumn("occurrences", F.when(F.col("kind") == "periodic", periodic).otherwise(listed))


def warned(index: Column) -> Column:
    """Warning leads of an occurrence: the first one may have its own list."""
    own = (index == 0) & (F.size("first_warn") > 0) & (F.col("kind") != "after_trigger")
    return F.when(own, F.col("first_warn")).otherwise(F.col("warn"))


def alert_table(specs: DataFrame, max_clock: int, min_clock: int = -120) -> DataFrame:
    """All scheduled alerts that fire up to ``max_clock`` and some beyond: (event_id, index, event_time, warn_before, fire_time).

    The table depends on the schedule only (a few hundred rows per hour of clock), so it is
    evaluated once and joined to the clocks of any number of matches.
    """
    leads = F.greatest(F.coalesce(F.array_max("warn"), F.lit(0)), F.coalesce(F.array_max("first_warn"), F.lit(0)))
    lead = max(600, specs.agg(F.max(leads)).first()[0] or 0)  # no event is warned of earlier than this
    timed = schedule(specs.where("kind <> 'after_trigger'"), F.lit(min_clock), F.lit(max_clock + lead))
    occ = timed.select("event_id", "kind", "warn", "first_warn", F.inline("occurrences"))
    alerts = occ.select("event_id", "index", "event_time", F.explode(warned(F.col("index"))).alias("warn_before"))
    return alerts.withColumn("fire_time", F.col("event_time") - F.col("warn_before"))


def clock_steps(packets: DataFrame, keys: list[str], order: list[str], clock: str, max_late: int, slice_width: float, time: str) -> DataFrame:
    """Window (lo, clock] of every packet: from the previous clock of the match, at most ``max_late`` back.

    A first packet or a clock that went back starts just before itself.
    """
    from skirmish.operators.rows import lag_sliced

    p = lag_sliced(packets, keys, time, order, clock, slice_width, "prev_")
    last = F.when(F.col("prev_").isNull() | (F.col(clock) < F.col("prev_")), F.col(clock) - 1).otherwise(F.col("prev_"))
    return p.withColumn("lo", F.greatest(last, F.col(clock) - max_late - 1)).drop("prev_")


def due_alerts(steps: DataFrame, alerts: DataFrame, clock: str, max_late: int) -> DataFrame:
    """Alerts whose fire time lies in (lo, clock] of a packet.

    A window is at most ``max_late + 1`` seconds wide, so it is exploded into its seconds and
    joined to the alerts by equality.
    """
    seconds = steps.where(F.col(clock) > F.col("lo")).withColumn("fire_time", F.explode(F.sequence(F.col("lo") + 1, F.col(clock))))
    return seconds.join(alerts, "fire_time")


def dedupe_triggers(triggers: DataFrame, keys: list[str], clock: str, gap: int) -> DataFrame:
    """Triggers kept when no kept one lies closer than ``gap`` seconds (see streaming.sessions)."""
    from skirmish.streaming.sessions import greedy_heads

    return greedy_heads(triggers, keys, clock, gap)


def trigger_alerts(triggers: DataFrame, specs: DataFrame, clock: str) -> DataFrame:
    """Alerts that follow kept triggers: one per delay and warning."""
    wanted = specs.where("kind = 'after_trigger'").select("event_id", "kind", "trigger", "delays", "warn", "first_warn")
    rows = triggers.join(wanted, "trigger").select("*", F.posexplode("delays").alias("index", "delay"))
    rows = rows.withColumn("event_time", F.col(clock) + F.col("delay"))
    rows = rows.withColumn("warn_before", F.explode("warn"))
    return rows.withColumn("fire_time", F.col("event_time") - F.col("warn_before")).drop("kind", "delays", "warn", "first_warn", "delay")


def window_starts(run_start: Column, windows: int, parity: int, step_hours: int = 2, min_age_hours: int = 1) -> Column:
    """Starts of sampling windows on the fixed UTC hour grid, newest first, even or odd hours only."""
    newest = F.floor((run_start - min_age_hours * 3600) / 3600)
    aligned = F.when(newest % 2 == parity, newest).otherwise(newest - 1)
    return F.transform(F.sequence(F.lit(0), F.lit(windows - 1)), lambda k: (aligned - k * step_hours) * 3600)


def spaced_points(low: Column, high: Column, count: int) -> Column:
    """At most ``count`` + 1 evenly spaced ids from high down to low."""
    step = F.greatest(F.lit(1), F.floor((high - low) / count)).cast("bigint")
    return F.sequence(high.cast("bigint"), low.cast("bigint"), -step)
