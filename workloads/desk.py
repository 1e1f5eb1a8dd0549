"""The alert job on a stream of packets made from events, with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from skirmish.operators import asof
from skirmish.session import scratch_path, small_table
from skirmish.streaming import alerts, jobs
from workloads import tables as T
from workloads import tables2 as T2
from workloads.flow import GAME, SPEC_SCHEMA, SQL_ALERTS, EV
from workloads.registry import query

SPECS = [
    ("rune", "periodic", 360, 120, None, [], None, [], [10], [30, 10]),
    ("bounty", "periodic", 0, 240, 3000, [], None, [], [10], []),
    ("water", "at_times", None, None, None, [120, 240], None, [], [10], []),
    ("boss", "at_times", None, None, None, [1200], None, [], [0], []),
]
AFTER = {"error": [("echo", 20, 5), ("echo", 20, 12), ("echo", 26, 5), ("echo", 26, 12)]}
PRIORITIES = {"rune": 1, "bounty": 2, "water": 1, "boss": 3, "echo": 3}
PACKETS = 15  # two seconds apart, after each event


def desk_packets(spark, d):
    """Fifteen packets after each event; some are paused, errors trigger, some events ask for silence."""
    e = T2.events(spark, d).select("*", F.explode(F.sequence(F.lit(0), F.lit(PACKETS - 1))).alias("i"))
    first = F.col("i") == 0
    clock = (F.col("sec") % GAME + 2 * F.col("i")).cast("int")
    return e.select(
        (F.col("user_id") * 1000 + F.expr(f"sec div {GAME}")).alias("match_id"),
        F.timestamp_seconds(F.col("sec") + 2 * F.col("i") + 1704067200).alias("ts"),
        (F.col("event_id") * 100 + F.col("i")).alias("order_"), clock.alias("clock"),
        (~((F.col("k") % 10 == 3) & F.col("i").between(5, 7))).alias("shown"),
        F.when(first & (F.col("event_type") == "error"), "error").alias("trigger"),
        F.when(first & (F.col("event_type") == "error"), clock).alias("trigger_at"),
        (first & (F.col("k") % 16 == 5)).alias("quiet"),
    )


def recorded(spark, rows, label):
    """Rows on disk, with a last one a day later that moves the watermark past all others."""
    path = scratch_path(spark, label)
    end = rows.agg((F.max("ts") + F.expr("interval 1 day")).alias("ts")).select(
        F.lit(-1).cast("long").alias("match_id"), "ts", F.lit(0).cast("long").alias("order_"), F.lit(None).cast("int").alias("clock"), F.lit(False).alias("shown"),
        F.lit(None).cast("string").alias("trigger"), F.lit(None).cast("int").alias("trigger_at"), F.lit(False).alias("quiet"),
    )
    rows.unionByName(end).write.parquet(path)
    return spark.readStream.schema(rows.schema).parquet(path)


SQL_DESK = """
dk AS (
  SELECT user_id * 1000 + sec // 7200 AS match_id, sec + 2 * i AS moment, event_id * 100 + i AS ord, (sec % 7200 + 2 * i)::INTEGER AS clock,
         NOT (k % 10 = 3 AND i BETWEEN 5 AND 7) AS shown, i = 0 AND event_type = 'error' AS trig, i = 0 AND k % 16 = 5 AS quiet
  FROM ev, range(15) r(i)
),
hits AS (SELECT DISTINCT match_id, clock FROM dk WHERE trig),
kept AS (
  SELECT match_id, min(clock) AS clock FROM hits GROUP BY match_id
  UNION ALL SELECT match_id, (SELECT min(h.clock) FROM hits h WHERE h.match_id = k.match_id AND h.clock >= k.clock + 60) FROM kept k WHERE clock IS NOT NULL
),
steps AS (
  SELECT *, greatest(coalesce(before, clock + 4), clock + 1) AS lo, clock + 5 AS hi FROM (
    SELECT *, row_number() OVER w AS rn, lag(clock + 5) OVER w AS before FROM dk WHERE shown WINDOW w AS (PARTITION BY match_id ORDER BY moment, ord))
),
prio(event_id, pr) AS (VALUES ('rune', 1), ('bounty', 2), ('water', 1), ('boss', 3), ('echo', 3)),
pushed AS (
  SELECT DISTINCT match_id, fire, event_id, event_time, pr FROM (
    SELECT match_id, fire_time AS fire, event_id, event_time FROM steps JOIN al ON fire_time > lo AND fire_time <= hi
    UNION ALL SELECT s.match_id, k.clock + d - w, 'echo', k.clock + d
    FROM kept k CROSS JOIN (VALUES (20, 5), (20, 12), (26, 5), (26, 12)) a(d, w) JOIN steps s ON s.match_id = k.match_id AND k.clock + d - w > lo AND k.clock + d - w <= hi
  ) JOIN prio USING (event_id)
),
heads AS (
  SELECT match_id, min(fire) AS head FROM pushed GROUP BY match_id
  UNION ALL SELECT match_id, (SELECT min(p.fire) FROM pushed p WHERE p.match_id = h.match_id AND p.fire > h.head + 5) FROM heads h WHERE head IS NOT NULL
),
shows AS (
  SELECT h.match_id, h.head, count(*) AS alerts, arg_min({'e': event_id, 't': event_time, 'p': pr}, (-pr, fire, event_id, event_time)) AS best,
         (SELECT min(rn) FROM steps s WHERE s.match_id = h.match_id AND s.clock >= h.head) AS rn
  FROM heads h JOIN pushed p ON p.match_id = h.match_id AND p.fire BETWEEN h.head AND h.head + 5 GROUP BY h.match_id, h.head
),
texts AS (SELECT s.match_id, s.rn, moment, clock, head, alerts, best FROM shows h JOIN steps s USING (match_id, rn) WHERE clock - head <= 5),
told AS (
  SELECT s.match_id, s.rn, s.moment, s.clock, s.quiet,
         EXISTS (FROM dk q WHERE q.match_id = s.match_id AND q.quiet AND (q.moment, q.ord) <= (s.moment, s.ord) AND s.moment < q.moment + 20) AS still,
         (SELECT list({'n': -best.p, 't': best.t, 'e': best.e}) FROM texts t WHERE t.match_id = s.match_id AND t.rn = s.rn) AS new
  FROM steps s
),
talk(match_id, rn, queue, last, said, clock, moment) AS (
  SELECT DISTINCT match_id, 0::BIGINT, []::STRUCT(n INTEGER, t INTEGER, e VARCHAR)[], NULL::BIGINT, NULL::STRUCT(n INTEGER, t INTEGER, e VARCHAR), 0, 0::BIGINT FROM told
  UNION ALL
  SELECT match_id, rn, if(speaks, queue[2:], queue), if(speaks, moment, last), if(speaks, queue[1], NULL), clock, moment
  FROM (
    SELECT *, NOT still AND len(queue) > 0 AND (queue[1].n <= -3 OR last IS NULL OR moment - last >= 8) AS speaks FROM (
      SELECT o.match_id, o.rn, o.moment, o.clock, o.still, k.last,
             list_sort(list_filter(list_concat(if(o.quiet, [], k.queue), if(o.still, [], coalesce(o.new, []))), lambda v: o.clock <= v.t + 5)) AS queue
      FROM talk k JOIN told o ON o.match_id = k.match_id AND o.rn = k.rn + 1))
)"""


@query("alert_job", T.with_sql(EV, SQL_ALERTS, SQL_DESK) + """
SELECT match_id, 'text' AS kind, moment AS "at", clock, head, alerts::INTEGER AS alerts, best.e AS event_id, best.t AS event_time, best.p AS priority FROM texts
UNION ALL SELECT match_id, 'voice', moment, clock, NULL, NULL, said.e, said.t, -said.n FROM talk WHERE said IS NOT NULL""")
def alert_job(spark, d):
    """Packets in, texts and spoken voices out: schedule, triggers, merge window, queue of voices, silence, late drop."""
    table = asof.alert_table(small_table(spark, SPECS, SPEC_SCHEMA), GAME)
    with alerts.rocks(spark):
        said = jobs.drain(alerts.alert_job(recorded(spark, desk_packets(spark, d), "packets"), table, AFTER, PRIORITIES), "alert_job")
    return said.withColumn("at", (F.col("at") - 1704067200).cast("long"))
