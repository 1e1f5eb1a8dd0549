"""Greedy grouping along time: heads, anchored merge groups, rate limits, hysteresis (batch form).

A key's rows are first cut where the gap alone decides. A piece of up to PIECE_ROWS rows is one array that is folded; in a
longer one every row points at the row that would come next after it, and the rows that can be reached from the first are
found by doubling the pointers, so that no task ever holds a whole piece. Hysteresis is cut into slices of time: what a
slice makes of each state it may be entered with is a small table, and tables are followed from slice to slice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skirmish.operators.rows import around_sliced, lag_sliced, running_sum_sliced
from skirmish.session import stage

SLICE_SEC = 3600.0
PIECE_ROWS = 512


def with_session(df: DataFrame, keys: Sequence[str], time: str, order: Sequence[str], gap: float, slice_width: float = SLICE_SEC, closed: bool = False) -> DataFrame:
    """Adds ``session``: a new one starts when at least ``gap`` (``closed``: more) passed since the previous row."""
    lagged = lag_sliced(df, keys, time, order, time, slice_width, "before_")
    passed = F.col(time) - F.col("before_")
    starts = (F.col("before_").isNull() | (passed > gap if closed else passed >= gap)).cast("int")
    return running_sum_sliced(lagged, keys, time, order, starts, slice_width, "session").drop("before_")


def reachable(nodes: DataFrame, keys: Sequence[str], roots: DataFrame) -> DataFrame:
    """(keys, at) of every node on the way from the roots. ``nodes`` is (keys, at, next), ``roots`` (keys, at).

    Pointers are doubled until none is left, then walked from the longest to the shortest: twice the logarithm of the
    longest way in joins.
    """
    keys = list(keys)
    jumps = [stage(nodes.where(F.col("next").isNotNull()), "jumps")]
    while not jumps[-1].isEmpty():
        onward = jumps[-1].select(*keys, F.col("at").alias("next"), F.col("next").alias("far"))
        jumps.append(stage(jumps[-1].join(onward, [*keys, "next"]).select(*keys, "at", F.col("far").alias("next")), "jumps"))
    found = roots.select(*keys, "at")
    for jump in reversed(jumps[:-1]):
        found = stage(found.unionByName(found.join(jump, [*keys, "at"]).select(*keys, F.col("next").alias("at"))), "found")
    return found


def _cut(df: DataFrame, keys: Sequence[str], time: str, order: Sequence[str], gap: float, closed: bool) -> tuple[DataFrame, DataFrame | None]:
    """Rows of short pieces and of long ones (None when there is none), with ``session``."""
    own = [*keys, "session"]
    cut = with_session(df, keys, time, order, gap, closed=closed)
    cut = stage(cut.withColumn("rows_", F.count("*").over(Window.partitionBy(*own))), "pieces")
    long = cut.where(F.col("rows_") > PIECE_ROWS)
    return cut.where(F.col("rows_") <= PIECE_ROWS).drop("rows_"), None if long.isEmpty() else long.drop("rows_")


def anchored_groups(df: DataFrame, keys: Sequence[str], time: str, order: Sequence[str], gap: float, closed: bool = False) -> DataFrame:
    """Adds ``head``: time of the first row of the row's group; a group ends ``gap`` after its head.

    ``closed``: a row exactly ``gap`` after the head still belongs to it.
    """
    own = [*keys, "session"]
    short, long = _cut(df, keys, time, order, gap, closed)
    far = lambda since, now: now - since > gap if closed else now - since >= gap
    times = F.array_sort(F.collect_set(time))
    empty = F.array().cast(f"array<{dict(df.dtypes)[time]}>")
    heads = F.aggregate("times_", empty, lambda got, t: F.when((F.size(got) == 0) | far(F.element_at(got, -1), t), F.concat(got, F.array(t))).otherwise(got))
    grouped = short.groupBy(*own).agg(times.alias("times_")).select(*own, heads.alias("heads_"))
    out = short.join(grouped, own).withColumn("head", F.element_at(F.filter("heads_", lambda h: h <= F.col(time)), -1)).drop("heads_")
    if long is not None:
        nodes = stage(long.select(*own, F.col(time).alias("at")).distinct(), "times")
        asked = nodes.withColumn("from_", F.col("at") + gap)
        points = nodes.withColumnRenamed("at", "from_")
        onward = around_sliced(asked, points, own, "from_", [], max(16 * gap, 1.0), strict=closed)
        nodes = onward.select(*own, "at", F.col("after_.from_").alias("next"))
        found = reachable(nodes, own, nodes.groupBy(*own).agg(F.min("at").alias("at")))
        placed = around_sliced(long, found.withColumnRenamed("at", time), own, time, [], max(16 * gap, 1.0))
        out = out.unionByName(placed.withColumn("head", F.col(f"before_.{time}")).drop("before_", "after_"))
    return out.drop("session")


def greedy_heads(df: DataFrame, keys: Sequence[str], time: str, gap: float, order: Sequence[str] | None = None) -> DataFrame:
    """Rows at least ``gap`` after the last kept row of their key."""
    order = list(order or [time])
    grouped = anchored_groups(df, keys, time, order, gap)
    return grouped.where(F.col(time) == F.col("head")).drop("head").dropDuplicates([*keys, time])


def rate_limited(
    df: DataFrame, keys: Sequence[str], time: str, order: Sequence[str], priority: str, interval: float, top_priority: int
) -> DataFrame:
    """Adds ``spoken``: top priority always speaks, others only ``interval`` after the last voice. ``order`` is unique in a key.

    Cutting at gaps of ``interval`` is exact: after such a gap the limit is open again.
    """
    own = [*keys, "session"]
    short, long = _cut(df, keys, time, order, interval, False)
    place = F.struct(*order)
    kind = f"array<struct<{', '.join(f'{c}:{dict(df.dtypes)[c]}' for c in order)}>>"
    rows = F.array_sort(F.collect_list(F.struct(place.alias("place"), F.col(time).alias("now"), (F.col(priority) >= top_priority).alias("top"))))
    start = F.struct(F.lit(None).cast(dict(df.dtypes)[time]).alias("last"), F.array().cast(kind).alias("said"))

    def hear(state: Column, row: Column) -> Column:
        speaks = row["top"] | state["last"].isNull() | (row["now"] - state["last"] >= interval)
        return F.when(speaks, F.struct(row["now"].alias("last"), F.concat(state["said"], F.array(row["place"])).alias("said"))).otherwise(state)

    said = short.groupBy(*own).agg(rows.alias("rows_")).select(*own, F.aggregate("rows_", start, hear)["said"].alias("said_"))
    out = short.join(said, own).withColumn("spoken", F.array_contains("said_", place)).drop("said_")
    if long is not None:
        # the voice after a spoken row: the first row an interval later, or the next of top priority if that is earlier
        points = long.select(*own, *order, (F.col(priority) >= top_priority).alias("top_"))
        width = max(16 * interval, 1.0)
        asked = long.select(*own, place.alias("at"), (F.col(time) + interval).alias(time))
        later = around_sliced(asked, points.drop("top_"), own, time, order[1:], width).select(*own, "at", F.col("after_").alias("later"))
        tops = points.where("top_").drop("top_")
        urgent = around_sliced(long.select(*own, *order), tops, own, time, order[1:], width, strict=True, exact=True)
        urgent = urgent.select(*own, place.alias("at"), F.col("after_").alias("urgent"))
        nodes = stage(later.join(urgent, [*own, "at"]).select(*own, "at", F.least("later", "urgent").alias("next")), "voices")
        found = reachable(nodes, own, nodes.groupBy(*own).agg(F.min("at").alias("at"))).withColumn("spoken", F.lit(True))
        marked = long.withColumn("at", place).join(found, [*own, "at"], "left").withColumn("spoken", F.coalesce("spoken", F.lit(False)))
        out = out.unionByName(marked.drop("at"))
    return out.drop("session")


def steady_choice(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], choice: str, score: str, previous_score: str, reset_on: str, margin: float, slice_width: float = SLICE_SEC
) -> DataFrame:
    """Adds ``kept``: the previous choice stays unless the new one is ``margin`` better or ``reset_on`` changed.

    ``previous_score`` is a map column (choice -> score now) used to see whether the old choice is
    still offered and at what score. ``order`` starts with a time, cut into slices of ``slice_width``.
    """
    keys, types = list(keys), dict(df.dtypes)
    kind = f"struct<choice:{types[choice]},mark:{types[reset_on]},known:boolean>"
    state_of = lambda c, mark, known: F.struct(c.alias("choice"), mark.alias("mark"), F.lit(known).alias("known")).cast(kind)
    nothing = state_of(F.lit(None), F.lit(None), False)

    def chosen(state: Column, r: Column) -> Column:
        held = r["offered"][state["choice"]]
        stays = state["known"] & r["new"].isNotNull() & (r["new"] != state["choice"]) & state["mark"].eqNullSafe(r["mark"]) & (r["score"] < held + margin)
        return F.when(F.coalesce(stays, F.lit(False)), state["choice"]).otherwise(r["new"])

    def step(state: Column, r: Column) -> Column:
        out = chosen(state, r)
        return F.when(out.isNull(), state).otherwise(state_of(out, r["mark"], True))

    row = F.struct(
        F.struct(*order).alias("place"), F.col(choice).alias("new"), F.col(score).alias("score"), F.col(previous_score).alias("offered"),
        F.col(reset_on).alias("mark"), F.struct(*df.columns).alias("row"),
    )
    # maps have no order, so rows are sorted by their places alone
    sorted_rows = F.array_sort(F.collect_list(row), lambda a, b: F.when(a["place"] < b["place"], -1).when(a["place"] > b["place"], 1).otherwise(0))
    slices = stage(df.groupBy(*keys, F.floor(F.col(order[0]) / slice_width).alias("slice_")).agg(sorted_rows.alias("rows_")), "slices")
    chosen_rows = F.filter("rows_", lambda r: r["new"].isNotNull())
    domain = F.array_distinct(F.flatten(F.transform("rows_", lambda r: F.coalesce(F.map_keys(r["offered"]), F.array().cast(f"array<{types[choice]}>")))))
    first_mark = F.get(chosen_rows, F.lit(0))["mark"]
    table = F.map_from_entries(F.transform("domain_", lambda c: F.struct(c, F.aggregate("rows_", state_of(c, F.col("mark_"), True), step))))
    tables = slices.withColumns({"domain_": domain, "mark_": first_mark}).select(
        *keys, F.struct("slice_", F.col("mark_").alias("mark"), table.alias("table"), F.aggregate("rows_", nothing, step).alias("plain")).alias("t")
    )
    by_slice = F.array_sort(F.collect_list("t"), lambda a, b: F.when(a["slice_"] < b["slice_"], -1).otherwise(1))
    entry = f"array<struct<slice_:bigint,state:{kind}>>"

    def follow(at: Column, t: Column) -> Column:
        state = at["state"]
        met = state["known"] & state["mark"].eqNullSafe(t["mark"])
        left = F.when(~t["plain"]["known"], state).when(met, F.coalesce(t["table"][state["choice"]], t["plain"])).otherwise(t["plain"])
        here = F.array(F.struct(t["slice_"].alias("slice_"), state.alias("state"))).cast(entry)
        return F.struct(left.alias("state"), F.concat(at["entries"], here).alias("entries"))

    begin = F.struct(nothing.alias("state"), F.array().cast(entry).alias("entries"))
    entered = tables.groupBy(*keys).agg(by_slice.alias("ts_")).select(*keys, F.inline(F.aggregate("ts_", begin, follow)["entries"]))
    first = F.struct(F.col("state").alias("state"), F.array().cast(f"array<{types[choice]}>").alias("out"))
    walked = F.aggregate("rows_", first, lambda at, r: F.struct(step(at["state"], r).alias("state"), F.concat(at["out"], F.array(chosen(at["state"], r))).alias("out")))
    done = slices.join(entered, [*keys, "slice_"]).select(F.explode(F.arrays_zip(F.col("rows_.row").alias("row"), walked["out"].alias("kept"))).alias("z"))
    return done.select(*[F.col("z.row").getField(c).alias(c) for c in df.columns], F.col("z.kept").alias("kept"))
