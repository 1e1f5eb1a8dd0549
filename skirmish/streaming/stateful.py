"""Stateful jobs keyed by match: timers, merge window with voice limit, change detection, hysteresis."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

IDLE_MS = 3 * 3600 * 1000
#: Groups of keys whose states lie together in the state store. A running query keeps the number it started with.
SHARDS = 4096


def shard_of(keys: Sequence[str], shards: int = SHARDS) -> tuple[Column, Column]:
    """(shard, text) of a key: the group its state lies in, and the key as JSON (integers and strings come back as they were)."""
    return F.pmod(F.xxhash64(*keys), F.lit(shards)), F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})


def keyed(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], step: Callable, out_schema: str, time: str = "ts", finish: Callable | None = None, shards: int = SHARDS
) -> DataFrame:
    """``step(memo: dict, row) -> list of output tuples`` over a key's rows in order.

    Each key has a small dict, dropped once the watermark of ``time`` is three hours past the key's last row (a match is
    over by then). A call of Python, a pandas frame and an entry of the state store cost far more than a row, and most keys
    have few rows; so the keys are dealt to ``shards`` groups, and a group's dicts are one JSON text in the store. Rows of
    one micro-batch are ordered before they are applied. ``finish(memo)`` gives the last output tuples of a dropped key.
    """
    order = list(order)
    names = [part.split()[0] for part in out_schema.split(", ")]

    def run(_, frames, state: GroupState):
        memos = json.loads(state.get[0]) if state.exists else {}
        mark, out = state.getCurrentWatermarkMs(), []
        if not state.hasTimedOut:
            rows = pd.concat(list(frames)).sort_values(order, kind="stable")
            values = {text: tuple(json.loads(text).values()) for text in rows["key_"].unique()}
            for text, row in zip(rows["key_"], rows.drop(columns=["shard_", "key_"]).itertuples(index=False, name="Row")):
                memo = memos.setdefault(text, [0, {}])[1]
                out.extend((*values[text], *said) for said in step(memo, row))
            for text, last in rows.groupby("key_", sort=False)[time].max().items():
                memos[text][0] = max(int(last.timestamp() * 1000), mark) + IDLE_MS
        for text in [t for t, (until, _) in memos.items() if until < mark]:
            memo = memos.pop(text)[1]
            if finish:
                out.extend((*json.loads(text).values(), *said) for said in finish(memo))
        if memos:
            state.update((json.dumps(memos),))
            state.setTimeoutTimestamp(max(min(until for until, _ in memos.values()), mark + 1))
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=names)

    shard, text = shard_of(keys, shards)
    marked = df.withColumns({"shard_": shard, "key_": text}).withWatermark(time, "10 minutes")
    return marked.groupBy("shard_").applyInPandasWithState(run, out_schema, "memos string", "append", GroupStateTimeout.EventTimeTimeout)


def changed(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, key_schema: str) -> DataFrame:
    """Emit (order columns, value) whenever a non-null value differs from the key's last one."""

    def step(memo, row):
        now = getattr(row, value)
        if now is None or pd.isna(now) or memo.get("v") == str(now):
            return []
        memo["v"] = str(now)
        return [(int(getattr(row, order[0])), str(now))]

    return keyed(df, keys, order, step, f"{key_schema}, at bigint, value string")


def timer_alerts(packets: DataFrame, alerts: list[tuple], clock: str, match: str, key_schema: str, max_late: int = 3) -> DataFrame:
    """Alerts due at each packet: at most ``max_late`` seconds late, restarting when the clock goes back.

    ``alerts`` is the evaluated schedule (event_id, event_time, warn_before, fire_time).
    """
    by_second: dict[int, list[tuple]] = {}
    for event_id, event_time, warn, fire in sorted(alerts, key=lambda a: (a[3], a[0])):
        by_second.setdefault(fire, []).append((event_id, event_time, warn, fire))

    def step(memo, row):
        now = int(getattr(row, clock))
        last = memo.get("last")
        last = now - 1 if last is None or now < last else last
        lo = max(last, now - max_late - 1)
        memo["last"] = now
        return [(now, *a) for second in range(lo + 1, now + 1) for a in by_second.get(second, ())]

    return keyed(packets, [match], ["order_"], step, f"{key_schema}, clock int, event_id string, event_time int, warn_before int, fire_time int")


def merged_voices(
    alerts: DataFrame, match: str, key_schema: str, window: int = 5, interval: float = 8.0, top_priority: int = 3
) -> DataFrame:
    """One message per merge group (anchored at its first alert) and whether it is spoken.

    A group is closed by the first alert beyond the window, or when its match is over; the limit between voices does not hold
    back the top priority.
    """

    def close(memo):
        group = memo.pop("group", None)
        if not group:
            return []
        best = sorted(group, key=lambda a: (-a[1], a[0], a[2]))[0]
        head = group[0][0]
        spoken = best[1] >= top_priority or memo.get("voice") is None or head - memo["voice"] >= interval
        if spoken:
            memo["voice"] = head
        return [(head, len(group), best[2], int(best[1]), bool(spoken))]

    def step(memo, row):
        fire, priority, event = int(row.fire_time), int(row.priority), str(row.event_id)
        out = []
        group = memo.get("group")
        if group and fire > group[0][0] + window:
            out = close(memo)
            group = None
        memo["group"] = [*(group or []), [fire, priority, event]]
        return out

    return keyed(alerts, [match], ["fire_time"], step, f"{key_schema}, head int, alerts int, event_id string, priority int, spoken boolean", finish=close)


def first_hints(seen: DataFrame, match: str, key_schema: str) -> DataFrame:
    """Hints once per (kind, hero, item): a "building" hint is silent after the item itself was named."""

    def step(memo, row):
        said = memo.setdefault("said", {})
        kind, hero, item = row.kind, str(row.hero), str(row.item)
        mine = f"{kind}|{hero}|{item}"
        if mine in said or (kind == "building" and f"item|{hero}|{item}" in said):
            return []
        said[mine] = 1
        return [(int(row.clock), kind, hero, item)]

    return keyed(seen, [match], ["clock"], step, f"{key_schema}, clock int, kind string, hero string, item string")
