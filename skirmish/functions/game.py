"""Column expressions of the game model: buckets, strata, weights, clocks, clamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Mode numbers of the two counted queues.
MODE_BUCKETS = {1: "normal", 22: "normal", 23: "turbo"}
MODE_BUCKETS_WIDE = {1: "normal", 2: "normal", 3: "normal", 4: "normal", 5: "normal", 22: "normal", 23: "turbo"}
MIN_DURATION_SEC = {"normal": 900, "turbo": 600}


def bucket_of(mode: Column, modes: dict[int, str] = MODE_BUCKETS) -> Column:
    out = F.lit(None).cast("string")
    for name in sorted(set(modes.values())):
        out = F.when(mode.isin(sorted(k for k, v in modes.items() if v == name)), name).otherwise(out)
    return out


def by_bucket(bucket: Column, values: dict[str, float]) -> Column:
    out = F.lit(None)
    for name, value in values.items():
        out = F.when(bucket == name, F.lit(value)).otherwise(out)
    return out


def stratum_of(bucket: Column, duration: Column, edges_min: dict) -> Column:
    """0..3 by game length; edges differ per bucket, unknown buckets use the turbo edges."""

    def ladder(edges) -> Column:
        a, b, c = (int(e) * 60 for e in edges)
        return F.when(duration < a, 0).when(duration < b, 1).when(duration < c, 2).otherwise(3)

    return F.when(bucket == "normal", ladder(edges_min["normal"])).otherwise(ladder(edges_min["turbo"]))


def rank_group_of(tier: Column, groups: dict) -> Column:
    out = F.lit(None).cast("string")
    for name, (lo, hi) in reversed(list(groups.items())):
        out = F.when(tier.between(lo, hi), name).otherwise(out)
    return out


def recency_weight(start: Column, half_life_sec: float, newest: Column | None = None, epoch: float | None = None) -> Column:
    """0.5^(age / T) against ``newest``, or the rescalable form 2^((start - epoch) / T)."""
    if epoch is not None:
        return F.pow(F.lit(2.0), (start - F.lit(float(epoch))) / F.lit(float(half_life_sec)))
    return F.pow(F.lit(0.5), (newest - start) / F.lit(float(half_life_sec)))


def role_of(place: Column) -> Column:
    return F.when(place <= 2, "core").when(place == 3, "offlane").otherwise("support")


def role_strength(role: Column) -> Column:
    """Tie-break of the main role: core over offlane over support."""
    return F.when(role == "core", 3).when(role == "offlane", 2).otherwise(1)


def side_of_slot(slot: Column) -> Column:
    return F.coalesce(slot, F.lit(0)) < 128


def clamp(value: Column, top: int, dtype: str) -> Column:
    """Cut to the storage width before the cast (an ANSI cast raises on overflow)."""
    return F.least(F.coalesce(value, F.lit(0)), F.lit(top)).cast(dtype)


def compact_items(slots: list[Column]) -> Column:
    return F.filter(F.array(*[F.coalesce(s, F.lit(0)) for s in slots]), lambda x: x != 0)


def clock_text(seconds: Column) -> Column:
    """m:ss with a leading minus before the horn."""
    s = F.abs(seconds.cast("int"))
    sign = F.when(seconds < 0, "-").otherwise("")
    return F.concat(sign, F.floor(s / 60).cast("string"), F.lit(":"), F.lpad((s % 60).cast("string"), 2, "0"))


def nearest_minute(seconds: Column) -> Column:
    """Half-up minute, never negative."""
    return F.greatest(F.lit(0), F.floor(seconds / 60 + 0.5).cast("int"))


def is_night(clock: Column, interval: int) -> Column:
    """Odd half-cycles are night; floor division keeps the parity right before the horn."""
    return F.pmod(F.floor(clock / interval), F.lit(2)) == 1


def phase_budget(minutes: Column, base: float, per_min: float) -> Column:
    return F.lit(float(base)) + F.lit(float(per_min)) * F.greatest(F.lit(0.0), minutes)


def rank_bracket(tier: Column) -> Column:
    b = F.floor(tier / 10).cast("int")
    return F.when(b.between(1, 8), b)
