"""Column expressions for rates, bounds and scores (all inside whole-stage codegen)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_width(v: Column, z: float) -> Column:
    """z standard errors of an estimate with variance ``v`` (missing or negative variance counts as 0)."""
    return F.lit(float(z)) * F.sqrt(F.greatest(F.coalesce(v, F.lit(0.0)), F.lit(0.0)))


def lower(a: Column, v: Column, z: float) -> Column:
    return a - half_width(v, z)


def upper(a: Column, v: Column, z: float) -> Column:
    return a + half_width(v, z)


def rate(num: Column, den: Column) -> Column:
    """``num / den``, null where the denominator is not positive."""
    return F.when(den > 0, num / den)


def capped_rate(num: Column, den: Column) -> Column:
    return F.when(den > 0, F.least(F.lit(1.0), num / den))


def binom_var(p: Column, n: Column) -> Column:
    return p * (F.lit(1.0) - p) / n


def add(columns) -> Column:
    return reduce(lambda a, b: a + b, columns)


def share_uplift(with_item: Column, games: Column, base_share: Column, z: float) -> tuple[Column, Column]:
    """(gain of the buy share in pp, its lower bound); the variance uses the larger of the two shares."""
    share = with_item / games
    p = F.greatest(share, base_share, F.lit(0.01))
    delta = (share - base_share) * 100
    return delta, delta - F.lit(float(z)) * F.sqrt(p * (1 - p) / games) * 100


def winrate_harmful(n: Column, w: Column, base_n: Column, base_w: Column, z: float, min_games: int) -> Column:
    """True where an item lowers the win rate beyond doubt; false on small samples."""
    p, pb = F.try_divide(w, n), F.try_divide(base_w, base_n)
    se = F.sqrt(F.try_divide(p * (1 - p), n) + F.try_divide(pb * (1 - pb), base_n))
    harmful = (n >= min_games) & (base_n > 0) & ((p - pb) + F.lit(float(z)) * se < 0)
    return F.coalesce(harmful, F.lit(False))


def round_places(x: Column, digits: int) -> Column:
    """``x`` scaled, rounded half away from zero and scaled back, as SQL engines round doubles (``F.round`` takes the shortest decimal)."""
    scale = F.lit(10.0**digits)
    return F.round(x * scale) / scale


def percent(num: Column, den: Column) -> Column:
    return F.when(den > 0, num * 100.0 / den)


def expected_place(core: Column, offlane: Column, support: Column) -> Column:
    """Mean net-worth place implied by role shares (core 1.5, offlane 3, support 4.5)."""
    return 1.5 * core + 3.0 * offlane + 4.5 * support
