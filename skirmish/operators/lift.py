"""Adaptation lift A and difference-in-differences effect B from contingency sums."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skirmish.config import EPS
from skirmish.functions.stats import add, binom_var, capped_rate
from skirmish.operators.counts import STRATA, gy, tot, total_n


def _prefixed(margin: DataFrame, prefix: str, keys: list[str]) -> DataFrame:
    return margin.select(*keys, *[F.col(f"{m}{s}").alias(f"{prefix}_{m}{s}") for s in STRATA for m in ("n", "w")])


def cells(counts: DataFrame, levels: Sequence[str], min_buy_share: float = 0.0, min_ctx: dict[str, float] | None = None) -> DataFrame:
    """One wide row per (level, bucket, role, hero, ctx, y) that occurred, with all margins per stratum.

    All levels go through one job. Only the pair table is large; the three margins it joins are
    smaller by a factor of the item or context count, so the planner broadcasts them when their
    measured size allows it.
    """
    who = ["bucket", "role", "hero"]
    t = _prefixed(tot(counts), "t", who).withColumn("t_n", total_n("t_n"))
    y = _prefixed(gy(counts), "y", [*who, "y"]).withColumn("y_n", total_n("y_n"))
    y = y.join(t, who).where(F.col("y_n") >= F.lit(float(min_buy_share)) * F.col("t_n"))
    wanted = counts.where(F.col("level").isin(*levels))
    x = _prefixed(wanted.where(F.col("y").isNull()), "x", ["level", *who, "ctx"]).withColumn("x_n", total_n("x_n"))
    for level, floor in (min_ctx or {}).items():
        x = x.where((F.col("level") != level) | (F.col("x_n") >= float(floor)))
    pairs = _prefixed(wanted.where(F.col("y").isNotNull()), "p", ["level", *who, "ctx", "y"])
    return pairs.join(x, ["level", *who, "ctx"]).join(y, [*who, "y"])


def _snap(value: Column) -> Column:
    """Residues of subtracting fractional sums count as zero."""
    return F.when(value > EPS, value).otherwise(F.lit(0.0))


def _floor0(value: Column) -> Column:
    return F.greatest(value, F.lit(0.0))


def _stratum(s: int) -> dict[str, Column]:
    c = {k: (F.col(f"{k}_n{s}"), F.col(f"{k}_w{s}")) for k in ("t", "x", "y", "p")}
    (n, w), (nx, wx), (ny, wy), (np_, wp) = c["t"], c["x"], c["y"], c["p"]
    return {
        f"n11_{s}": _snap(np_), f"n10_{s}": _snap(nx - np_), f"n01_{s}": _snap(ny - np_), f"n00_{s}": _snap(n - nx - ny + np_),
        f"w11_{s}": _floor0(wp), f"w10_{s}": _floor0(wx - wp), f"w01_{s}": _floor0(wy - wp), f"w00_{s}": _floor0(w - wx - wy + wp),
    }


def _estimates(s: int) -> dict[str, Column]:
    n = {k: F.col(f"n{k}_{s}") for k in ("11", "10", "01", "00")}
    w = {k: F.col(f"w{k}_{s}") for k in ("11", "10", "01", "00")}
    nx = F.col(f"x_n{s}")
    with_x, without_x = n["11"] + n["10"], n["01"] + n["00"]
    both = (nx > 0) & (with_x > 0) & (without_x > 0)
    pa, pb = n["11"] / with_x, n["01"] / without_x
    full = (n["11"] > 0) & (n["10"] > 0) & (n["01"] > 0) & (n["00"] > 0)
    r = {k: capped_rate(w[k], n[k]) for k in n}
    return {
        f"a_{s}": F.when(both, pa - pb),
        f"va_{s}": F.when(both, binom_var(pa, nx) + binom_var(pb, without_x)),
        f"b_{s}": F.when(full, (r["11"] - r["10"]) - (r["01"] - r["00"])),
        f"vb_{s}": F.when(full, add([binom_var(r[k], n[k]) for k in ("11", "10", "01", "00")])),
    }


def _stratified(metric: str) -> tuple[Column, Column]:
    """Mean over strata weighted by the context's games, and its variance; null without any stratum."""
    zero = F.lit(0.0)
    nx = [F.col(f"x_n{s}") for s in STRATA]
    known = [F.col(f"{metric}_{s}").isNotNull() for s in STRATA]
    weight = add([F.when(k, n).otherwise(zero) for k, n in zip(known, nx)])
    mean = add([F.when(k, n * F.col(f"{metric}_{s}")).otherwise(zero) for s, (k, n) in enumerate(zip(known, nx))])
    var = add([F.when(k, n * n * F.col(f"v{metric}_{s}")).otherwise(zero) for s, (k, n) in enumerate(zip(known, nx))])
    return F.when(weight > 0, mean / weight), F.when(weight > 0, var / (weight * weight))


def metrics(cell_rows: DataFrame) -> DataFrame:
    """(level, bucket, role, hero, ctx, y; lift_a, var_a, diff_b, var_b, games)."""
    parts: dict[str, Column] = {}
    for s in STRATA:
        parts |= _stratum(s)
    out = cell_rows.withColumns(parts)
    estimates: dict[str, Column] = {}
    for s in STRATA:
        estimates |= _estimates(s)
    out = out.withColumns(estimates)
    a, va = _stratified("a")
    b, vb = _stratified("b")
    return out.select(
        "level", "bucket", "role", "hero", "ctx", "y",
        a.alias("lift_a"), va.alias("var_a"), b.alias("diff_b"), vb.alias("var_b"), F.col("x_n").alias("games"),
    )


def metrics_of_levels(
    counts: DataFrame, levels: Sequence[str], min_buy_share: float = 0.0, min_ctx: dict[str, float] | None = None
) -> DataFrame:
    return metrics(cells(counts, levels, min_buy_share, min_ctx))


def level_metrics(counts: DataFrame, level: str, min_buy_share: float = 0.0, min_ctx: float = 0.0) -> DataFrame:
    return metrics_of_levels(counts, (level,), min_buy_share, {level: min_ctx}).drop("level")
