"""Row selection per key: first row, top-k, exact newest-N, chunk numbers, sliced windows.

Every function here is written for hot keys: a single key may hold a third of all rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skirmish.session import stage


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key. ``order`` must be total for a repeatable result.

    ``row_number() = 1`` is planned with a group limit *before* the shuffle, so copies of a hot key
    are cut down inside each map task and at most one row per key and task is sent.
    """
    return top_per_key(df, keys, order, 1).drop("place_")


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, place: str = "place_") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(place, F.row_number().over(w)).where(F.col(place) <= k)


def newest_per_key(df: DataFrame, keys: Sequence[str], time: str, order: Sequence[str], k: int, slice_width: float) -> DataFrame:
    """The ``k`` newest rows of each key by (time, order), both descending; ``order`` makes rows of one time unique.

    Rows are counted per key and slice of time first, combined before the shuffle. Counts name the slice of each key in
    which its k-th row lies: newer slices are kept as they are, older ones dropped, and only that one slice is ranked.
    The result of two kept tables together is that of both inputs together, so batches can be merged.
    """
    keys = list(keys)
    sliced = df.withColumn("slice_", F.floor(F.col(time) / slice_width))
    sizes = sliced.groupBy(*keys, "slice_").agg(F.count("*").alias("n_"))
    down = Window.partitionBy(*keys).orderBy(F.col("slice_").desc())
    before = F.coalesce(F.sum("n_").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    wanted = sizes.withColumn("before_", before).where(F.col("before_") < k).withColumn("whole_", F.col("before_") + F.col("n_") <= k)
    keep = [F.col(f"r_.{x}").eqNullSafe(F.col(f"w_.{x}")) for x in keys] + [F.col("r_.slice_").eqNullSafe(F.col("w_.slice_"))]
    rows = sliced.alias("r_").join(wanted.select(*keys, "slice_", "before_", "whole_").alias("w_"), keep).select("r_.*", "before_", "whole_")
    cut = rows.where("not whole_")
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(time).desc(), *[F.col(c).desc() for c in order]))
    cut = cut.withColumn("place_", place).where(F.col("place_") <= k - F.col("before_")).drop("place_")
    return rows.where("whole_").unionByName(cut).drop("slice_", "before_", "whole_")


def last_distinct(df: DataFrame, keys: Sequence[str], item: Sequence[str], time: str, order: Sequence[str], k: int, slice_width: float) -> DataFrame:
    """(keys, item, time, order) of the ``k`` different items that each key had last, each with its last row."""
    place = F.max(F.struct(time, *order)).alias("l_")
    latest = df.groupBy(*keys, *item).agg(place).select(*keys, *item, "l_.*")
    return newest_per_key(latest, keys, time, order, k, slice_width)


def max_scalar(df: DataFrame, column: Column) -> Column:
    """``max(column)`` of the whole table as a scalar subquery (no global window)."""
    return df.agg(F.max(column).alias("m")).scalar()


# ---- exact newest-N without a global sort -------------------------------------------------

_DIGIT_BITS = 15
_DIGITS = 1 << _DIGIT_BITS


def kth_largest(df: DataFrame, columns: Sequence[str], k: int) -> tuple[int, ...] | None:
    """The k-th largest tuple of bigint ``columns``; None when there are fewer rows.

    A radix selection: each pass counts one 15-bit digit (at most 32,768 partial sums per task, no
    sort), keeps the digit that holds the k-th row and narrows to it. Values are taken with their sign bit turned, so
    that negative ones come before the others; digits that all rows share are not counted. Ties are counted, so the
    answer is exact whatever the skew.
    """
    chosen: list[int] = []
    rest = df
    remaining = k
    turned = 1 << 63
    for name in columns:
        low, top = rest.agg(F.min(name), F.max(name)).first()
        if top is None:
            return None
        low, top = int(low) + turned, int(top) + turned
        shift = max(0, ((low ^ top).bit_length() - 1) // _DIGIT_BITS * _DIGIT_BITS)
        value = top >> (shift + _DIGIT_BITS) << (shift + _DIGIT_BITS)
        key = F.col(name).cast("bigint").bitwiseXOR(F.lit(-turned).cast("bigint"))
        while shift >= 0:
            digit = F.shiftrightunsigned(key, shift).bitwiseAND(_DIGITS - 1)
            counts = rest.groupBy(digit.alias("d")).count().collect()  # <= 32,768 rows
            seen = 0
            pick = None
            for row in sorted(counts, key=lambda r: -r["d"]):
                if seen + row["count"] >= remaining:
                    pick = row["d"]
                    break
                seen += row["count"]
            if pick is None:
                return None
            remaining -= seen
            value |= pick << shift
            rest = rest.where(digit == pick)
            shift -= _DIGIT_BITS
        chosen.append(value - turned)
    return tuple(chosen)


def newest(df: DataFrame, columns: Sequence[str], k: int) -> DataFrame:
    """The k rows with the largest ``columns`` tuple (a unique key). Only a threshold reaches the driver."""
    if k <= 0:
        return df.where(F.lit(False))
    cut = kth_largest(df, columns, k)
    if cut is None:
        return df
    keep = F.lit(False)
    equal = F.lit(True)
    for name, value in zip(columns, cut):
        keep = keep | (equal & (F.col(name) > value))
        equal = equal & (F.col(name) == value)
    return df.where(keep | equal)


# ---- global position without a global window ----------------------------------------------


def with_position(df: DataFrame, columns: Sequence[str], name: str = "position") -> DataFrame:
    """0-based rank over the whole table in the order of ``columns`` (a unique key).

    Range partitions are sorted on their own; a partition's first rank is the row count of the
    partitions before it, a table with one row per partition.
    """
    ranged = df.repartitionByRange(*columns).sortWithinPartitions(*columns)
    marked = stage(ranged.withColumn("id_", F.monotonically_increasing_id()), "positions")
    part = F.shiftright("id_", 33)
    within = F.col("id_").bitwiseAND((1 << 33) - 1)
    sizes = marked.groupBy(part.alias("part_")).agg(F.count("*").alias("size_"))
    before = Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = sizes.select("part_", F.coalesce(F.sum("size_").over(before), F.lit(0)).alias("offset_"))
    return (
        marked.withColumn("part_", part)
        .join(offsets, "part_")
        .withColumn(name, F.col("offset_") + within)
        .drop("id_", "part_", "offset_")
    )


def with_chunk(df: DataFrame, columns: Sequence[str], size: int, name: str = "part") -> DataFrame:
    return with_position(df, columns, "position_").withColumn(name, F.expr(f"position_ div {int(size)}")).drop("position_")


def nearest_rank(df: DataFrame, column: str, shares: dict[str, float]) -> DataFrame:
    """Nearest-rank order statistics of distinct values: index int(n * share), at most n - 1."""
    ids = with_position(df.select(column).where(F.col(column).isNotNull()).distinct(), [column], "pos_")
    total = ids.agg(F.count("*").alias("c")).scalar()
    at = {k: F.least(F.floor(total * F.lit(float(q))), total - 1) for k, q in shares.items()}
    marked = ids.select(column, "pos_", *[at[k].alias(f"at_{k}") for k in shares])
    return marked.agg(*[F.max(F.when(F.col("pos_") == F.col(f"at_{k}"), F.col(column))).alias(k) for k in shares])


# ---- windows over one long key, cut into time slices ---------------------------------------


def _slice_table(df: DataFrame, keys: list[str], slice_col: str, aggregates: list[Column]) -> DataFrame:
    return df.groupBy(*keys, slice_col).agg(*aggregates)


def lag_sliced(
    df: DataFrame, keys: Sequence[str], time: str, order: Sequence[str], value: str, slice_width: float, name: str
) -> DataFrame:
    """``lag(value)`` over (keys order by order), for keys of any length.

    A key's rows are cut into slices of ``slice_width`` of ``time`` (the first order column must
    follow time). The window runs per (key, slice); the first row of a slice takes the last value
    of the key's previous non-empty slice from a table with one row per slice.
    """
    keys = list(keys)
    order = list(order)
    sliced = df.withColumn("slice_", F.floor(F.col(time) / slice_width))
    inside = Window.partitionBy(*keys, "slice_").orderBy(*order)
    rows = sliced.withColumn("lag_", F.lag(F.struct(F.col(value).alias("v"))).over(inside))
    last = _slice_table(sliced, keys, "slice_", [F.max_by(F.col(value), F.struct(*order)).alias("last_")])
    across = Window.partitionBy(*keys).orderBy("slice_")
    carry = last.select(*keys, "slice_", F.lag("last_").over(across).alias("carry_"))
    joined = rows.join(carry, [*keys, "slice_"])
    previous = F.when(F.col("lag_").isNotNull(), F.col("lag_.v")).otherwise(F.col("carry_"))
    return joined.withColumn(name, previous).drop("slice_", "lag_", "carry_")


def running_sum_sliced(
    df: DataFrame, keys: Sequence[str], time: str, order: Sequence[str], value: Column, slice_width: float, name: str
) -> DataFrame:
    """Running ``sum(value)`` over (keys order by order), for keys of any length (see lag_sliced)."""
    keys = list(keys)
    sliced = df.withColumn("slice_", F.floor(F.col(time) / slice_width)).withColumn("value_", value)
    inside = Window.partitionBy(*keys, "slice_").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = sliced.withColumn("run_", F.sum("value_").over(inside))
    totals = _slice_table(sliced, keys, "slice_", [F.sum("value_").alias("total_")])
    across = Window.partitionBy(*keys).orderBy("slice_").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(*keys, "slice_", F.coalesce(F.sum("total_").over(across), F.lit(0)).alias("carry_"))
    return (
        rows.join(carry, [*keys, "slice_"])
        .withColumn(name, F.coalesce(F.col("run_"), F.lit(0)) + F.col("carry_"))
        .drop("slice_", "value_", "run_", "carry_")
    )


def around_sliced(
    asked: DataFrame, points: DataFrame, keys: Sequence[str], time: str, order: Sequence[str], slice_width: float, strict: bool = False, exact: bool = False
) -> DataFrame:
    """For each row of ``asked`` the point of its key at or before its ``time`` and the one at or after: ``before_`` and
    ``after_``, structs of (time, order) or null. ``strict``: points at the very time are neither. ``exact``: places
    (time, order) are compared instead of times; ``asked`` then has the columns of ``order`` too.

    One sorted pass over both tables: a key is cut into slices of ``slice_width``, and what a slice doesn't hold comes
    from a table with a row a slice. Linear in the rows, whatever lies near whatever.
    """
    keys, order = list(keys), list(order)
    place = F.struct(time, *order)
    row = F.struct(*asked.columns)
    none_row, none_place = F.lit(None).cast(asked.select(row.alias("r")).dtypes[0][1]), F.lit(None).cast(points.select(place.alias("p")).dtypes[0][1])
    ask_cols = [*keys, F.col(time).cast("double").alias("time_"), *([F.col(c).alias(f"o_{c}") for c in order] if exact else [])]
    both = points.select(*ask_cols, none_row.alias("row_"), place.alias("point_"), F.lit(0).alias("ask_"))
    both = both.unionByName(asked.select(*ask_cols, row.alias("row_"), none_place.alias("point_"), F.lit(1).alias("ask_")))
    both = both.withColumn("slice_", F.floor(F.col("time_") / slice_width))
    line = ["time_", *([f"o_{c}" for c in order] if exact else [])]
    # a point at the very place counts for a row that comes after it in the order of the window
    up = Window.partitionBy(*keys, "slice_").orderBy(*[F.col(c).asc() for c in line], F.col("ask_").desc() if strict else F.col("ask_").asc())
    down = Window.partitionBy(*keys, "slice_").orderBy(*[F.col(c).desc() for c in line], F.col("ask_").desc() if strict else F.col("ask_").asc())
    own = both.withColumns({
        "low_": F.max("point_").over(up.rowsBetween(Window.unboundedPreceding, 0)),
        "high_": F.min("point_").over(down.rowsBetween(Window.unboundedPreceding, 0)),
    })
    ends = both.groupBy(*keys, "slice_").agg(F.min("point_").alias("first_"), F.max("point_").alias("last_"))
    earlier = Window.partitionBy(*keys).orderBy("slice_").rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy(*keys).orderBy(F.col("slice_").desc()).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*keys, "slice_", F.max("last_").over(earlier).alias("from_before_"), F.min("first_").over(later).alias("from_after_"))
    found = own.where("ask_ = 1").join(ends, [*keys, "slice_"])
    return found.select("row_.*", F.coalesce("low_", "from_before_").alias("before_"), F.coalesce("high_", "from_after_").alias("after_"))


def changes(
    df: DataFrame, keys: Sequence[str], time: str, order: Sequence[str], value: str, slice_width: float
) -> DataFrame:
    """Rows where ``value`` differs from the last non-null one of the key (the first counts as a change)."""
    known = df.where(F.col(value).isNotNull())
    lagged = lag_sliced(known, keys, time, order, value, slice_width, "before_")
    return lagged.where(F.col("before_").isNull() | (F.col("before_") != F.col(value))).drop("before_")


def newest_snapshot(df: DataFrame, key: str, by: str) -> DataFrame:
    """Latest row per key for update-style tables (run statistics, artifacts)."""
    return first_per_key(df, [key], [F.col(by).desc_nulls_last()])
