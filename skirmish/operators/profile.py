"""Profile of JSON records (paths, counts, samples) and of recorded packets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from skirmish.operators.rows import top_per_key

MAX_SAMPLES, MAX_SAMPLE_LEN = 8, 60


def path_values(df: DataFrame, column: str, schema: str, keep: list[str]) -> DataFrame:
    """(keep..., path, value) of every leaf of JSON text, for a known schema of structs and arrays.

    Digits in names become ``#``; array steps are ``[]``. Built from the schema, so it stays inside
    generated code; use ``any_path_values`` when the shape of the records is unknown.
    """
    parsed = df.select(*keep, F.from_json(column, schema).alias("j_"))
    leaves = _leaves(F.col("j_"), parsed.schema["j_"].dataType, "")
    pairs = F.filter(F.flatten(F.array(*leaves)), lambda p: p["value"].isNotNull())
    return parsed.select(*keep, F.inline(pairs))


def _leaves(col: Column, dtype: DataType, prefix: str) -> list[Column]:
    """One array<struct<path, value>> per leaf of the schema."""
    import re

    if dtype.typeName() == "struct":
        out = []
        for f in dtype.fields:
            name = re.sub(r"\d+", "#", f.name)
            out += _leaves(col[f.name], f.dataType, f"{prefix}.{name}" if prefix else name)
        return out
    if dtype.typeName() == "array" and dtype.elementType.typeName() not in ("struct", "array"):
        return [F.coalesce(F.transform(col, lambda v: F.struct(F.lit(prefix + "[]").alias("path"), v.cast("string").alias("value"))), F.array().cast("array<struct<path:string,value:string>>"))]
    return [F.array(F.struct(F.lit(prefix).alias("path"), col.cast("string").alias("value")))]


def json_depth(text: Column) -> Column:
    """Levels of objects and lists in JSON text: its brackets outside of strings, folded."""
    brackets = F.regexp_replace(F.regexp_replace(text, r'"(\\.|[^"\\])*"', ""), r"[^\[\]{}]", "")
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def count(at: Column, sign: Column) -> Column:
        now = at["now"] + F.when(sign.isin("[", "{"), 1).when(sign.isin("]", "}"), -1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(at["most"], now).alias("most"))

    return F.aggregate(F.split(brackets, ""), start, count)["most"]


def opened(df: DataFrame, column: str, which: str, depth: int, step: Column | None = None, path: str = "path") -> DataFrame:
    """Containers of the variant ``column`` opened ``depth`` times in one chain: values that are no containers stay rows as
    they are, so the table is read and parsed once. ``which``: pattern of the kinds to open. Empty containers leave no row.
    """
    names = [c for c in df.columns if c not in (column, path)]
    for _ in range(depth):
        kind = F.schema_of_variant(column)
        marked = df.withColumns({"box_": F.when(kind.rlike(which), F.col(column)), "is_list_": kind.startswith("ARRAY")})
        inner = marked.sparkSession.tvf.variant_explode_outer(F.col("box_").outer()).toDF("pos_", "key_", "item_")
        out = marked.lateralJoin(inner).where(F.col("box_").isNull() | F.col("pos_").isNotNull())
        onward = F.concat(F.col(path), F.when(F.col("is_list_"), "[]").otherwise(step)) if step is not None else F.col(path)
        df = out.select(
            *names, F.when(F.col("box_").isNotNull(), F.col("item_")).otherwise(F.col(column)).alias(column),
            F.when(F.col("box_").isNotNull(), onward).otherwise(F.col(path)).alias(path),
        )
    return df


def any_path_values(df: DataFrame, column: str, keep: list[str], depth: int | None = None) -> DataFrame:
    """The same for records of unknown shape, as variants. Broken records are dropped.

    The deepest record is found by one aggregate (or given as ``depth``); the walk itself is a single plan of that many
    steps over records parsed once, not a job a level.
    """
    if depth is None:
        depth = df.agg(F.coalesce(F.max(json_depth(F.col(column))), F.lit(0))).first()[0]
    step = F.concat(F.when(F.col("path") == "", "").otherwise("."), F.regexp_replace("key_", r"\d+", "#"))
    rows = df.select(*keep, F.try_parse_json(column).alias("v"), F.lit("").alias("path")).where(F.col("v").isNotNull())
    leaves = opened(rows, "v", "^(OBJECT|ARRAY)", depth, step)
    return leaves.select(*keep, "path", F.variant_get("v", "$", "string").alias("value"))


def list_items(df: DataFrame, column: str, keep: list[str], depth: int) -> DataFrame:
    """(keep..., item): the elements of a variant list, lists inside lists opened down to ``depth``; a single value is its
    own element."""
    rows = df.select(*keep, F.col(column).alias("item"), F.lit("").alias("path")).where(F.col("item").isNotNull())
    return opened(rows, "item", "^ARRAY", depth).drop("path")


def field_profile(values: DataFrame, order: str) -> DataFrame:
    """(path, count, samples): up to eight distinct values per path, in order of first appearance.

    Values are counted before they are ranked, so a hot path costs one row per distinct value.
    """
    short = values.withColumn("sample", F.substring("value", 1, MAX_SAMPLE_LEN))
    per = short.groupBy("path", "sample").agg(F.count("*").alias("k"), F.min(order).alias("first"))
    counts = per.groupBy("path").agg(F.sum("k").alias("count"))
    tops = top_per_key(per, ["path"], [F.col("first"), F.col("sample")], MAX_SAMPLES)
    samples = tops.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("place_", "sample"))).alias("s"))
    return counts.join(samples, "path").select("path", "count", F.transform("s", lambda x: x["sample"]).alias("samples"))


def match_spans(packets: DataFrame, match: str, clock: str, order: str) -> DataFrame:
    """(match, packets, first_clock, last_clock)."""
    return packets.where(F.col(match).isNotNull()).groupBy(match).agg(
        F.count("*").alias("packets"), F.min_by(clock, order).alias("first_clock"), F.max_by(clock, order).alias("last_clock")
    )


def block_counts(packets: DataFrame, blocks: str) -> DataFrame:
    return packets.select(F.explode(blocks).alias("block")).groupBy("block").agg(F.count("*").alias("packets"))


def distinct_in_order(events: DataFrame, text: str, order: str) -> DataFrame:
    return events.groupBy(text).agg(F.min(order).alias("first"))
