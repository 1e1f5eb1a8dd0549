"""Tool-call linking: calls meet their results by identifier, are ordered topologically, checked and serialised.

``after`` names the call whose result a call uses, or is an array of several. With one each, the calls form trees and
the topological order is the depth. Depths come from pointer doubling: a chain of n calls takes log2(n) joins, each over
calls spread by identifier, so that neither a long chain nor a conversation with most of the rows sits in one task.
With several, the place is the longest way from a call that waits for nothing. Chains are still doubled away; what is
left are calls with two or more sources, placed in as many rounds as such calls are nested.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skirmish.session import stage

SCHEMAS = {"ask": {"chars": "bigint", "words": "bigint"}, "configure": {"chars": "bigint", "words": "bigint"}}


def depths(calls: DataFrame) -> DataFrame:
    """``call_id, depth`` of unique calls ``call_id, after``: 0 for one that follows nothing known, null in a cycle."""
    known = calls.select(F.col("call_id").alias("after"))
    linked = calls.where("after is not null").join(known, "after").select("call_id", "after")
    now = calls.join(linked.select("call_id", F.col("after").alias("up")), "call_id", "left").select("call_id", "up", F.when(F.col("up").isNull(), 0).otherwise(1).cast("long").alias("depth"))
    now = stage(now, "depths")
    n = max(1, now.count())
    for _ in range(n.bit_length() + 1):
        open_ = now.where("up is not null")
        if not open_.head(1):
            break
        above = now.select(F.col("call_id").alias("up"), F.col("up").alias("top"), F.col("depth").alias("more"))
        moved = open_.join(above, "up").select("call_id", F.col("top").alias("up"), (F.col("depth") + F.col("more")).alias("depth"))
        now = stage(now.where("up is null").unionByName(moved), "depths")
    return now.select("call_id", F.when(F.col("up").isNull(), F.col("depth")).alias("depth"))


def layers(calls: DataFrame) -> DataFrame:
    """``call_id, depth`` of unique calls ``call_id, after`` (an array): the longest way from a call that follows nothing known.

    Repeated, null and unknown sources count as not there. A call in a cycle, or after one, has a null depth.
    """
    pairs = calls.select("call_id", F.explode("after").alias("source")).distinct()
    pairs = stage(pairs.join(calls.select(F.col("call_id").alias("source")), "source"), "sources")
    sources = pairs.groupBy("call_id").agg(F.count("*").alias("n"), F.min("source").alias("one"))
    # a call with one source points at it; others are the tops that chains hang from
    up = F.when(F.col("n") == 1, F.col("one"))
    now = calls.join(sources, "call_id", "left").select("call_id", up.alias("up"), F.when(up.isNull(), F.col("call_id")).alias("top"), F.when(up.isNull(), 0).otherwise(1).cast("long").alias("more"), (F.coalesce("n", F.lit(0)) > 1).alias("joins"))
    now = stage(now, "tops")
    for _ in range(max(1, now.count()).bit_length() + 1):
        open_ = now.where("up is not null")
        if not open_.head(1):
            break
        above = now.select(F.col("call_id").alias("up"), F.col("up").alias("next"), F.col("top").alias("found"), F.col("more").alias("further"))
        moved = open_.join(above, "up").select("call_id", F.col("next").alias("up"), F.col("found").alias("top"), (F.col("more") + F.col("further")).alias("more"), "joins")
        now = stage(now.where("up is null").unionByName(moved), "tops")
    hung = now.where("top is not null").select(F.col("call_id").alias("source"), "top", F.col("more") + 1)
    waits = pairs.join(now.where("joins").select("call_id"), "call_id").join(hung.toDF("source", "top", "more"), "source", "left")
    waits = stage(waits.groupBy("call_id", "top").agg(F.max("more").alias("more")).withColumn("depth", F.lit(None).cast("long")), "waits")
    placed = fresh = now.where("not joins and top = call_id").select(F.col("call_id").alias("top"), F.lit(0).cast("long").alias("at"))
    while True:
        met = waits.join(fresh, "top", "left").select("call_id", "top", "more", F.coalesce("depth", F.col("at") + F.col("more")).alias("depth"))
        met = stage(met, "waits")
        ready = met.groupBy("call_id").agg(F.max("depth").alias("at"), F.count(F.when(F.col("depth").isNull(), 1)).alias("open")).where("open = 0")
        fresh = stage(ready.select(F.col("call_id").alias("top"), "at"), "placed")
        if not fresh.head(1):
            break
        placed = placed.unionByName(fresh)
        waits = met.join(fresh.select(F.col("top").alias("call_id")), "call_id", "left_anti")
    tops = now.join(placed, "top", "left")
    return tops.select("call_id", (F.col("at") + F.col("more")).alias("depth"))


def valid(name: Column, arguments: Column, schemas: dict[str, dict[str, str]]) -> Column:
    """True where the arguments are a JSON object that has each field of the tool's schema in its type and no other."""
    out = F.lit(False)
    for tool, fields in schemas.items():
        ddl = ", ".join(f"`{f}` {t}" for f, t in fields.items())
        parsed = F.from_json(arguments, ddl)
        whole = F.lit(True)
        for f in fields:
            whole = whole & parsed[f].isNotNull()
        same = F.array_sort(F.json_object_keys(arguments)) == F.lit(sorted(fields))
        out = F.when(name == tool, F.coalesce(whole & same, F.lit(False))).otherwise(out)
    return out


class Literal(str):
    """A JSON number as it is written."""


class Members(list):
    """The pairs of a JSON object, repeated keys included."""


def refuse(constant: str):
    raise ValueError(constant)  # NaN and Infinity are no JSON


def written(value) -> str:
    if isinstance(value, Literal):
        return str(value)
    if isinstance(value, Members):
        return "{" + ",".join(f"{written(k)}:{written(v)}" for k, v in sorted(value, key=lambda pair: pair[0])) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(written, value)) + "]"
    if isinstance(value, str):
        plain = json.dumps(value, ensure_ascii=False)
        return json.dumps(value) if any("\ud800" <= c <= "\udfff" for c in plain) else plain
    return json.dumps(value)


def canonical(text: str) -> str:
    """JSON text with the keys of every level in order and every value in its type; other text becomes a JSON string."""
    try:
        return written(json.loads(text, parse_int=Literal, parse_float=Literal, parse_constant=refuse, object_pairs_hook=Members))
    except (ValueError, RecursionError):
        return written(text)


def link_calls(calls: DataFrame, results: DataFrame, schemas: dict[str, dict[str, str]] | None = None) -> DataFrame:
    """``call_id, name, place, has_result, is_valid, n_calls, n_results, json, canonical`` for each identifier of ``calls``.

    ``calls``: ``call_id, after, name, arguments``, with a string or an array of strings as ``after`` (an array is written
    without nulls and repeats, in order); ``results``: ``call_id, content``. Rows without identifier are left out. Of rows with the same identifier the least (name, arguments, after) or content counts, their numbers are
    returned. A result without call has no row; a call in a cycle, or after one, has a null place. ``json`` has its keys in order and
    every argument as a string; ``canonical`` is the same record with the arguments in their types and the keys of every
    level in order (see ``canonical``).
    """
    several = calls.schema["after"].dataType.typeName() == "array"
    if several:
        calls = calls.withColumn("after", F.array_sort(F.array_distinct(F.array_compact("after"))))
    first = calls.where("call_id is not null").groupBy("call_id").agg(F.min(F.struct("name", "arguments", "after")).alias("c"), F.count("*").alias("n_calls"))
    one = stage(first.select("call_id", "c.name", "c.arguments", "c.after", "n_calls"), "calls")
    answers = results.where("call_id is not null").groupBy("call_id").agg(F.min("content").alias("content"), F.count("*").alias("n_results"))
    linked = one.join((layers if several else depths)(one.select("call_id", "after")).withColumnRenamed("depth", "place"), "call_id").join(answers, "call_id", "left")
    keys = F.array_sort(F.array_distinct(F.json_object_keys("arguments")))  # a repeated key would fail the map
    ordered = F.map_from_entries(F.transform(keys, lambda k: F.struct(k, F.element_at(F.from_json("arguments", "map<string, string>"), k))))
    record = F.struct("after", ordered.alias("arguments"), F.col("call_id").alias("id"), "name", F.col("place").alias("place"), F.col("content").alias("result"))

    @F.pandas_udf("string")
    def in_order(texts: pd.Series) -> pd.Series:
        return texts.map(canonical, na_action="ignore")

    def inner(*fields: Column) -> Column:
        text = F.to_json(F.struct(*fields))
        return F.nullif(F.substring(text, F.lit(2), F.length(text) - 2), F.lit(""))

    rest = inner(F.col("call_id").alias("id"), F.col("name"), F.col("place"), F.col("content").alias("result"))
    typed = F.concat(F.lit("{"), F.concat_ws(",", inner(F.col("after")), F.concat(F.lit('"arguments":'), in_order("arguments")), rest), F.lit("}"))
    return linked.select(
        "call_id", "name", "place", F.col("n_results").isNotNull().alias("has_result"), valid(F.col("name"), F.col("arguments"), schemas or SCHEMAS).alias("is_valid"),
        "n_calls", F.coalesce("n_results", F.lit(0)).cast("long").alias("n_results"), F.to_json(record).alias("json"), typed.alias("canonical"),
    )


def calls_of(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The query's calls and results: a user or system turn calls a tool, the assistant's next turn is the result."""
    id_ = lambda turn: F.concat_ws("-", F.col("conv_id").cast("string"), turn.cast("string"))
    key, text = F.col("conv_id").isNotNull() & F.col("turn").isNotNull(), F.col("text")
    words = F.size(F.split(F.trim(text), r"\s+")).cast("long")
    arguments = F.to_json(F.struct(words.alias("words"), F.length(text).cast("long").alias("chars")))
    calls = turns.where(key & F.col("role").isin("user", "system")).select(
        id_(F.col("turn")).alias("call_id"), F.when(F.col("turn") >= 2, id_(F.col("turn") - 2)).alias("after"), F.when(F.col("role") == "user", "ask").otherwise("configure").alias("name"), F.when(text.isNull(), "{}").otherwise(arguments).alias("arguments")
    )
    return calls, turns.where(key & (F.col("role") == "assistant")).select(id_(F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))
