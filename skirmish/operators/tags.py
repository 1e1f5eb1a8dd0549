"""Mechanic tags from descriptions by include / exclude patterns, attributes, behaviour, roles and cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _any(text: Column, patterns: list[str]) -> Column:
    hit = F.lit(False)
    for p in patterns:
        hit = hit | text.rlike(p)
    return hit


def text_hit(text: Column, spec: dict) -> Column:
    """True when some include pattern and no exclude pattern occurs in a lower-cased description."""
    return _any(text, spec.get("desc", [])) & ~_any(text, spec.get("exclude", []))


def tag_descriptions(descriptions: DataFrame, specs: dict[str, dict], owner: str, text: str, extra: DataFrame | None = None) -> DataFrame:
    """(owner, tag): tags whose patterns hit at least ``min_count`` descriptions of the owner.

    The patterns are constants of the plan, so tagging is one scan without any join; hits are
    summed per owner with map-side combination. ``extra`` adds (owner, tag) pairs from attributes,
    behaviours or official roles. ``max_cost`` and ``active_only`` read columns cost and is_active.
    """
    low = F.lower(F.coalesce(text, F.lit("")))
    hits = []
    for tag, spec in specs.items():
        hit = text_hit(low, spec)
        if spec.get("active_only"):
            hit = hit & F.col("is_active")
        if spec.get("max_cost") is not None:
            hit = hit & (F.col("cost") > 0) & (F.col("cost") <= spec["max_cost"])
        hits.append(F.count_if(hit).alias(tag))
    sums = descriptions.groupBy(owner).agg(*hits)
    found = F.array_compact(F.array(*[F.when(F.col(t) >= s.get("min_count", 1), t) for t, s in specs.items()]))
    out = sums.select(owner, F.explode(found).alias("tag"))
    return out if extra is None else out.unionByName(extra.select(owner, "tag")).distinct()


def attribute_tags(attributes: DataFrame, specs: dict[str, dict], owner: str, key: str) -> DataFrame:
    """(owner, tag) from attribute keys."""
    out = F.array_compact(F.array(*[F.when(F.col(key).isin(*s["attrib"]), t) for t, s in specs.items() if s.get("attrib")]))
    return attributes.select(owner, F.explode(out).alias("tag")).distinct()


def behaviour_tags(abilities: DataFrame, specs: dict[str, dict], owner: str, behaviours: str) -> DataFrame:
    """(owner, tag) for owners with at least ``min_count`` abilities of a behaviour."""
    counted = [(t, s) for t, s in specs.items() if s.get("behavior")]
    sums = abilities.groupBy(owner).agg(*[F.count_if(F.array_contains(behaviours, s["behavior"])).alias(t) for t, s in counted])
    found = F.array_compact(F.array(*[F.when(F.col(t) >= s.get("min_count", 1), t) for t, s in counted]))
    return sums.select(owner, F.explode(found).alias("tag"))


def role_tags(roles: DataFrame, mapping: dict[str, str], owner: str, role: str) -> DataFrame:
    out = F.lit(None).cast("string")
    for name, tag in mapping.items():
        out = F.when(F.col(role) == name, tag).otherwise(out)
    return roles.select(owner, out.alias("tag")).where(F.col("tag").isNotNull()).distinct()


def best_key_per_name(items: DataFrame, name: str, key: str) -> DataFrame:
    """One key per display name: without a numeric tail, then the shortest, then by alphabet; and how many."""
    tail = F.col(key).rlike(r"_\d+$")
    return items.groupBy(name).agg(
        F.min_by(key, F.struct(tail.alias("t"), F.length(key).alias("l"), F.col(key).alias("k"))).alias(key), F.count("*").alias("keys")
    )
