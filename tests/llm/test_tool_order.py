"""Calls that use several results: places against the longest way by brute force, odd input, the written record."""

import json
import random

from skirmish.llm import tool_calls

CALLS = "call_id string, after array<string>, name string, arguments string"


def longest_ways(after):
    """Longest way from a call without known source; None in or after a cycle."""
    known = {c: {s for s in sources or [] if s in after} for c, sources in after.items()}
    at = {}
    while True:
        ready = [c for c in known if c not in at and known[c] <= at.keys()]
        if not ready:
            return {c: at.get(c) for c in known}
        for c in ready:
            at[c] = max((at[s] + 1 for s in known[c]), default=0)


def test_places_are_longest_ways(spark):
    rng = random.Random(6)
    after = {}
    for graph in range(25):
        n = rng.randint(1, 14)
        for i in range(n):
            back = rng.random() < 0.1  # may close a cycle
            pool = [f"{graph}.{j}" for j in (range(n) if back else range(i))] + [None, "unknown"]
            after[f"{graph}.{i}"] = None if rng.random() < 0.1 else [rng.choice(pool) for _ in range(rng.choice([0, 1, 1, 1, 2, 3]))]
    after |= {f"chain.{i}": [f"chain.{i - 1}"] for i in range(1, 60)} | {"chain.0": [], "loop": ["loop"], "past": ["loop", "chain.3"]}
    after["ends"] = ["chain.59", "chain.20", "0.0"]
    calls = spark.createDataFrame([(c, s, "ask", "{}") for c, s in after.items()], CALLS)
    got = {r.call_id: r.depth for r in tool_calls.layers(calls.select("call_id", "after")).collect()}
    assert got == longest_ways(after)
    assert got["ends"] == 60 and got["loop"] is None and got["past"] is None


def test_records_of_calls_with_several_sources(spark):
    rows = [("a", None, "ask", '{"words": 1, "chars": 2}'), ("b", [], "ask", "{}"), ("c", ["b", None, "a", "b"], "none", None), ("c", ["b", None, "a", "b"], "none", None), (None, ["a"], "ask", "{}")]
    results = spark.createDataFrame([("a", "r"), ("c", None)], "call_id string, content string")
    got = {r.call_id: r for r in tool_calls.link_calls(spark.createDataFrame(rows, CALLS), results).collect()}
    assert {c: r.place for c, r in got.items()} == {"a": 0, "b": 0, "c": 1}
    assert got["c"].n_calls == 2 and json.loads(got["c"].canonical)["after"] == ["a", "b"]
    assert tool_calls.link_calls(spark.createDataFrame([], CALLS), results).count() == 0
