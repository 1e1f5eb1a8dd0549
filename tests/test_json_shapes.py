"""JSON of any shape: paths, keyed files, lists in lists."""

import json
import re

from pyspark.sql import functions as F

from skirmish.operators import profile
from skirmish.session import scratch_path
from skirmish.sources.keyed import read_keyed

RECORDS = [
    {"a": 1, "b": {"slot0": {"name": "x{[", "deep": [[1, [2, {"c": 'q"]'}]], []]}, "slot1": {}}},
    {"a": None, "list": [1, {"k9": [True]}, "s"], "empty": {}},
    [], {}, 5, "plain", {"a.b": {"c": 1.5}},
]


def paths(value, path=""):
    if isinstance(value, dict):
        for k, v in value.items():
            yield from paths(v, path + ("." if path else "") + re.sub(r"\d+", "#", k))
    elif isinstance(value, list):
        for v in value:
            yield from paths(v, path + "[]")
    else:
        yield path, value


def test_paths_of_any_depth(spark):
    rows = [(i, json.dumps(r)) for i, r in enumerate(RECORDS)] + [(99, "{broken"), (98, None)]
    got = profile.any_path_values(spark.createDataFrame(rows, "i int, j string"), "j", ["i"]).collect()
    want = [(i, p, None if v is None else {True: "true"}.get(v) if v is True else str(v)) for i, r in enumerate(RECORDS) for p, v in paths(r)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_depth_ignores_brackets_in_strings(spark):
    rows = [(json.dumps(r),) for r in ('{[{"', {"a": [1, {"}": "\\\"["}]}, 3)]
    assert [r[0] for r in spark.createDataFrame(rows, "j string").select(profile.json_depth(F.col("j"))).collect()] == [0, 3, 0]


def test_keyed_files(spark):
    path = scratch_path(spark, "keyed")
    text = json.dumps({"one": {"id": 1, "parts": ["a"], "x": 9}, "two": {"id": "no number"}, "version": 3, "empty": {}}, indent=2)
    spark.createDataFrame([(text,), ("[1]",), ("broken",)], "value string").repartition(3).write.text(path)
    got = {r.key: (r.id, r.parts) for r in read_keyed(spark, path, "id bigint; parts array<string>").collect()}
    assert got == {"one": (1, ["a"]), "two": (None, None), "empty": (None, None)}
