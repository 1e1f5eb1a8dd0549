"""Slices per hero: what is written is read back, also where no answer passes at all."""

import shutil
from pathlib import Path

import duckdb
import pytest

from checks.compare import duck
from skirmish.schemas import ANSWER, SLICE
from skirmish.session import scratch_path, small_table
from skirmish.sources import slices
from workloads import load

SOURCE = "/root/testdata/sf0.001"
SOURCES = ["exp", "r1"]
COLUMNS = ["bucket", "role", "hero", "ctx", "place", "y", "score", "a_pp", "b_pp", "conf", "games", "source"]


def coded(spark, rows):
    answers = small_table(spark, rows, ANSWER.replace("games double, rule", "games bigint, source"))
    return slices.encode(answers, SOURCES)


@pytest.mark.parametrize("one_table", [True, False])
def test_written_rows_are_read_back(spark, one_table):
    hero = [("normal", "core", h, "2", k, 100 + k, 1.5, 2.0, -0.1, c, 70, s) for h in ("1", "007") for k, c, s in ((1, "high", "r1"), (2, "low", "exp"))]
    item = [] if one_table else [("turbo", "core", "1", "12", 1, 5, 0.5, 1.0, 0.0, "mid", 30, "exp")]
    path = scratch_path(spark, "slices")
    slices.write_slices({"hero": coded(spark, hero), "item": coded(spark, item)}, path)
    got = slices.decode(slices.read_all(spark, path), SOURCES).select("table", *COLUMNS).collect()
    assert sorted(map(tuple, got)) == sorted([("hero", *r) for r in hero] + [("item", *r) for r in item])
    assert {r["hero"] for r in slices.read_slice(spark, path, "007").collect()} == {"007"}
    assert slices.read_slice(spark, path, "7").count() == 0


def test_no_rows_leave_an_empty_table(spark):
    path = scratch_path(spark, "slices")
    slices.write_slices({"hero": coded(spark, []), "item": coded(spark, [])}, path)
    assert slices.read_all(spark, path).schema == small_table(spark, [], SLICE).schema
    assert slices.decode(slices.read_all(spark, path), SOURCES).count() == slices.read_slice(spark, path, "1").count() == 0


def test_no_answer_at_all(spark, tmp_path):
    """Nobody meets an enemy, so no answer passes: the query is as empty as its SQL, with the same columns."""
    for file in Path(SOURCE).glob("*.parquet"):
        shutil.copy(file, tmp_path / file.name)
    duckdb.execute(f"COPY (SELECT * FROM '{SOURCE}/lineitem.parquet' WHERE l_linenumber % 2 = 1) TO '{tmp_path}/lineitem.parquet' (FORMAT parquet)")
    queries, sql = load()
    want = duck(str(tmp_path)).execute(sql["hero_slices"])
    got = queries["hero_slices"](spark, str(tmp_path))
    assert got.collect() == want.fetchall() == []
    assert sorted(got.columns) == sorted(c[0] for c in want.description)
