"""Results that hang on ties, on roundings and on lines that are alike: the query against its SQL twin on made-up tables."""

import shutil
from pathlib import Path

import duckdb
import pytest

from checks.compare import compare, duck
from skirmish.config import ThreatConfig
from skirmish.operators import threats
from skirmish.session import small_table
from workloads import load

SOURCE = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    """sf0.001 with events of one second and with order lines that differ in the part alone."""
    to = tmp_path_factory.mktemp("ties")
    for file in Path(SOURCE).glob("*.parquet"):
        shutil.copy(file, to / file.name)
    con = duckdb.connect()
    con.execute(f"""COPY (SELECT * FROM '{SOURCE}/events.parquet' UNION ALL
        SELECT 5000 + i, TIMESTAMP '2024-01-03 00:00:40' + to_milliseconds(i), i // 4, 'click', 1.0, '{{"k": ' || (CASE i % 4 WHEN 0 THEN 3 ELSE 60 END) || '}}'
        FROM range(160) r(i)) TO '{to}/events.parquet' (FORMAT parquet)""")
    con.execute(f"""COPY (SELECT * FROM '{SOURCE}/lineitem.parquet' UNION ALL
        SELECT * REPLACE ((l_partkey + 7) % 199 AS l_partkey) FROM '{SOURCE}/lineitem.parquet' WHERE l_orderkey % 3 = 0 AND l_linenumber = 2) TO '{to}/lineitem.parquet' (FORMAT parquet)""")
    return str(to)


@pytest.mark.parametrize("name", ["mode_detection", "retention_window", "retention_chunks", "retention_ranks", "retention_quality"])
def test_ties_and_lines_alike(spark, tables, name):
    queries, sql = load()
    assert compare(spark, duck(tables), name, queries[name], sql[name], tables) is None


def test_score_is_rounded_once(spark):
    """A win rate of 54.496 gives 2.248: 2.25 to two places, 2.2 to one (not 2.3)."""
    ask = small_table(spark, [(1, "normal", 2, 3)], "request int, bucket string, my_hero int, enemy int")
    cube = small_table(
        spark, [("hero", "normal", 3, "0", "", 100_000, 54_496), ("pair", "normal", 9, "9", "", 1, 1)],
        "table string, bucket string, hero int, ctx string, item string, games long, wins long",
    )
    farm = small_table(spark, [("normal", 9, 1, 1)], "bucket string, hero int, games long, places long")
    assert threats.cube_threats(ask, cube, farm, ThreatConfig(), digits=1).first()["score"] == 2.2
    assert threats.cube_threats(ask, cube, farm, ThreatConfig()).first()["score"] == 2.25
