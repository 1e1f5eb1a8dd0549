"""A sample of registered queries against their SQL twins at the smallest scale."""

import pytest

from checks.compare import compare, duck
from workloads import load

DIR = "/root/testdata/sf0.001"
SAMPLE = [
    "games_first_rows", "games_prepared", "context_enemy_item", "count_enemy_hero_owned", "lift_enemy_item", "team_pairs",
    "patch_in_force", "nearest_event", "scheduled_alerts", "stream_scheduled_alerts", "merge_groups", "voice_rate_limit",
    "steady_advice", "value_changes", "segments_by_marker", "purchase_medians", "page_counter_items", "evidence_words",
    "props_field_profile", "id_percentiles", "newest_matches",
]


@pytest.fixture(scope="module")
def con():
    return duck(DIR)


@pytest.mark.parametrize("name", SAMPLE)
def test_twin(spark, con, name):
    queries, sql = load()
    assert compare(spark, con, name, queries[name], sql[name], DIR) is None


def test_every_sql_binds(con):
    for sql in load()[1].values():
        con.execute("EXPLAIN " + sql)
