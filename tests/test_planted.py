"""Synthetic matches with known effects: the method must find them and not be fooled by game length."""

import random

import pytest
from pyspark.sql import functions as F

from skirmish.config import Config
from skirmish.operators.dims import build_item_model
from skirmish.plans import incremental, recommend
from skirmish.session import small_table

BKB, HALBERD, VESSEL, SKADI = 116, 114, 267, 160
CFG = Config(conf_high=300, conf_mid=100, eb_min_games=50, exclude_tree_of=None, extra_candidates=(), levels=("L3", "L2", "hero"), counter_min_a_pp=None, veto_b=100.0)


def planted(n=6000, seed=7):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        long_game = rng.random() < 0.5
        facing = rng.random() < (0.7 if long_game else 0.2)
        mine = []
        if rng.random() < (0.7 if long_game else 0.2):
            mine.append(BKB)
        if rng.random() < (0.6 if facing else 0.2):
            mine.append(VESSEL)
        skadi = rng.random() < 0.3
        if skadi:
            mine.append(SKADI)
        win = rng.random() < 0.5 + (0.15 if skadi and facing else 0.0)
        for side, heroes in ((True, (1, 2, 3, 4, 5)), (False, (10, 11, 12, 13, 14))):
            for k, hero in enumerate(heroes):
                items = mine if hero == 1 else [HALBERD] if hero == 10 and facing else []
                rows.append((i, 1_700_000_000 + i, 3000 if long_game else 1200, 22, win, "7.41", side, hero, items, 30000 if hero == 1 else 10000 - k))
    return rows


SCHEMA = "match_id bigint, start_time int, duration int, game_mode int, radiant_win boolean, patch string, is_radiant boolean, hero_id int, items array<int>, net_worth int"


@pytest.fixture(scope="module")
def model(spark):
    items = small_table(spark, [(i, f"k{i}", 2500, True, "rare", 0) for i in (BKB, HALBERD, VESSEL, SKADI)],
                        "id int, key string, cost int, created boolean, qual string, tier int")
    none = "item int, component int"
    return build_item_model(
        items, small_table(spark, [], none), small_table(spark, [(HALBERD, "heal")], "id int, mech string"),
        small_table(spark, [(VESSEL, "cut")], "id int, tag string"),
        small_table(spark, [(h, "str") for h in (1, 2, 3, 4, 5, 10, 11, 12, 13, 14)], "hero int, attr string"),
        small_table(spark, [], "hero int, mech string"), small_table(spark, [("heal", "heal", "cut")], "rule string, enemy string, answer string"), CFG)


@pytest.fixture(scope="module")
def matches(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("planted") / "m")
    rows = planted()
    small_table(spark, rows + rows[:1000], SCHEMA).write.parquet(path)  # the first matches twice
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def recs(matches, model):
    return recommend.recommendations(matches, model, CFG, tables=("item", "hero"))


def test_copies_are_counted_once(recs):
    assert recs["facts"].first()["matches"] == 6000


def test_effects_are_found(recs):
    got = {r["y"]: (r["a_s"] * 100, r["b_s"] * 100) for r in recs["item"].where(f"hero = '1' and ctx = '{HALBERD}'").collect()}
    assert got[VESSEL][0] > 25 and abs(got[VESSEL][1]) < 8
    assert abs(got.get(BKB, (0, 0))[0]) < 8
    assert got[SKADI][1] > 3


def test_rule_is_named(recs):
    rows = recs["item"].where(f"hero = '1' and ctx = '{HALBERD}' and y = {VESSEL}").collect()
    assert [r["rule"] for r in rows] == ["heal"]


def test_incremental_equals_scratch(spark, matches, model, recs, tmp_path):
    parts = {"a": F.col("match_id") < 2200, "b": F.col("match_id").between(2000, 4000), "c": F.col("match_id") > 3900}

    def read(names):
        cond = F.lit(False)
        for n in names:
            cond = cond | parts[n]
        return matches.where(cond)

    state = str(tmp_path / "state")
    manifest = incremental.update(spark, read, dict.fromkeys(parts, 1), state, model, CFG, files_per_batch=1)
    assert manifest["info"]["matches"] == 6000
    again = incremental.update(spark, read, dict.fromkeys(parts, 1), state, model, CFG)
    assert again["info"] == manifest["info"]
    key = ["bucket", "role", "hero", "ctx", "y"]
    a = {tuple(r[k] for k in key): r["a_s"] for r in recs["item"].collect()}
    b = {tuple(r[k] for k in key): r["a_s"] for r in incremental.recommendations_from_state(spark, state, model, CFG, ("item",))["item"].collect()}
    assert a.keys() == b.keys()
    assert all(abs(a[k] - b[k]) < 1e-9 for k in a)
