"""Row selection and sliced windows against plain Python."""

import random

from pyspark.sql import functions as F

from skirmish.operators import asof, rows
from skirmish.session import small_table
from skirmish.streaming import sessions


def _events(spark, n=400):
    rng = random.Random(3)
    data = [("hot" if rng.random() < 0.6 else f"u{i % 7}", rng.randrange(5000), i, rng.randrange(4)) for i in range(n)]
    return data, small_table(spark, data, "k string, t bigint, i bigint, v int")


def _by_key(data):
    out = {}
    for r in sorted(data, key=lambda r: (r[0], r[1], r[2])):
        out.setdefault(r[0], []).append(r)
    return out


def test_newest_is_exact(spark):
    rng = random.Random(1)
    data = [(rng.choice([5, 2**33 + 7, 2**33 + 8]), i) for i in range(500)]
    df = small_table(spark, data, "s bigint, id bigint")
    for k in (0, 1, 7, 250, 499, 500, 900):
        got = {(r["s"], r["id"]) for r in rows.newest(df, ["s", "id"], k).collect()}
        assert got == set(sorted(data, reverse=True)[:k])


def test_positions(spark):
    data = random.Random(2).sample(range(10**6), 300)
    got = {r["x"]: r["position"] for r in rows.with_position(small_table(spark, [(x,) for x in data], "x bigint"), ["x"]).collect()}
    assert got == {x: i for i, x in enumerate(sorted(data))}


def test_sliced_lag_and_sum(spark):
    data, df = _events(spark)
    lag = {r["i"]: r["b"] for r in rows.lag_sliced(df, ["k"], "t", ["t", "i"], "v", 300, "b").collect()}
    run = {r["i"]: r["b"] for r in rows.running_sum_sliced(df, ["k"], "t", ["t", "i"], F.col("v"), 300, "b").collect()}
    for group in _by_key(data).values():
        total, before = 0, None
        for r in group:
            total += r[3]
            assert lag[r[2]] == before and run[r[2]] == total
            before = r[3]


def test_anchored_groups_and_rate_limit(spark):
    data, df = _events(spark)
    heads = {r["i"]: r["head"] for r in sessions.anchored_groups(df, ["k"], "t", ["t", "i"], 40).collect()}
    spoken = {r["i"]: r["spoken"] for r in sessions.rate_limited(df, ["k"], "t", ["t", "i"], "v", 90, 3).collect()}
    for group in _by_key(data).values():
        head = last = None
        for _, t, i, v in group:
            head = t if head is None or t - head >= 40 else head
            ok = v >= 3 or last is None or t - last >= 90
            last = t if ok else last
            assert heads[i] == head and spoken[i] == ok


def test_calendar(spark):
    names = small_table(spark, [("7.40", 100, 0), ("7.41", 200, 1)], "name string, since bigint, ord int")
    t = small_table(spark, [(50,), (100,), (199,), (200,)], "t bigint")
    got = {r["t"]: r["p"] for r in asof.effective_name(t, "t", names, "p").collect()}
    assert got == {50: "7.40", 100: "7.40", 199: "7.40", 200: "7.41"}


def test_first_rune_alerts(spark):
    specs = small_table(spark, [("rune", "periodic", 360, 120, None, [], None, [], [10], [30, 10])],
                        "event_id string, kind string, first int, interval int, until int, times array<int>, trigger string, delays array<int>, warn array<int>, first_warn array<int>")
    fires = sorted(r["fire_time"] for r in asof.alert_table(specs, 480).collect())
    assert fires[:3] == [330, 350, 470]


def test_newest_orders_negative_values(spark):
    data = random.Random(4).sample(range(-10**12, 10**12), 200) + [-(2**63), 2**63 - 1, 0, -1]
    df = small_table(spark, [(x,) for x in data], "x bigint")
    for k in (1, 3, 100, 203):
        assert {r["x"] for r in rows.newest(df, ["x"], k).collect()} == set(sorted(data)[-k:])


def test_newest_per_key_and_merged_batches(spark):
    rng = random.Random(9)
    data = [(rng.choice(["a", "a", "a", "b", None]), rng.randrange(-50, 300), i) for i in range(400)]
    table = lambda part: small_table(spark, part, "k string, t int, i int")
    want = {r for k in ("a", "b", None) for r in sorted((x for x in data if x[0] == k), key=lambda x: x[1:])[-30:]}
    for width in (1.0, 40.0, 1e6):
        got = rows.newest_per_key(table(data), ["k"], "t", ["i"], 30, width)
        assert {tuple(r) for r in got.collect()} == want
    halves = [rows.newest_per_key(table(data[s]), ["k"], "t", ["i"], 30, 40.0) for s in (slice(0, 150), slice(150, 400))]
    assert {tuple(r) for r in rows.newest_per_key(halves[0].unionByName(halves[1]), ["k"], "t", ["i"], 30, 40.0).collect()} == want
    last = rows.last_distinct(table(data).withColumn("x", F.col("i") % 7), ["k"], ["x"], "t", ["i"], 3, 40.0)
    for key in ("a", "b", None):
        latest = {}
        for k, t, i in data:
            if k == key:
                latest[i % 7] = max(latest.get(i % 7, (t, i)), (t, i))
        assert {r.x for r in last.collect() if r.k == key} == {x for x, _ in sorted(latest.items(), key=lambda e: e[1])[-3:]}
