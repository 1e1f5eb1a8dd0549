"""Ordered decisions on one long key, whole and in pieces, against a plain loop."""

import random

import pytest

from skirmish.operators import asof
from skirmish.operators.rows import around_sliced
from skirmish.streaming import sessions


def alerts(n, seed, span):
    rng = random.Random(seed)
    return sorted((rng.choice([0, 1]), rng.randrange(span), i, rng.choice([0, 0, 1, 3])) for i in range(n))


@pytest.mark.parametrize("piece", [512, 8])
@pytest.mark.parametrize("closed", [False, True])
def test_heads(spark, monkeypatch, piece, closed):
    monkeypatch.setattr(sessions, "PIECE_ROWS", piece)
    rows = alerts(200, 3, 600)
    want, head = {}, {}
    for k, t, i, _ in rows:
        far = k not in head or (t - head[k] > 9 if closed else t - head[k] >= 9)
        head[k] = t if far else head[k]
        want[i] = head[k]
    df = spark.createDataFrame(rows, "k int, t int, i int, v int")
    got = {r.i: r.head for r in sessions.anchored_groups(df, ["k"], "t", ["t", "i"], 9, closed).collect()}
    assert got == want


@pytest.mark.parametrize("piece", [512, 8])
def test_voices(spark, monkeypatch, piece):
    monkeypatch.setattr(sessions, "PIECE_ROWS", piece)
    rows = alerts(200, 4, 900)
    want, last = {}, {}
    for k, t, i, v in rows:
        want[i] = v >= 3 or k not in last or t - last[k] >= 20
        last[k] = t if want[i] else last.get(k)
    df = spark.createDataFrame(rows, "k int, t int, i int, v int")
    assert {r.i: r.spoken for r in sessions.rate_limited(df, ["k"], "t", ["t", "i"], "v", 20, 3).collect()} == want


@pytest.mark.parametrize("width", [10.0, 100.0, 1e6])
def test_steady_choice(spark, width):
    rng = random.Random(5)
    rows, want, state = [], {}, {}
    for i, t in enumerate(sorted(rng.randrange(700) for _ in range(300))):
        k, new, score = rng.choice("ab"), rng.choice([1, 2, 3, None]), rng.choice([1.0, 1.5, 2.0, None])
        offered = {c: rng.choice([1.0, 1.4, 2.0]) for c in rng.sample([1, 2, 3, 4], rng.randint(0, 3))} if rng.random() < 0.9 else None
        mark = rng.choice(["x", "x", "x", "y", None])
        rows.append((k, t, i, new, score, offered, mark))
        out, held = new, state.get(k)
        if held is not None and new is not None and new != held[0] and held[1] == mark:
            old = (offered or {}).get(held[0])
            if old is not None and score is not None and score < old + 0.5:
                out = held[0]
        if out is not None:
            state[k] = (out, mark)
        want[i] = out
    df = spark.createDataFrame(rows, "k string, t int, i int, new int, score double, offered map<int, double>, mark string")
    got = sessions.steady_choice(df, ["k"], ["t", "i"], "new", "score", "offered", "mark", 0.5, width)
    assert {r.i: r.kept for r in got.collect()} == want
    assert len(set(want.values())) > 3


@pytest.mark.parametrize("strict", [False, True])
def test_around(spark, strict):
    rng = random.Random(6)
    asked = [(k, rng.randrange(200), i) for i, k in enumerate(rng.choices("abc", k=60))]
    points = [(rng.choice("ab"), rng.randrange(200), i) for i in range(40)]
    got = around_sliced(spark.createDataFrame(asked, "k string, t int, q int"), spark.createDataFrame(points, "k string, t int, p int"), ["k"], "t", ["p"], 13.0, strict)
    for r in got.collect():
        below = [(t, p) for k, t, p in points if k == r.k and (t < r.t if strict else t <= r.t)]
        above = [(t, p) for k, t, p in points if k == r.k and (t > r.t if strict else t >= r.t)]
        assert (tuple(r.before_) if r.before_ else None) == max(below, default=None)
        assert (tuple(r.after_) if r.after_ else None) == min(above, default=None)


@pytest.mark.parametrize("tolerance", [5, 100_000])
def test_nearest_point(spark, tolerance):
    rng = random.Random(8)
    targets = [(i, rng.randrange(20_000)) for i in range(80)]
    points = [(i, rng.choice([rng.randrange(20_000), 77])) for i in range(60)]
    got = asof.nearest_point(spark.createDataFrame(targets, "a int, t int"), spark.createDataFrame(points, "b int, u int"), "a", "t", "b", "u", tolerance)
    for r in got.collect():
        near = min(((abs(u - r.t), u, b) for b, u in points if abs(u - r.t) <= tolerance), default=(None, None, None))
        assert (r.gap, r.u, r.b) == near
