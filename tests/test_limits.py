"""Results at and beyond borders that used to cut something off."""

from skirmish.operators.dims import component_closure
from skirmish.operators.rows import newest
from skirmish.streaming.sessions import anchored_groups


def test_closure_of_a_long_chain_diamonds_and_a_cycle(spark):
    chain = [(i, i + 1) for i in range(15)]
    got = component_closure(spark.createDataFrame(chain, "item int, component int"))
    assert {tuple(r) for r in got.collect()} == {(i, j) for i in range(16) for j in range(i + 1, 16)}
    layers = [(2 * k + a, 2 * k + 2 + b) for k in range(8) for a in (0, 1) for b in (0, 1)]
    assert component_closure(spark.createDataFrame(layers, "item int, component int")).count() == 4 * 36
    assert component_closure(spark.createDataFrame([(1, 2), (2, 1)], "item int, component int")).count() == 4
    assert component_closure(spark.createDataFrame(chain, "item int, component int"), depth=2).count() == 15 + 14


def test_an_alert_at_the_end_of_the_window_joins_the_group(spark):
    rows = spark.createDataFrame([(1, 0), (1, 5), (1, 6), (1, 11), (1, 12)], "k int, t int")
    got = {(r.t, r.head) for r in anchored_groups(rows, ["k"], "t", ["t"], 5, closed=True).collect()}
    assert got == {(0, 0), (5, 0), (6, 6), (11, 6), (12, 12)}


def test_newest_takes_negative_values_in_order(spark):
    got = newest(spark.createDataFrame([(-5,), (-1,), (3,)], "a long"), ["a"], 2)
    assert {r.a for r in got.collect()} == {-1, 3}
