"""Work that follows from the size of the input and from what is asked for."""

from collections import Counter

from skirmish import session
from skirmish.plans.recommend import needed
from skirmish.session import size_shuffles
from workloads import serve
from workloads import tables as T


def test_partitions_follow_the_rows_and_go_back(spark):
    own = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert size_shuffles(spark, 100_000_000) == 200 == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert size_shuffles(spark, 1000) == own == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_only_levels_that_are_asked_for_are_counted():
    assert needed(T.CFG, ("hero",)).levels == ("L2", "hero")
    assert needed(T.CFG, ("item_hero", "ally")).levels == ("L3", "L2", "L1", "ally")


def test_pages_are_dealt_by_rows_and_mentions_counted_inside_them(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(session, "ROWS_A_PARTITION", 10)
    lines = [(i // 7, i % 7 + 1, i * i % 5) for i in range(98)]  # a page names some parts twice
    parts = [(k, f"part {k % 4}", f"Brand#{k % 2}") for k in range(5)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    named = [(page, item) for page, _, k in lines for item in (*parts[k][1:], "break", "zzz")]
    mentions, pages = Counter(item for _, item in named), Counter(item for _, item in set(named))
    try:
        assert serve.wiki_pages(spark, str(tmp_path)).rdd.getNumPartitions() == 10
        counted = serve.page_mentions(spark, str(tmp_path))
        assert {r.item: (r.mentions, r.pages) for r in counted.collect()} == {i: (mentions[i], pages[i]) for i in mentions}
        assert "keys=[item#" in (plan := counted._jdf.queryExecution().executedPlan().toString()) and ", page#" not in plan
    finally:
        size_shuffles(spark, 0)


def test_long_tables_are_merged_and_not_broadcast(spark, monkeypatch):
    """Packed keys look small as files; the hash table of millions of them is not."""
    d = "/root/testdata/sf0.001"
    ways = {name: lambda f=f: f(spark, d) for name, f in (("ranks", T.ranks), ("matches", T.matches))}
    left = {name: sorted(map(tuple, way().select("match_id").collect())) for name, way in ways.items()}
    monkeypatch.setattr(session, "BROADCAST_ROWS", 10)
    for name, way in ways.items():
        df = way()
        assert sorted(map(tuple, df.select("match_id").collect())) == left[name]
        assert df._jdf.queryExecution().optimizedPlan().toString().count("strategy=merge") == 1, name
    newest = T.matches(spark, d).agg({"start_time": "max"})
    assert "strategy=merge" in newest._jdf.queryExecution().optimizedPlan().toString()  # also where only keys of parts are read
