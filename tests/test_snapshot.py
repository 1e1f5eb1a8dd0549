"""Published generations, their files, and the ids that a state has seen."""

import random

from pyspark.sql import functions as F

from skirmish.plans.incremental import id_bits, unseen
from skirmish.session import scratch_path, small_table
from skirmish.sources import snapshot


def test_unfinished_generations_are_never_seen(spark):
    root = scratch_path(spark, "root")
    assert snapshot.newest(spark, root) is None and snapshot.resolve(spark, root) is None
    one = small_table(spark, [(1,)], "x long")
    first = snapshot.publish(spark, root, {"t": one}, {"n": 1})
    snapshot.write_tables({"t": one}, root)
    assert snapshot.newest(spark, root) == (first, {"n": 1, "generation": 1})
    second = snapshot.publish(spark, root, {"t": one.unionByName(one)}, {"n": 2})
    assert snapshot.resolve(spark, root) == second and spark.read.parquet(f"{second}/t").count() == 2


def test_files_are_verified(spark):
    root = scratch_path(spark, "files")
    spark.range(100).repartition(3).write.parquet(root)
    found = snapshot.digests(spark, root)
    names = sorted(r["name"] for r in found.collect())
    assert snapshot.verify(found, found).count() == 0
    assert {(r["name"], r["size"]) for r in snapshot.file_sizes(spark, root).collect()} == {(r["name"], r["size"]) for r in found.collect()}
    other = found.withColumns({
        "size": F.when(F.col("name") == names[0], F.col("size") + 1).otherwise(F.col("size")),
        "sha256": F.when(F.col("name") == names[1], "0").otherwise(F.col("sha256")),
        "name": F.when(F.col("name") == names[2], "gone").otherwise(F.col("name")),
    })
    got = {(r["name"], r["problem"]) for r in snapshot.verify(found, other).collect()}
    assert got == {(names[0], "size"), (names[1], "hash"), (names[2], "extra"), ("gone", "missing")}
    shots = small_table(spark, [("a", 1), ("b", 3), ("c", 2)], "path string, generated_at long")
    bad = small_table(spark, [("b", "hash")], "path string, problem string")
    assert snapshot.newest_valid(shots, bad).first()["path"] == "c"


def test_seen_ids(spark):
    rng = random.Random(1)
    pool = [rng.randrange(10**11) for _ in range(200)] + list(range(32_760, 32_780)) + [-5, -40_000, 0]
    first, second = set(rng.sample(pool, 150)), rng.sample(pool, 150) * 2
    table = lambda ids: small_table(spark, [(i,) for i in ids], "match_id long")
    bits = id_bits(table(sorted(first)))
    assert {r[0] for r in unseen(table(second), bits).collect()} == set(second) - first
    assert {r[0] for r in unseen(table(second), None).collect()} == set(second)
