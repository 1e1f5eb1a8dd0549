"""Keys share state by shard: the results are those of each key alone, and the store holds a row a shard, not a key."""

from pyspark.sql import functions as F

from skirmish.session import scratch_path
from skirmish.streaming import stateful


def rounds(spark, parts):
    """Runs a stream batch by batch; (rows, state rows after each batch)."""
    source, base = scratch_path(spark, "rows"), scratch_path(spark, "sums")
    schema = "match string, at long, ts timestamp"

    def step(memo, row):
        memo["n"] = memo.get("n", 0) + 1
        return [("row", int(row.at), memo["n"])]

    kept = []
    for part in parts:
        rows = spark.createDataFrame([(m, t) for m, t in part], "match string, at long").withColumn("ts", F.timestamp_seconds("at"))
        rows.coalesce(1).write.mode("append").parquet(source)
        out = stateful.keyed(
            spark.readStream.schema(schema).parquet(source), ["match"], ["at"], step, "match string, kind string, at long, n long",
            finish=lambda memo: [("end", 0, memo["n"])], shards=3,
        )
        q = out.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
        q.awaitTermination()
        kept.append(q.lastProgress["stateOperators"][0]["numRowsTotal"])
    return {tuple(r) for r in spark.read.schema("match string, kind string, at long, n long").parquet(f"{base}/out").collect()}, kept


def test_keys_of_a_shard_are_counted_and_dropped_one_by_one(spark):
    first = [(f"m{i}", 1000 + i) for i in range(40)]
    late = [("m1", 9000), ("m2", 9000)]  # these two live on when the others are over
    end = [("end", 13_000)]
    got, kept = rounds(spark, [first, late, end])
    assert max(kept) <= 3
    assert {g for g in got if g[1] == "row"} == {(m, "row", t, 1) for m, t in first + end} | {(m, "row", t, 2) for m, t in late}
    assert {g for g in got if g[1] == "end"} == {(f"m{i}", "end", 0, 1) for i in range(40) if i not in (1, 2)}
