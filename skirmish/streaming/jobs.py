"""Starting and draining streaming jobs; union of manual triggers; ingest sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skirmish.session import scratch_path
from skirmish.sources.matches import player_rows
from skirmish.schemas import RAW_MATCH


def ingest(spark: SparkSession, source: str, sink: str, checkpoint: str, patches: DataFrame, every: str = "15 minutes", **kwargs):
    """Match JSON files to Parquet parts. The checkpoint moves on only after a part is durable."""
    matches = spark.readStream.schema(RAW_MATCH).option("mode", "DROPMALFORMED").json(source)
    rows = player_rows(matches, patches, **kwargs)
    return (
        rows.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint)
        .option("compression", "zstd").trigger(processingTime=every).start()
    )


def drain(stream: DataFrame, label: str, mode: str = "append") -> DataFrame:
    """Run a stream over everything available now and read back what it wrote."""
    spark = stream.sparkSession
    base = scratch_path(spark, label)
    schema = stream.schema
    query = (
        stream.writeStream.format("parquet").outputMode(mode).option("path", f"{base}/out")
        .option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(schema).parquet(f"{base}/out")


def with_manual(triggers: DataFrame, manual: DataFrame) -> DataFrame:
    """Triggers pressed by hand join the stream of detected ones."""
    return triggers.unionByName(manual.withColumn("manual", F.lit(True)), allowMissingColumns=True)
