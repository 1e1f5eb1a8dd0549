"""Session helpers: shared scratch folder, stage tables, small dimension tables."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

# A dimension is taken to the driver (and so becomes broadcastable) only up to this many rows.
SMALL_DIM_ROWS = 50_000


def local_session(name: str = "skirmish", cores: str = "8", partitions: int = 8, memory: str = "16g") -> SparkSession:
    """A session for tests and local benches; on a cluster the caller brings their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``; a temporary one only for local masters."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="spark-skirmish-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


ROWS_A_PARTITION = 500_000
_SHUFFLES, _OWN = "spark.sql.shuffle.partitions", "spark.skirmish.own.shuffle.partitions"


def size_shuffles(spark: SparkSession, rows: int) -> int:
    """Shuffle partitions for a job over ``rows`` rows: the session's own number, more where a task would get too many rows.

    So a task's sorts and tables stay as they are while the input grows; adaptive execution puts small partitions together.
    """
    own = int(spark.conf.get(_OWN, None) or spark.conf.get(_SHUFFLES))
    spark.conf.set(_OWN, str(own))
    wanted = max(own, -(-rows // ROWS_A_PARTITION))
    spark.conf.set(_SHUFFLES, str(wanted))
    return wanted


# A table that is joined is left to the planner, and so may be broadcast, up to this many rows.
BROADCAST_ROWS = 2_000_000


def join_side(df: DataFrame, rows: int) -> DataFrame:
    """A table of ``rows`` rows to join with, merged where a hash table of it would be too much for the driver.

    The planner goes by the size of files, in which packed keys can take less than a byte a row.
    """
    return df if rows <= BROADCAST_ROWS else df.hint("merge")


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/skirmish/{uuid.uuid4().hex}/{label}"


def stage(df: DataFrame, label: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Used where several consumers need the same wide result: it cuts the lineage, survives lost
    executors and gives the planner true sizes, so it broadcasts only what really is small.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    schema = df.schema
    df.write.option("compression", "zstd").partitionBy(*partition_by).parquet(path)
    return spark.read.schema(schema).parquet(path)


def small_table(spark: SparkSession, rows: list, schema: str | StructType) -> DataFrame:
    """A driver-side table as a LocalRelation, whose exact size the planner knows."""
    if isinstance(schema, str):
        schema = StructType.fromDDL(schema)
    names = schema.fieldNames()
    columns = list(zip(*rows)) if rows else [[] for _ in names]
    arrow_schema = to_arrow_schema(schema)
    table = pa.table([pa.array(list(c), type=f.type) for c, f in zip(columns, arrow_schema)], schema=arrow_schema)
    return spark.createDataFrame(table, schema=schema)


def pull_small(df: DataFrame, limit: int = SMALL_DIM_ROWS) -> list | None:
    """Rows of a dimension, or None when it has more than ``limit`` of them."""
    rows = df.limit(limit + 1).collect()
    return rows if len(rows) <= limit else None


def settle_dim(df: DataFrame, limit: int = SMALL_DIM_ROWS) -> DataFrame:
    """Evaluate a dimension once: a LocalRelation when it is small, a stage table when it is not."""
    rows = pull_small(df, limit)
    if rows is None:
        return stage(df, "dim")
    return small_table(df.sparkSession, [tuple(r) for r in rows], df.schema)


def settle_dims(tables: dict[str, DataFrame], limit: int = SMALL_DIM_ROWS) -> dict[str, DataFrame]:
    """settle_dim for several tables in one job."""
    packed = None
    for name, df in tables.items():
        rows = df.select(F.lit(name).alias("name"), F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("row"))
        packed = rows if packed is None else packed.unionByName(rows)
    rows = pull_small(packed, limit)
    if rows is None:
        return {name: settle_dim(df, limit) for name, df in tables.items()}
    out = {}
    for name, df in tables.items():
        fields = df.columns
        parsed = [json.loads(r["row"]) for r in rows if r["name"] == name]
        out[name] = small_table(df.sparkSession, [tuple(p.get(f) for f in fields) for p in parsed], df.schema)
    return out
