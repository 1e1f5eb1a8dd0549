"""Dimension files that hold one JSON object keyed by name, read as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_keyed(spark: SparkSession, path: str, fields: str, whole: bool = True, key: str = "key") -> DataFrame:
    """(key, fields..., raw): one row for each entry of each object.

    ``whole``: a file is one object (else a line is). ``fields`` is a schema; an entry lacks what it doesn't hold or what
    doesn't fit. ``raw`` is the entry as a variant, for parts of changing shape. Entries that are no objects are dropped.
    """
    text = spark.read.text(path, wholetext=whole).select(F.try_parse_json("value").alias("all_"))
    entries = text.lateralJoin(spark.tvf.variant_explode(F.col("all_").outer()).toDF("pos_", key, "raw"))
    entries = entries.where(F.schema_of_variant("raw").startswith("OBJECT"))
    names = [part.strip().split()[0] for part in fields.split(";")]
    types = [part.strip().split(maxsplit=1)[1] for part in fields.split(";")]
    return entries.select(key, *[F.try_variant_get("raw", f"$.{n}", t).alias(n) for n, t in zip(names, types)], "raw")
