"""Match analytics on Spark: DataFrame in, DataFrame out.

``sources``    readers and writers (match JSON, Parquet facts, snapshots, slices, logs)
``functions``  column expressions (statistics, game clock, text)
``operators``  one relational building block each (counts, lift, shrinkage, ranking, as-of, ...)
``plans``      whole jobs composed of operators (recommendations, retention, incremental, ...)
``streaming``  Structured Streaming jobs for telemetry packets
"""

__version__ = "0.1.0"
