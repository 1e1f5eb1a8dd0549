"""Queries of the library on the driver tables (see __spark_entry__.py) and their SQL twins."""


def load():
    """(queries, sql) of all workload modules."""
    from workloads import core, desk, flow, logs, recorded, serve  # noqa: F401
    from workloads.registry import QUERIES, SQL

    return dict(QUERIES), dict(SQL)
