"""Run registered queries on Spark and their SQL twins on DuckDB and compare the rows.

    python checks/compare.py [sf_dir] [name-substring ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import duckdb  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def canon(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v + 0.0:.9g}" if v != 0 else "0"
    if isinstance(v, int):
        return f"{float(v):.9g}" if abs(v) < 2**53 and v != 0 else str(v)
    return str(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(canon(r[i]) for i in order) for r in rows)


KIND = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "smallint": "SMALLINT", "tinyint": "TINYINT"}


def compare(spark, con, name, fn, sql, sf_dir) -> str | None:
    """None when equal, else what differs."""
    df = fn(spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    want = rows_of(names, cur.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} vs {sorted(names)}"
    types = {c[0]: str(c[1]) for c in cur.description}
    odd = [f"{f.name}: {f.dataType.simpleString()} vs {types[f.name]}" for f in df.schema if KIND.get(f.dataType.simpleString()) != types[f.name]]
    if got != want:
        in_got, in_want = set(got), set(want)
        extra, miss = [r for r in got if r not in in_want], [r for r in want if r not in in_got]
        return f"rows {len(got)} vs {len(want)}; only spark {len(extra)} {extra[:2]}; only sql {len(miss)} {miss[:2]}"
    if not got:
        return "EMPTY on both sides"
    return "types " + "; ".join(odd) if odd else None


def main() -> int:
    from skirmish.session import local_session
    from workloads import load

    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    queries, sql = load()
    spark = local_session()
    spark.sparkContext.setLogLevel("OFF")
    con = duck(sf_dir)
    bad = 0
    for name in queries:
        if args and not any(a in name for a in args):
            continue
        t = time.time()
        try:
            if name in sql:
                note = compare(spark, con, name, queries[name], sql[name], sf_dir)
            else:
                n = len(queries[name](spark, sf_dir).collect())
                note = None if n else "EMPTY"
                name += f" (rows only: {n})"
        except Exception as e:  # noqa: BLE001 - report and go on
            note = f"{type(e).__name__} {str(e)[:600]}"
        bad += note is not None
        print(f"{'ok  ' if note is None else 'FAIL'} {time.time() - t:6.1f}s {name} {note or ''}", flush=True)
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main())
