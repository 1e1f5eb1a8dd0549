"""Bind every SQL twin in DuckDB without running it (a quick syntax check)."""

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from checks.compare import duck  # noqa: E402
from workloads import load  # noqa: E402

con = duck(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001")
bad = 0
for name, sql in load()[1].items():
    try:
        con.execute("EXPLAIN " + sql)
    except Exception as e:  # noqa: BLE001
        bad += 1
        print("FAIL", name, str(e)[:400])
print("bad:", bad)
