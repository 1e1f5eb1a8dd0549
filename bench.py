"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from skirmish.session import local_session  # noqa: E402
from workloads import load  # noqa: E402

HEADLINE = [
    "games_prepared", "count_enemy_hero_owned", "answers_enemy_hero", "ingest_match_json", "retention_window",
    "newest_matches", "patch_in_force", "nearest_event", "scheduled_alerts", "merge_groups", "value_changes",
    "stream_event_dedupe", "purchase_medians", "count_cube", "evidence_words", "props_field_profile",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("bench", cpus, int(cpus))
    spark.sparkContext.setLogLevel("ERROR")
    registered, _ = load()
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()  # start the JVM before the clock
    only = os.environ.get("BENCH_ONLY", "").split(",") if os.environ.get("BENCH_ONLY") else HEADLINE
    times = {}
    for name in only:
        if name not in registered:
            continue
        started = time.perf_counter()
        registered[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - started, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": times, "sf": Path(sf_dir).name.removeprefix("sf")}))


if __name__ == "__main__":
    main()
