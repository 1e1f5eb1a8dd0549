"""Log replay against a plain loop over the lines, and lines that are no log lines."""

import random

from skirmish.operators import replay


def plain(lines, threats, parents):
    """Totals by (desk, segment), line by line."""
    out, segment, said = {}, {}, set()
    for desk, at, ms, text in sorted(lines):
        segment.setdefault(desk, 0)
        if text == "Start" or text.startswith("New match"):
            segment[desk] += 1
        if " new items: " not in text:
            continue
        hero, items = text.split(" new items: ")
        row = out.setdefault((desk, segment[desk]), [0] * 5)
        for item in sorted(items.split(", ")):
            target = item if item in threats else parents.get((hero, item)) if parents.get((hero, item)) in threats else None
            key = (desk, segment[desk], hero, target)
            hinted = target is not None and key not in said
            said.add(key)
            row[0] += 1
            row[1] += hinted
            row[2] += hinted and not threats[target]
            row[3] += item in threats
            row[4] += item in threats and not hinted
    return out


def test_replay_matches_a_loop_over_lines(spark, tmp_path):
    rng = random.Random(2)
    lines = []
    for desk in ("a.core", "b.core"):
        for i in range(400):
            items = rng.sample([f"i{j}" for j in range(8)], rng.randint(1, 3))
            text = rng.choice(["New match 77", "Start", "Own hero: axe"]) if rng.random() < 0.08 else f"h{rng.randint(0, 2)} new items: {', '.join(items)}"
            lines.append((desk, f"2024-01-{1 + i // 40:02d} 23:{i % 40:02d}:00", rng.randint(0, 2), text))  # many days, ties of a ms apart
    threats, parents = {"i0": True, "i1": False, "i5": True}, {("h1", "i2"): "i1", ("h2", "i3"): "i7"}
    written = [f"{at},{ms} INFO {desk}: {text}" for desk, at, ms, text in lines] + ["", "no log line", "2024-13-99 00:00:00,1 INFO a.core: Start", "2024-01-01 00:00:00,1 DEBUG a.core: Start"]
    rng.shuffle(written)
    (tmp_path / "log.txt").write_text("\n".join(written))
    got = replay.with_segments(replay.read_log(spark, str(tmp_path)), slice_width=3600.0)
    assert got.count() == len(lines)
    told = replay.replay(
        replay.sightings(got), spark.createDataFrame(list(threats.items()), "item string, has_props boolean"), spark.createDataFrame([(*k, p) for k, p in parents.items()], "hero string, item string, parent string")
    )
    totals = {(r.desk, r.segment): [r["items"], r.hinted, r.no_property, r.threats, r.already_said] for r in replay.replay_totals(told, "desk", "segment").collect()}
    assert totals == plain(lines, threats, parents)
    days = {str(r[0]) for r in got.select(replay.day_of(got["at"])).distinct().collect()}
    assert days == {f"2024-01-{d:02d} 00:00:00" for d in range(1, 11)}


def test_replay_of_an_empty_log(spark, tmp_path):
    (tmp_path / "log.txt").write_text("nothing here\n")
    lines = replay.with_segments(replay.read_log(spark, str(tmp_path)))
    seen = replay.sightings(lines)
    told = replay.replay(seen, spark.createDataFrame([], "item string, has_props boolean"))
    assert told.count() == 0 and replay.matches_of(lines).count() == 0
    assert replay.replay_totals(told).first()["hinted"] == 0
