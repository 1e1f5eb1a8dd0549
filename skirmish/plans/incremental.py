"""The same recommendations from mergeable sums: only unseen matches are counted.

State: tables ``counts``, ``comp`` and ``team`` (sums over all matches so far) and ``seen`` (their ids as bitmaps, a row for
each block of 32,768 ids), published together, so that a batch is counted and remembered or neither (sources.snapshot).
The manifest names the files counted so far.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skirmish.config import DAY, Config
from skirmish.operators import counts as cnt
from skirmish.operators import heroes as hero_ops
from skirmish.operators.dims import ItemModel
from skirmish.plans import recommend
from skirmish.session import stage
from skirmish.sources import snapshot

VERSION = 2
PARTS = ("counts", "comp", "team", "seen")
SEEN = "block long, bits binary"


def state_config(cfg: Config) -> Config:
    """Hero-with-item contexts are not stored: their table would outgrow all others."""
    return cfg.with_(levels=tuple(level for level in cfg.levels if level != "L1"))


def fingerprint(model: ItemModel, cfg: Config) -> str:
    """Changes whenever stored sums would; then the state is rebuilt."""
    dims = {
        name: sorted(map(str, getattr(model, name).collect())) for name in ("expand", "key_items", "x_mech", "parts")
    }
    text = json.dumps([dims, cfg.duration_edges, cfg.half_life_days, list(cfg.levels), VERSION], sort_keys=True)
    return hashlib.sha256(text.encode()).hexdigest()[:16]


def id_bits(ids: DataFrame) -> DataFrame:
    """(block, bits): the ids of a table as bitmaps, combined before the shuffle."""
    block = F.bitmap_bucket_number("match_id")
    return ids.groupBy(block.alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("match_id")).alias("bits"))


def unseen(matches: DataFrame, seen: DataFrame | None) -> DataFrame:
    """Ids of matches that were not counted before. Only ids and bitmaps meet, never rows."""
    ids = matches.select("match_id").distinct()
    if seen is None:
        return ids
    asked = ids.withColumns({"block": F.bitmap_bucket_number("match_id"), "at": F.bitmap_bit_position("match_id")})
    byte = F.conv(F.hex(F.substring("bits", (F.col("at") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    known = F.call_function("bit_get", byte, (F.col("at") % 8).cast("int")) == 1
    return asked.join(seen, "block", "left").where(~F.coalesce(known, F.lit(False))).select("match_id")


def add_batch(
    spark: SparkSession, matches: DataFrame, state: str, manifest: dict, model: ItemModel, cfg: Config, files: dict[str, int]
) -> dict:
    """Count one batch and publish a new generation. A repeated batch adds nothing: its ids are seen."""
    epoch = manifest.get("epoch")
    if epoch is None:
        epoch = int(matches.agg(F.min("start_time")).first()[0] or 0) // DAY * DAY
    before = snapshot.newest(spark, state)
    old = {n: spark.read.parquet(f"{before[0]}/{n}") for n in PARTS} if before else {}
    ids = stage(unseen(matches, old.get("seen")), "new_ids")
    fresh = matches.join(ids, "match_id", "left_semi")
    ready = recommend.prepare_teams(fresh, model, cfg, epoch=epoch)
    per_match = ready.teams.groupBy("match_id").agg(F.first("bucket").alias("bucket"), F.min("start_time").alias("start"))
    facts = per_match.groupBy("bucket").agg(F.count("*").alias("m"), F.min("start").alias("lo"), F.max("start").alias("hi")).collect()
    done = {**manifest, "epoch": epoch, "files": {**manifest.get("files", {}), **files}}
    if not facts:
        if old:
            snapshot.publish(spark, state, old, done)
        return done
    patches = ready.teams.select("patch", F.size("players").alias("k")).groupBy("patch").agg(F.sum("k").alias("k")).collect()
    parts = {
        "counts": cnt.count_teams(ready.teams),
        "comp": hero_ops.component_share(ready.teams, model.parts).select("y", "itself", "players"),
        "team": hero_ops.team_counts(ready.teams),
        "seen": id_bits(ids),
    }
    if old:
        parts = {n: _merged(n, old[n], df) for n, df in parts.items()}
    info = done.get("info", {"by_bucket": {}, "patches": {}, "matches": 0, "first": None, "last": None})
    info = json.loads(json.dumps(info))
    for r in facts:
        info["by_bucket"][r["bucket"]] = info["by_bucket"].get(r["bucket"], 0) + r["m"]
        info["matches"] += r["m"]
        info["first"] = r["lo"] if info["first"] is None else min(info["first"], r["lo"])
        info["last"] = r["hi"] if info["last"] is None else max(info["last"], r["hi"])
    for r in patches:
        info["patches"][str(r["patch"])] = info["patches"].get(str(r["patch"]), 0) + r["k"]
    done.update(info=info)
    snapshot.publish(spark, state, parts, done)
    return done


def _merged(name: str, total: DataFrame, delta: DataFrame) -> DataFrame:
    """total + delta by key; the written generation is new, so an input is never overwritten."""
    if name == "counts":
        return cnt.merge(total, delta)
    if name == "seen":
        return total.unionByName(delta).groupBy("block").agg(F.bitmap_or_agg("bits").alias("bits"))
    keys = {"comp": ["y"], "team": ["bucket", "y"]}[name]
    values = {"comp": ["itself", "players"], "team": ["pairs", "expected"]}[name]
    both = total.select(*keys, *values).unionByName(delta.select(*keys, *values))
    return both.groupBy(*keys).agg(*[F.sum(v).alias(v) for v in values])


def needs_rebuild(manifest: dict, stamp: str, files: dict[str, int]) -> bool:
    changed = any(files.get(name) != size for name, size in manifest.get("files", {}).items())
    return manifest.get("version") != VERSION or manifest.get("fingerprint") != stamp or changed


def update(
    spark: SparkSession, read, files: dict[str, int], state: str, model: ItemModel, cfg: Config, files_per_batch: int = 20
) -> dict:
    """Bring the state up to the current files. ``read(names)`` returns the match rows of those files.

    After a change of parameters or of a counted file the sums start anew in fresh generations.
    """
    cfg = state_config(cfg)
    stamp = fingerprint(model, cfg)
    base, manifest = snapshot.newest(spark, state) or (None, {})
    if needs_rebuild(manifest, stamp, files):
        manifest = {"version": VERSION, "fingerprint": stamp, "files": {}}
        if base is not None:
            empty = {n: spark.read.parquet(f"{base}/{n}").where(F.lit(False)) for n in PARTS}
            snapshot.publish(spark, state, empty, manifest)
    new = sorted(set(files) - set(manifest.get("files", {})))
    for i in range(0, len(new), files_per_batch):
        names = new[i : i + files_per_batch]
        manifest = add_batch(spark, read(names), state, manifest, model, cfg, {n: files[n] for n in names})
    return manifest


def stored_counts(spark: SparkSession, state: str, cfg: Config) -> tuple[DataFrame, dict]:
    """Sums rebased to the newest match, so they equal a count from scratch."""
    base, manifest = snapshot.newest(spark, state)
    factor = 2.0 ** ((manifest["epoch"] - manifest["info"]["last"]) / cfg.half_life_sec)
    return cnt.scaled(spark.read.parquet(f"{base}/counts"), factor), manifest


def recommendations_from_state(
    spark: SparkSession, state: str, model: ItemModel, cfg: Config, tables: Sequence[str] = recommend.ALL_TABLES
) -> recommend.Recommendations:
    cfg = state_config(cfg)
    if cfg.store_rank_groups:
        raise ValueError("rank groups are not kept in the state")
    counts, manifest = stored_counts(spark, state, cfg)
    counts = stage(counts, "scaled")
    base = snapshot.resolve(spark, state)
    comp = spark.read.parquet(f"{base}/comp").select("y", (F.col("itself") / F.col("players")).alias("share"), "players", "itself")
    info = manifest["info"]
    patch = max(sorted(info["patches"]), key=lambda k: info["patches"][k]) if info["patches"] else None
    facts = spark.createDataFrame(
        [(info["matches"], info["first"], info["last"], patch)], "matches long, first_start long, last_start long, patch string"
    )
    return recommend.finish(counts, comp, spark.read.parquet(f"{base}/team"), facts, model, cfg, tables)


def stream_batches(state: str, model: ItemModel, cfg: Config):
    """A foreachBatch function: each micro-batch is one incremental batch, safe to repeat.

    A state of other parameters is refused: a stream can't read again what it has behind it (see ``update``).
    """
    stamp = fingerprint(model, state_config(cfg))

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        found = snapshot.newest(spark, state)
        manifest = found[1] if found else {"version": VERSION, "fingerprint": stamp, "files": {}}
        if (manifest.get("version"), manifest.get("fingerprint")) != (VERSION, stamp):
            raise ValueError("the state was counted with other parameters")
        add_batch(spark, stage(batch, "batch"), state, manifest, model, state_config(cfg), {f"batch-{batch_id}": 0})

    return handle
