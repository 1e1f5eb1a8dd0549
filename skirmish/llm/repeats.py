"""Removal of long passages that occur earlier in the corpus, by merged Burrows-Wheeler transforms.

Every string of LEAST bytes belongs to one piece of 32 bytes inside it, the one of least hash (leftmost of equals), which
its content alone decides. Neighbouring strings with the same piece in the same place form a stretch; equal strings lie
in stretches with equal pieces. So the corpus falls into independent groups by piece:

* a stretch whose piece occurs once has no equal anywhere and is done;
* of equal stretches only the first needs a further look, the others are repeats as they stand;
* the different stretches of one piece go, with those of other pieces, into collections of bounded size. Shards of a
  collection get a suffix order each; their transforms are merged by refining the interleave from the right to the left,
  two bytes a round, until suffixes stand together that share LEAST bytes. A suffix that shares its bytes so far with no
  other leaves the interleave, for it can't share more. The intervals left over are the repeated strings.

A piece with more different stretches than a collection holds has its strings compared by digest instead, in groups of
their own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skirmish.llm.common import whole_text
from skirmish.session import stage

LEAST, PIECE = 100, 32
WINDOW = LEAST - PIECE + 1
BUFFER, PLACE = 1 << 18, np.uint64((1 << 21) - 1)  # bytes looked at together; the low bits of a hash that hold its place
END = 0xFF  # no byte of UTF-8
NO_ID = -(1 << 63)
_random = np.random.default_rng(12)
TABLE = _random.integers(0, 1 << 63, 256, dtype=np.uint64)
FACTORS = _random.integers(0, 1 << 63, 12, dtype=np.uint64) | np.uint64(1)


def piece_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the 32 bytes from each place, by doubling."""
    h, size = TABLE[data], 1
    for i in range(5):
        h = h[:-size] * FACTORS[2 * i] ^ h[size:] * FACTORS[2 * i + 1]
        h ^= h >> np.uint64(29)
        size *= 2
    h *= FACTORS[10]
    h ^= h >> np.uint64(32)
    return h


def stretches(data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, number of strings, piece) of each stretch of ``data``, texts of ``sizes`` bytes one after the other."""
    n = len(data) - LEAST + 1
    if n < 1:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),)
    h = piece_hashes(data)
    low = (h & ~PLACE) | np.arange(len(h), dtype=np.uint64)
    size = 1
    while size * 2 <= WINDOW:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    place = (np.minimum(low[:n], low[WINDOW - size :][:n]) & PLACE).astype(np.int64)
    whole = np.repeat(np.cumsum(sizes), sizes)[:n] - np.arange(n) >= LEAST
    place[~whole] = -1
    starts = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
    runs = np.diff(np.append(starts, n))
    inside = place[starts] >= 0
    starts, runs = starts[inside], runs[inside]
    return starts, runs, h[place[starts]]


COLUMNS = ["key", "hash", "doc", "tie", "start", "run"]
UNITS = "key long, hash long, doc long, tie long, start long, run long"


def joined_runs(doc: np.ndarray, tie: np.ndarray, start: np.ndarray, run: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of strings, sorted by place, with those that go on joined to one."""
    if not len(doc):
        return doc, tie, start, run
    new = np.append(True, (doc[1:] != doc[:-1]) | (tie[1:] != tie[:-1]) | (start[1:] != start[:-1] + run[:-1]))
    heads = np.flatnonzero(new)
    return doc[heads], tie[heads], start[heads], np.add.reduceat(run, heads)


def first_of_each(units: list[tuple]) -> pd.DataFrame:
    """The stretches of one task's share, each content once at its first place; the others as runs of a negative number."""
    key, code, doc, tie, start, run = (np.concatenate(c) for c in zip(*units))
    order = np.lexsort((start, tie, doc, code, key))
    key, code, doc, tie, start, run = (c[order] for c in (key, code, doc, tie, start, run))
    same = np.append(False, (key[1:] == key[:-1]) & (code[1:] == code[:-1]))
    back = np.flatnonzero(same)
    back = back[np.lexsort((start[back], tie[back], doc[back]))]
    gone = joined_runs(doc[back], tie[back], start[back], run[back])
    spread = gone[0] * 0x1E3779B97F4A7C15 + gone[2]
    first = pd.DataFrame(dict(zip(COLUMNS, (c[~same] for c in (key, code, doc, tie, start, run)))))
    rest = pd.DataFrame(dict(zip(COLUMNS, (spread, spread, *gone[:3], -gone[3]))))
    return pd.concat([first, rest])


def units_of(batches: Iterator[pd.DataFrame], share: int = 1 << 26) -> Iterator[pd.DataFrame]:
    """Stretches of all texts (doc, tie, body), combined within ``share`` bytes of text."""
    held: list[tuple] = []
    bodies: list[tuple] = []
    size = seen = 0

    def look() -> None:
        if not bodies:
            return
        raw = b"".join(b[3] for b in bodies)
        sizes = np.array([len(b[3]) for b in bodies])
        starts, runs, keys = stretches(np.frombuffer(raw, np.uint8), sizes)
        view = memoryview(raw)
        codes = np.fromiter((xxhash.xxh64_intdigest(view[s : s + r + LEAST - 1]) for s, r in zip(starts.tolist(), runs.tolist())), np.uint64, len(starts))
        edges = np.cumsum(sizes)
        own = np.searchsorted(edges, starts, "right")
        doc, tie, shift = (np.array([b[i] for b in bodies], np.int64)[own] for i in range(3))
        held.append((keys.view(np.int64), codes.view(np.int64), doc, tie, starts - (edges - sizes)[own] + shift, runs))

    for batch in batches:
        for doc, tie, body in zip(batch["doc"].tolist(), batch["tie"].tolist(), batch["body"]):
            for at in range(0, max(len(body) - LEAST + 1, 0), BUFFER):
                part = body[at : at + BUFFER + LEAST - 1]
                bodies.append((doc, tie, at, part))
                size += len(part)
                if size >= BUFFER:
                    look()
                    seen += size
                    bodies, size = [], 0
            if seen >= share:
                yield first_of_each(held)
                held, seen = [], 0
    look()
    if held:
        yield first_of_each(held)


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Places of ``text`` in the order of the 128 bytes that follow."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    code = np.zeros(n, np.uint64)
    for i in range(8):
        code = code << np.uint64(8) | padded[i : i + n]
    size = 8
    while True:
        order = np.argsort(code)
        code = code[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.append(0, code[1:] != code[:-1]))
        if size >= LEAST or rank[order[-1]] == n - 1:
            return order
        code = rank * (n + 1)
        code[: n - size] += rank[size:] + 1
        size *= 2


def transform(text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A shard's transform, two bytes a row: (places, the two bytes before each, the row of the place two back).

    0xFFFF where an end of a text is among the two.
    """
    order = suffix_order(text)
    row = np.empty(len(text), np.int32)
    row[order] = np.arange(len(text), dtype=np.int32)
    one, two = text[order - 1], text[order - 2]
    pair = two.astype(np.uint16) << 8 | one
    pair[(one == END) | (two == END) | (order < 2)] = 0xFFFF
    return order, pair, row[order - 2]


def repeated(texts: list[bytes], shard: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """(text, start) of every string of LEAST bytes that also starts earlier, in texts that are sorted by place.

    Shards of whole texts are transformed apart; their rows are interleaved and refined.
    """
    edges = np.cumsum([0] + [len(t) + 1 for t in texts])
    places, pairs, rows = [], [], []
    first = 0
    while first < len(texts):
        last = max(int(np.searchsorted(edges, edges[first] + shard, "right")) - 1, first + 1)
        data = np.frombuffer(b"".join(t + b"\xff" for t in texts[first:last]), np.uint8)
        place, pair, back = transform(data)
        base = sum(map(len, places))
        places.append(place + edges[first])
        pairs.append(pair)
        rows.append(back + np.int32(base))
        first = last
    place, pair, back = np.concatenate(places), np.concatenate(pairs), np.concatenate(rows)
    mix = np.arange(len(place), dtype=np.int32)
    block = np.zeros(len(place), np.int32)
    for _ in range(LEAST // 2):
        before = pair[mix]
        on = np.flatnonzero(before != 0xFFFF)
        order = on[np.argsort(before[on], kind="stable")]
        before, block, mix = before[order], block[order], back[mix[order]]
        head = np.append(True, (before[1:] != before[:-1]) | (block[1:] != block[:-1])) if len(mix) else np.zeros(0, bool)
        shared = ~(head & np.append(head[1:], True))
        mix, block = mix[shared], np.cumsum(head, dtype=np.int32)[shared]
    if not len(mix):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = place[mix]
    heads = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
    least = np.repeat(np.minimum.reduceat(at, heads), np.diff(np.append(heads, len(at))))
    at = np.sort(at[at != least])
    text = np.searchsorted(edges, at, "right") - 1
    return text, at - edges[text]


RUNS = "doc long, tie long, start long, run long"


def merge(batches: Iterator[pd.DataFrame], most: int = 1 << 21) -> Iterator[pd.DataFrame]:
    """Repeated strings among the stretches of each key (sorted by key), in collections of about ``most`` bytes of whole keys."""

    def solve(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["doc", "tie", "start"], ignore_index=True)
        text, start = repeated(part["body"].tolist())
        doc, tie, base = (part[c].to_numpy()[text] for c in ("doc", "tie", "start"))
        return pd.DataFrame(dict(zip(["doc", "tie", "start", "run"], joined_runs(doc, tie, base + start, np.ones(len(text), np.int64)))))

    held: list[pd.DataFrame] = []
    size = 0
    for batch in batches:
        keys = batch["key"].to_numpy()
        sizes = np.cumsum(batch["body"].str.len().to_numpy())
        ends = np.flatnonzero(np.append(keys[1:] != keys[:-1], False)) + 1
        if held and len(keys) and keys[0] != held[-1]["key"].iloc[-1]:
            ends = np.append(0, ends)
        at = 0
        for end in ends.tolist():
            here = int(sizes[end - 1] - (sizes[at - 1] if at else 0)) if end > at else 0
            if size + here >= most:
                yield solve(pd.concat([*held, batch.iloc[at:end]]))
                held, size, at = [], 0, end
        held.append(batch.iloc[at:])
        size += int(sizes[-1] - (sizes[at - 1] if at else 0)) if at < len(batch) else 0
    if held:
        yield solve(pd.concat(held))


def bodies_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The bytes of each wanted stretch."""
    for batch in batches:
        out = []
        for r in batch.itertuples():
            for key, start, run, versions in zip(r.keys.tolist(), r.starts.tolist(), r.runs.tolist(), r.versions.tolist()):
                out.append((key, r.doc, r.tie, start, run, versions, r.body[start : start + run + LEAST - 1]))
        yield pd.DataFrame(out, columns=["key", "doc", "tie", "start", "run", "versions", "body"])


def cut_out(batches: Iterator[pd.DataFrame], digest: bool) -> Iterator[pd.DataFrame]:
    """What is left of each text, or its SHA-256."""
    for batch in batches:
        out = []
        for r in batch.itertuples():
            n = len(r.body)
            if r.copy > 1:
                gone = np.full(n, n >= LEAST)
            else:
                change = np.zeros(n + 1, np.int64)
                if r.starts is not None:
                    np.add.at(change, r.starts, 1)
                    np.add.at(change, r.starts + r.runs + LEAST - 1, -1)
                gone = np.cumsum(change)[:n] > 0
            kept = np.frombuffer(r.body, np.uint8)[~gone].tobytes()
            spans = int((gone[1:] & ~gone[:-1]).sum()) + int(n > 0 and gone[0])
            out.append((r.absent, r.doc, n, int(gone.sum()), spans, hashlib.sha256(kept).hexdigest() if digest else kept))
        yield pd.DataFrame(out, columns=["absent", "doc", "n_bytes", "n_removed", "n_spans", "kept"])


def numbered(docs: DataFrame, id_column: str, text_column: str) -> tuple[DataFrame, bool]:
    """``absent``, ``doc``, ``tie``, ``body``, and whether no id repeats. ``tie`` tells rows of one id apart by their text."""
    doc = F.coalesce(F.col(id_column).cast("long"), F.lit(NO_ID))
    unique = docs.groupBy(doc.alias("doc")).count().where("count > 1").isEmpty()
    tie = F.lit(0).cast("long") if unique else F.xxhash64(whole_text(text_column))
    body = whole_text(text_column).cast("binary")
    return docs.select(F.col(id_column).isNull().alias("absent"), doc.alias("doc"), tie.alias("tie"), body.alias("body")), unique


def repeated_runs(rows: DataFrame, most: int = 16_384) -> DataFrame:
    """``doc``, ``tie``, ``start``, ``run``: the places from ``start`` on where a string starts that also starts earlier.

    ``rows`` has ``doc``, ``tie`` and ``body``, each pair of the first two once. ``most``: a piece with more different stretches goes by digests.
    """
    units = rows.mapInPandas(units_of, UNITS).withColumn("own", F.col("run") < 0)
    by_piece = Window.partitionBy("key", "own")
    before = lambda c: F.lag(c).over(by_piece.orderBy("hash", "doc", "tie", "start"))
    place = F.struct("doc", "tie", "start")
    seen = units.withColumn("same", F.coalesce(F.col("hash") == before("hash"), F.lit(False)))
    seen = seen.withColumn("versions", F.sum(F.when(F.col("same"), 0).otherwise(1)).over(by_piece))
    seen = stage(seen.where("own or same or versions > 1").drop("hash"), "stretches")
    wanted = seen.where("not own and not same").groupBy("doc", "tie").agg(F.collect_list(F.struct("key", "start", "run", "versions")).alias("at"))
    wanted = wanted.select("doc", "tie", *[F.col(f"at.{c}").alias(f"{c}s" if c != "versions" else c) for c in ("key", "start", "run", "versions")])
    found = wanted.join(rows, ["doc", "tie"]).mapInPandas(bodies_of, "key long, doc long, tie long, start long, run long, versions long, body binary")
    found = stage(found, "stretch_bodies")
    few = found.where(F.col("versions") <= most).select("key", "doc", "tie", "start", "body")
    merged = few.repartition("key").sortWithinPartitions("key").mapInPandas(merge, RUNS)
    string = F.explode(F.transform(F.sequence(F.lit(1), F.col("run").cast("int")), lambda i: F.struct(i.alias("i"), F.sha2(F.substring("body", i, F.lit(LEAST)), 256).alias("look"))))
    many = found.where(F.col("versions") > most).select("doc", "tie", "start", string.alias("s"))
    many = many.select("doc", "tie", (F.col("start") + F.col("s.i") - 1).alias("start"), F.col("s.look").alias("look"))
    firsts = many.groupBy("look").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1")
    digested = many.join(firsts, "look").where(place != F.col("first")).select("doc", "tie", "start", F.lit(1).cast("long").alias("run"))
    plain = seen.where("own or same").select("doc", "tie", "start", F.abs("run").alias("run"))
    return plain.unionByName(merged).unionByName(digested)


def without_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", most: int = 16_384, digest: bool = False) -> DataFrame:
    """``doc_id`` (long), ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept`` (binary; with ``digest`` its SHA-256) for every row.

    Earlier is a smaller id (null is the least), in one document a smaller start. Rows of one id come in the order of a
    hash of their texts; of rows that are the same in both the first stays and the others are repeats of it. A null text
    is empty; texts under LEAST bytes stay whole; other columns are not read; an empty table gives no rows.
    """
    rows, unique = numbered(docs, id_column, text_column)
    once = rows.select("doc", "tie", "body")
    spans = stage(repeated_runs(once if unique else once.dropDuplicates(["doc", "tie"]), most), "repeats")
    spans = spans.groupBy("doc", "tie").agg(F.collect_list(F.struct("start", "run")).alias("at"))
    spans = spans.select("doc", "tie", F.col("at.start").alias("starts"), F.col("at.run").alias("runs"))
    copy = F.lit(1) if unique else F.row_number().over(Window.partitionBy("doc", "tie").orderBy("absent"))
    rows = rows.join(spans, ["doc", "tie"], "left").withColumn("copy", copy).select("absent", "doc", "starts", "runs", "copy", "body")
    schema = f"absent boolean, doc long, n_bytes long, n_removed long, n_spans long, kept {'string' if digest else 'binary'}"
    done = rows.mapInPandas(lambda batches: cut_out(batches, digest), schema)
    return done.select(F.when(~F.col("absent"), F.col("doc")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept")


def repeat_report(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``without_repeats`` with ``kept_sha256`` in place of the bytes."""
    return without_repeats(docs, id_column, text_column, digest=True).withColumnRenamed("kept", "kept_sha256")
