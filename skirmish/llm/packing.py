"""Packing by cutting stock: a linear program over length patterns, its columns priced by a knapsack.

Documents are cut at every ``capacity`` tokens; what matters are the shorter rests. Their lengths, in units of ``unit``
tokens rounded up, are a histogram of at most ``capacity / unit`` classes, whatever the number of documents. Only this
histogram reaches the driver. There the linear program (fewest sequences that hold all lengths) starts from one-class
patterns; a knapsack over the dual prices finds the best further pattern until no bound can improve by more than
``gap``. Patterns are rounded down, and what is left over, a bounded number of pieces, is packed first-fit decreasing.
Back on the executors the r-th piece of a class takes the r-th place that the patterns hold for its class.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skirmish.llm.bpe import encoder
from skirmish.llm.common import whole_text
from skirmish.session import stage

END_ID = 0


def best_pattern(prices: np.ndarray, sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The unbounded knapsack: how many of each class fill ``capacity`` at the greatest price. Dynamic programming."""
    price = np.full(capacity + 1, -np.inf)
    price[sizes] = prices
    best, took = np.zeros(capacity + 1), np.zeros(capacity + 1, dtype=np.int64)
    for room in range(1, capacity + 1):
        worth = best[room - 1 :: -1][:room] + price[1 : room + 1]  # with a piece of 1, 2, ... as the last
        size = int(worth.argmax())
        best[room], took[room] = (worth[size], size + 1) if worth[size] > best[room - 1] + 1e-12 else (best[room - 1], 0)
    of_size = {int(size): i for i, size in enumerate(sizes)}
    pattern, room = np.zeros(len(sizes), dtype=np.int64), capacity
    while room > 0:
        if took[room]:
            pattern[of_size[int(took[room])]] += 1
        room -= max(1, int(took[room]))
    return pattern


def cutting_stock(demand: dict[int, int], capacity: int, gap: float = 1e-3, most_columns: int = 4000) -> list[tuple[int, dict[int, int]]]:
    """Patterns ``(times, {class: pieces})`` that hold exactly ``demand`` pieces of each class size (in units)."""
    sizes = np.array(sorted((s for s, d in demand.items() if d), reverse=True), dtype=np.int64)
    if not len(sizes):
        return []
    need = np.array([demand[int(s)] for s in sizes], dtype=np.float64)
    m = len(sizes)
    columns = np.diag(capacity // sizes).astype(np.float64)  # the basis, one pattern a column
    inverse = np.diag(1.0 / np.diag(columns))
    times = inverse @ need
    room, seen = float(sizes @ need) / capacity, float("inf")  # no packing needs fewer sequences than their room
    for step in range(most_columns):
        if step % 100 == 0:
            total = float(times.sum())
            if total <= room * (1 + gap) or total > seen * (1 - gap / 10):
                break  # near enough, or the last hundred columns changed next to nothing
            seen = total
        prices = inverse.sum(axis=0)
        pattern = best_pattern(np.maximum(prices, 0), sizes, capacity)
        value = float(np.maximum(prices, 0) @ pattern)
        if value <= 1 + gap:  # no packing can use fewer than 1 / value of these sequences
            break
        move = inverse @ pattern
        ratio = np.where(move > 1e-9, times / np.where(move > 1e-9, move, 1), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        columns[:, out] = pattern
        pivot = inverse[out] / move[out]
        inverse -= np.outer(move, pivot)
        inverse[out] = pivot
        times -= move * ratio[out]
        times[out] = ratio[out]
        if step % 200 == 199:  # keeps rounding errors from adding up
            rest = 2 * np.eye(m) - np.einsum("ij,jk->ik", columns, inverse)  # one Newton step, without threads
            inverse = np.einsum("ij,jk->ik", inverse, rest)
            times = np.einsum("ij,j->i", inverse, need)
    left, plan = need.astype(np.int64), []
    for k in np.argsort(-times, kind="stable"):
        column = columns[:, k].astype(np.int64)
        used = column > 0
        n = min(int(times[k] + 1e-6), int((left[used] // column[used]).min()))
        if n > 0:
            left -= n * column
            plan.append((n, {int(s): int(c) for s, c in zip(sizes, column) if c}))
    open_bins: list[list] = []  # (room, pattern), at most one for each piece that rounding left over
    for s, n in zip(sizes, left):
        for _ in range(int(n)):
            fit = next((b for b in open_bins if b[0] >= s), None)
            if fit is None:
                open_bins.append(fit := [capacity, {}])
            fit[0] -= int(s)
            fit[1][int(s)] = fit[1].get(int(s), 0) + 1
    return plan + [(1, b[1]) for b in open_bins]


class Places:
    """Where the r-th piece of a class goes: ``(sequence, order in it)``."""

    def __init__(self, plan: list[tuple[int, dict[int, int]]]):
        self.sequences, runs = 0, {}
        for times, pattern in plan:
            order = 0
            for size, count in sorted(pattern.items(), reverse=True):
                runs.setdefault(size, []).append((times * count, count, self.sequences, order))
                order += count
            self.sequences += times
        self.runs = {s: tuple(np.array(c, dtype=np.int64) for c in zip(*r)) for s, r in runs.items()}

    def find(self, size: int, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        held, count, first, order = self.runs[size]
        ends = np.cumsum(held)
        at = np.searchsorted(ends, rank, side="right")
        inside = rank - (ends[at] - held[at])
        return first[at] + inside // count[at], order[at] + inside % count[at]


def pieces(docs: DataFrame, path: str, capacity: int = 1024, keep_ids: bool = False, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens`` (and ``ids``): each document with the end id, cut at every ``capacity``."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(path)
        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc_id"], batch["text"]):
                ids = np.append(enc.ids(text), np.uint32(END_ID)).astype("<u4")
                for start in range(0, len(ids), capacity):
                    part = ids[start : start + capacity]
                    rows.append((doc, start, len(part), zlib.crc32(part.tobytes()), len(ids), *([part.astype(np.int32)] if keep_ids else [])))
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *(["ids"] if keep_ids else [])]
            out = pd.DataFrame(rows, columns=names)
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * keep_ids
    return docs.select(F.col(id_column).cast("long").alias("doc_id"), whole_text(text_column).alias("text")).mapInPandas(cut, schema)


def pack(docs: DataFrame, path: str, capacity: int = 1024, unit: int = 8, gap: float = 1e-3, keep_ids: bool = False, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The pieces with ``sequence_id`` and ``offset``: sequences hold at most ``capacity`` tokens, without gaps from 0.

    A null text is an empty document (its end id alone); a null id is kept; repeated rows are documents of their own;
    ties of a class are ranked by id and start; other columns are not read; an empty table gives no rows. A hot length
    is no hot task: ranks are counted inside range partitions, and a class is never gathered.
    """
    spark = docs.sparkSession
    cut = stage(pieces(docs, path, capacity, keep_ids, id_column, text_column), "pieces")
    size = F.ceil(F.col("length") / unit).cast("int")
    order = ["doc_id", "start", "ids_crc32"]
    ranged = cut.withColumn("size", size).withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*order, "tie").drop("tie")
    sorted_ = stage(ranged.withColumn("part", F.spark_partition_id()), "ranked")

    counts = stage(sorted_.groupBy("size", "part").agg(F.count("*").alias("n")), "class_counts")
    before = Window.partitionBy("size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = counts.select("size", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    demand = {r["size"]: r["n"] for r in counts.groupBy("size").agg(F.sum("n").alias("n")).collect()}  # capacity / unit rows at most
    places = Places(cutting_stock(demand, capacity // unit, gap))

    in_part = F.row_number().over(Window.partitionBy("part", "size").orderBy(*order)) - 1
    ranked = sorted_.withColumn("rank", in_part.cast("long")).join(ahead, ["size", "part"]).withColumn("rank", F.col("rank") + F.col("ahead"))
    shared = spark.sparkContext.broadcast(places)  # a few thousand numbers, bounded by the classes

    @F.pandas_udf("struct<sequence_id: long, place: long>")
    def place(sizes: pd.Series, ranks: pd.Series) -> pd.DataFrame:
        sequence, order = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
        of, rank = sizes.to_numpy(), ranks.to_numpy()
        for s in np.unique(of):
            mine = of == s
            sequence[mine], order[mine] = shared.value.find(int(s), rank[mine])
        return pd.DataFrame({"sequence_id": sequence, "place": order})

    placed = ranked.withColumn("at", place("size", "rank")).select(*cut.columns, "at.sequence_id", "at.place")
    filled = Window.partitionBy("sequence_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(filled), F.lit(0)).cast("long")).drop("place")


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, length, ids`` of packed pieces that kept their ids; a sequence is a bounded group."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    ids = F.flatten(F.transform(parts, lambda p: p["ids"]))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), ids.alias("ids"))
