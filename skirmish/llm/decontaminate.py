"""Benchmark decontamination: pigeonhole edit matching.

With an error budget of ``k`` edits a test item is split into ``k + 1`` pieces; at most ``k`` of them can be hit by an
edit, so one piece stands unchanged wherever the item stands. All pieces are found in one pass over a document (an
Aho-Corasick automaton), and the window around each hit is verified with Myers' bit-parallel distance.
An item under SHORT signs has no errors to spare: it counts where it stands as it is, between word borders.
Items are asked in blocks of bounded size, each block in a pass over all documents, so no automaton outgrows a worker.
"""

from __future__ import annotations

import re
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skirmish.llm.common import free_name, whole_text

SIGNS = re.compile(r"[\W_]+")
SHORT = 30
HITS = "array<struct<item_id: long, distance: int>>"


def plain(text: str) -> str:
    """Lower case, all signs and white space as one space."""
    return SIGNS.sub(" ", text.lower()).strip()


def budget(length: int, share: int = 16) -> int:
    return max(1, length // share) if length >= SHORT else 0


def pieces_of(item: str, k: int) -> list[tuple[int, str]]:
    cut = [i * len(item) // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cut, cut[1:])]


def myers(item: str, text: str) -> int:
    """The least edit distance between ``item`` and any substring of ``text``; a bit of an integer for each sign of it."""
    return scan(signs_of(item), len(item), text)


def signs_of(item: str) -> dict[str, int]:
    signs: dict[str, int] = {}
    for i, c in enumerate(item):
        signs[c] = signs.get(c, 0) | 1 << i
    return signs


def scan(signs: dict[str, int], m: int, text: str) -> int:
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score, best = full, 0, m, m
    for c in text:
        eq = signs.get(c, 0)
        across = (((eq & up) + up) ^ up) | eq
        eq |= down
        plus, minus = (down | ~(across | up)) & full, up & across
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
            best = min(best, score)
        plus, minus = plus << 1 & full, minus << 1 & full  # free start: no cost before the text
        up, down = (minus | ~(eq | plus)) & full, plus & eq
    return best


class Items:
    """The pieces of a block of items in one automaton."""

    def __init__(self, items: list[tuple[int, str]]):
        import ahocorasick

        self.items, where = [], {}
        for item_id, item in items:
            k = budget(len(item))
            self.items.append((item_id, item, k, signs_of(item)))
            for at, piece in pieces_of(item, k):
                where.setdefault(piece, []).append((len(self.items) - 1, at))
        self.tree = ahocorasick.Automaton()
        for piece, places in where.items():
            self.tree.add_word(piece, (len(piece), places))
        self.tree.make_automaton()

    def find(self, text: str) -> list[tuple[int, int]]:
        """``(item_id, distance)`` of each item within its budget, the least distance of its windows."""
        text, best, tried = plain(text), {}, {}
        for end, (size, places) in self.tree.iter(text):
            for i, at in places:
                item_id, item, k, signs = self.items[i]
                start = end + 1 - size - at
                if best.get(i) == 0 or tried.get(i) == start:
                    continue
                tried[i] = start
                if k == 0:
                    if (start == 0 or text[start - 1] == " ") and text[end + 1 : end + 2] in ("", " "):
                        best[i] = 0
                    continue
                got = scan(signs, len(item), text[max(0, start - k) : start + len(item) + k])
                if got <= k and got < best.get(i, k + 1):
                    best[i] = got
        return sorted((self.items[i][0], d) for i, d in best.items())


_built: dict[str, Items] = {}


def finders(benchmark: DataFrame, block_chars: int = 2_000_000, item_column: str = "item_id", text_column: str = "text") -> list:
    """A function of a text column for each block of items, giving the items found in each text."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col(item_column).cast("long").alias("item_id"), whole_text(text_column).alias("text")).where("item_id is not null")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = 1 + total // block_chars

    def finder(rows: list[tuple[int, str]]):
        shared, key = spark.sparkContext.broadcast(rows), uuid.uuid4().hex  # about ``block_chars`` characters

        @F.pandas_udf(HITS)
        def find(texts: pd.Series) -> pd.Series:
            if key not in _built:
                _built.clear()
                _built[key] = Items(shared.value)
            block = _built[key]
            return pd.Series([[{"item_id": i, "distance": d} for i, d in block.find(t)] for t in texts], dtype=object)

        return find

    out = []
    for part in range(parts):
        rows = items.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part).collect()  # one block
        plain_rows = sorted({(r[0], t) for r in rows if (t := plain(r[1]))})
        if plain_rows:
            out.append(finder(plain_rows))
    return out


def found_items(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, item_id, distance`` for each row of docs and item found in its whole text.

    Null and empty texts hold nothing; a null doc_id keeps its rows; repeated rows give rows each; items that are null,
    without id or without a letter or digit are not asked; an empty table gives no rows; other columns are not read.
    """
    parts = [
        docs.select(F.col(id_column).alias("doc_id"), F.explode(find(whole_text(text_column))).alias("hit")).select("doc_id", "hit.item_id", "hit.distance")
        for find in finders(benchmark)
    ]
    if not parts:
        return docs.select(F.col(id_column).alias("doc_id"), F.lit(0).cast("long").alias("item_id"), F.lit(0).alias("distance")).limit(0)
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def without_items(docs: DataFrame, benchmark: DataFrame, text_column: str = "text") -> DataFrame:
    """``docs`` without the rows whose text holds an item; no shuffle."""
    for find in finders(benchmark):
        hits: Column = find(whole_text(text_column))
        mark = free_name(docs, "hits")
        docs = docs.withColumn(mark, F.size(hits)).where(F.col(mark) == 0).drop(mark)
    return docs
