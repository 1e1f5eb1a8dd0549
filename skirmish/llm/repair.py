"""Conversation structure repair by dynamic programming over a grammar.

What the cheapest repair needs of a row is one of nine symbols: the initial of its role, whether it is cut short, or that
it has to go. The edits of one row are a min-plus matrix over the four states of the wanted form ``(s?(ua)+)?``; a run of
rows is the product of its rows' matrices. Re-Pair replaces frequent pairs of symbols by rules over all conversations of
a batch, so a rule's matrix is computed once, from its two halves, however many conversations hold it. An entry carries
its cost and its audit, the edits' letters, as a rope over the halves' ropes.

Long conversations come as slices of a sorted range, so no task holds the texts of one. A conversation's symbols meet in
one row, a letter a row of it, which is as long as the audit that it returns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skirmish.llm.common import free_name
from skirmish.session import stage

BLANKS = "\\x20\\x09-\\x0D"
LEGAL = {"su", "ua", "au"}
NAMES = ("user", "assistant")
NEXT = (2, 2, 3, 2)  # what a user or assistant row does to: nothing yet, system, user, assistant
KEEPS = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}, "o": {}}
REROLE, DELETE, INSERT, CUT = 1, 2, 5, 5
MOD, BASE = (1 << 61) - 1, 1_000_003


class Rope:
    """A text made of two ropes or one string; equal parts are known by size and code."""

    __slots__ = ("code", "left", "power", "right", "size", "text")

    def __init__(self, text: str = "", left: Rope | None = None, right: Rope | None = None):
        self.text, self.left, self.right = text, left, right
        if left is None:
            self.size, self.power, self.code = len(text), pow(BASE, len(text), MOD), 0
            for c in text:
                self.code = (self.code * BASE + ord(c)) % MOD
        else:
            self.size, self.power = left.size + right.size, left.power * right.power % MOD
            self.code = (left.code * right.power + right.code) % MOD

    def __str__(self) -> str:
        out, todo = [], [self]
        while todo:
            at = todo.pop()
            if at.left is None:
                out.append(at.text)
            else:
                todo += [at.right, at.left]
        return "".join(out)


def less(a: Rope, b: Rope) -> bool:
    """Whether a's text comes before b's; parts that are the same are stepped over whole."""
    xs, ys = [a], [b]
    while xs and ys:
        x, y = xs.pop(), ys.pop()
        if x is y or (x.size == y.size and x.code == y.code):
            continue
        if x.left is not None and (x.size >= y.size or y.left is None):
            xs += [x.right, x.left]
            ys.append(y)
        elif y.left is not None:
            ys += [y.right, y.left]
            xs.append(x)
        else:
            n = min(x.size, y.size)
            if x.text[:n] != y.text[:n]:
                return x.text[:n] < y.text[:n]
            if x.size > n:
                xs.append(Rope(x.text[n:]))
            if y.size > n:
                ys.append(Rope(y.text[n:]))
    return not xs and any(y.size for y in ys)


def better(new: tuple[int, Rope], old: tuple[int, Rope] | None) -> bool:
    """Costs first, then audits. Audits of the same rows from the same state and at the same cost never continue each
    other: both end with the letter of the last row. So the least of a run is part of the least of a longer one."""
    return old is None or new[0] < old[0] or (new[0] == old[0] and less(new[1], old[1]))


def row_matrix(symbol: str) -> list[list]:
    """Cheapest insertions and then edit of one row, from state to state. ``symbol``: s, u, a, o (other), capital when
    cut short, x for a row that must go."""
    out: list[list] = [[None] * 4 for _ in range(4)]
    for start in range(4):
        state, spent, audit = start, 0, ""
        for _ in range(3):  # a third insertion would come back to the state after the first
            found = [(state, DELETE, "D")]
            if symbol != "x":
                cut = CUT if symbol.isupper() else 0
                kept = KEEPS[symbol.lower()].get(state)
                found += [(NEXT[state], REROLE + cut, "R")] + ([(kept, cut, "K")] if kept else [])
            for end, cost, letter in found:
                new = (spent + cost, Rope(audit + letter))
                if better(new, out[start][end]):
                    out[start][end] = new
            state, spent, audit = NEXT[state], spent + INSERT, audit + "I"
    return out


def step(row: Sequence, matrix: list[list]) -> list:
    """One row of a min-plus product."""
    out: list = [None] * 4
    for middle, head in enumerate(row):
        if head is None:
            continue
        for end, tail in enumerate(matrix[middle]):
            if tail is None:
                continue
            cost = head[0] + tail[0]
            if out[end] is None or cost <= out[end][0]:
                new = (cost, Rope("", head[1], tail[1]) if head[1].size else tail[1])
                if better(new, out[end]):
                    out[end] = new
    return out


def re_pair(texts: Sequence[str], share: int = 500) -> tuple[list, list[list]]:
    """Rules (single symbols, then pairs of earlier rules) and the texts in them.

    The most frequent pair is replaced, the least one of a tie, as long as it comes up twice and makes up a ``share``-th
    of what is left: rarer pairs would cost more to find than their matrix saves. That bounds effort only.
    """
    alphabet = sorted(set().union(*texts)) if texts else []
    rules: list = list(alphabet)
    codes = {c: i for i, c in enumerate(alphabet)}
    flat = np.array([codes.get(c, -1) for c in "\0".join(texts)], dtype=np.int64)
    while len(flat) > 1:
        a, b = flat[:-1], flat[1:]
        pairs = np.where((a >= 0) & (b >= 0), a * len(rules) + b, -1)
        kinds, counts = np.unique(pairs[pairs >= 0], return_counts=True)
        if not len(kinds) or counts.max() < max(2, len(flat) // share):
            break
        pair = int(kinds[counts.argmax()])
        at = np.flatnonzero(pairs == pair)
        if pair // len(rules) == pair % len(rules):  # in a run of one symbol every second place
            heads = np.flatnonzero(np.append(True, np.diff(at) != 1))
            inside = np.arange(len(at)) - np.repeat(heads, np.diff(np.append(heads, len(at))))
            at = at[inside % 2 == 0]
        flat[at] = len(rules)
        flat = np.delete(flat, at + 1)
        rules.append((pair // (len(rules)), pair % len(rules)))
    cuts = np.flatnonzero(flat < 0)
    return rules, [part[part >= 0].tolist() for part in np.split(flat, cuts)] if texts else []


def cheapest(texts: Sequence[str]) -> dict[str, tuple[int, str]]:
    """Cost and audit of each text of symbols."""
    texts = sorted(set(texts))
    rules, short = re_pair(texts)
    matrices: list = []
    for rule in rules:
        if isinstance(rule, str):
            matrices.append(row_matrix(rule))
        else:
            left, right = matrices[rule[0]], matrices[rule[1]]
            matrices.append([step(row, right) for row in left])
    out = {}
    for text, symbols in zip(texts, short):
        row: list = [(0, Rope()), None, None, None]
        for s in symbols:
            row = step(row, matrices[s])
        best = None
        for entry, missing in zip(row, (0, 2, 1, 0)):
            if entry is not None:
                new = (entry[0] + INSERT * missing, Rope("", entry[1], Rope("I" * missing)) if missing else entry[1])
                best = new if better(new, best) else best
        out[text] = best[0], str(best[1])
    return out


def symbols_of(initials: str, faults: str) -> str:
    return "".join("x" if f in "bd" else i.upper() if f == "t" else i for i, f in zip(initials, faults))


def damaged(conversations: DataFrame) -> DataFrame:
    """``key``, ``turn``, ``role``, ``text``, ``row``, ``copy``: the rows after the damage that their checksum names."""
    key, text = F.col("conv_id").cast("string"), F.coalesce("text", F.lit(" "))
    h = F.crc32(F.concat(F.coalesce(key, F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" "))).cast("binary")) % 20
    rows = conversations.select(
        key_of("conv_id").alias("key"), F.col("turn").cast("long").alias("turn"), h.alias("h"), F.monotonically_increasing_id().alias("row"),
        F.coalesce("role", F.lit(" ")).alias("role"), text.alias("text"),
    ).where("h != 0")
    changed = F.when(F.col("h") == 1, "").when(F.col("h") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.when(F.col("h") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    role = F.when(F.col("h") == 4, "user").otherwise(F.col("role"))
    return rows.select("key", "turn", role.alias("role"), changed.alias("text"), "row", F.explode(copies).alias("copy"))


def key_of(column: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit(" "))


def with_faults(rows: DataFrame) -> DataFrame:
    """``fault`` of each row: b(lank), d(uplicate), t(runcated) or a full stop; ``initial``: s, u, a or o.

    A text that comes up once in its conversation takes no part in the join.
    """
    place = F.struct(F.col("turn").isNotNull().alias("timed"), F.coalesce("turn", F.lit(0)).alias("turn"), "row", "copy")
    rows = rows.withColumn("look", F.sha2(F.concat_ws("\0", "role", "text"), 256)).withColumn("place", place)
    first = rows.groupBy("key", "look").agg(F.min("place").alias("first"), F.count("*").alias("times")).where("times > 1")
    rows = rows.join(first.drop("times"), ["key", "look"], "left")
    blank, whole = ~F.col("text").rlike(f"[^{BLANKS}]"), F.col("text").rlike(f"[.!?][{BLANKS}]*\\z")
    fault = F.when(blank, "b").when(F.col("first") < F.col("place"), "d").when(whole, ".").otherwise("t")
    initial = F.substring("role", 1, 1)
    return rows.select("key", "turn", "place", "role", "text", "look", fault.alias("fault"), F.when(initial.isin("s", "u", "a"), initial).otherwise("o").alias("initial"))


SLICE = "part int, slice long, key string, initials string, faults string, roles array<string>, texts array<string>"


def slices(rows: DataFrame, parts: int, most_rows: int = 1024, most_chars: int = 1_000_000) -> DataFrame:
    """Stretches of one conversation in order, as wide rows; ``part`` and ``slice`` give their order.

    Rows of one turn come by role, by the start of the text and by its checksum.
    """
    order = ["key", F.col("place.timed"), F.col("place.turn"), "role", F.substring("text", 1, 32), "look", F.col("place.row"), F.col("place.copy")]
    ranges = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("key", "initial", "fault", "role", "text")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            keys, chars = batch["key"].to_numpy(), batch["text"].str.len().to_numpy()
            out, start, held = [], 0, 0
            for at in range(len(batch) + 1):
                if at == len(batch) or (at > start and (keys[at] != keys[start] or at - start >= most_rows or held >= most_chars)):
                    if at > start:
                        own = batch.iloc[start:at]
                        out.append((part, number, keys[start], "".join(own["initial"]), "".join(own["fault"]), own["role"].tolist(), own["text"].tolist()))
                        number += 1
                    start, held = at, 0
                held += chars[at] if at < len(batch) else 0
            yield pd.DataFrame(out, columns=["part", "slice", "key", "initials", "faults", "roles", "texts"])

    return ranges.mapInPandas(cut, SLICE)


PLAN = "key string, blank long, duplicate long, truncated long, illegal long, cost long, audit string, pieces array<struct<part: int, slice: long, edits: string, state: int, single: boolean>>"


def plan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Cheapest edits of whole conversations, cut up again for their slices. A piece knows the state that it starts in."""
    for batch in batches:
        joined = [("".join(p["initials"] for p in ps), "".join(p["faults"] for p in ps)) for ps in batch["held"]]
        symbols = [symbols_of(i, f) for i, f in joined]
        best = cheapest(symbols)
        out = []
        for key, held, (initials, faults), text in zip(batch["key"], batch["held"], joined, symbols):
            cost, audit = best[text]
            illegal = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))
            pieces, at, state, row = [], 0, 0, 0
            for p in held:
                begin, entered, last = at, state, row + len(p["initials"])
                while at < len(audit) and (row < last or last == len(initials)):
                    edit = audit[at]
                    if edit == "K":
                        state = KEEPS[initials[row]][state]
                    elif edit != "D":
                        state = NEXT[state]
                    row += edit != "I"
                    at += 1
                pieces.append((p["part"], p["slice"], audit[begin:at], entered, len(held) == 1))
            out.append((key, *[faults.count(f) for f in "bdt"], illegal, cost, audit, pieces))
        yield pd.DataFrame(out, columns=["key", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "pieces"])


def repaired(edits: str, state: int, roles: Sequence[str], texts: Sequence[str]) -> list[str]:
    """``role:text`` of each row that the edits leave."""
    out, row = [], 0
    for edit in edits:
        if edit == "K":
            out.append(f"{roles[row]}:{texts[row]}")
            state = KEEPS[roles[row][:1]][state]
        elif edit in "RI":
            state = NEXT[state]
            out.append(f"{NAMES[state - 2]}:{texts[row] if edit == 'R' else ''}")
        row += edit != "I"
    return out


BODY = "key string, part int, slice long, sha string, body binary"


def bodies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The repaired rows of each slice; of a conversation of one slice only their checksum."""
    for batch in batches:
        out = []
        for r in batch.itertuples():
            lines = repaired(r.edits, r.state, r.roles, r.texts)
            body = "\n".join(lines).encode("utf-8", "surrogatepass")
            out.append((r.key, r.part, r.slice, hashlib.sha256(body).hexdigest() if r.single else None, None if r.single or not lines else body))
        yield pd.DataFrame(out, columns=["key", "part", "slice", "sha", "body"])


def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One checksum a conversation over its slices in order; a slice is held at a time."""
    key, run, begun = None, None, False
    for batch in batches:
        out = []
        for k, sha, body in zip(batch["key"], batch["sha"], batch["body"]):
            if run is not None and k != key:
                out.append((key, run.hexdigest()))
                run = None
            if sha is not None:
                out.append((k, sha))
                continue
            if run is None:
                key, run, begun = k, hashlib.sha256(), False
            if body is not None:
                run.update(b"\n" if begun else b"")
                run.update(body)
                begun = True
        yield pd.DataFrame(out, columns=["key", "repaired_sha256"])
    if run is not None:
        yield pd.DataFrame([(key, run.hexdigest())], columns=["key", "repaired_sha256"])


def repair(conversations: DataFrame, parts: int | None = None, most_rows: int = 1024) -> tuple[DataFrame, DataFrame]:
    """(plans, slices with their edits): what is wrong with each conversation and its cheapest repair, before it is applied.

    ``plans``: PLAN a conversation that has rows; ``slices``: SLICE with ``edits``, ``state`` and ``single``.
    """
    parts = parts or int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = with_faults(stage(damaged(conversations), "damaged"))
    cut = stage(slices(rows, parts, most_rows), "slices")
    held = F.sort_array(F.collect_list(F.struct("part", "slice", "initials", "faults"))).alias("held")
    plans = stage(cut.groupBy("key").agg(held).mapInPandas(plan, PLAN), "repair_plans")
    pieces = plans.select(F.explode("pieces").alias("p")).select("p.*")
    return plans, cut.join(pieces, ["part", "slice"])


def repair_report(conversations: DataFrame, parts: int | None = None, most_rows: int = 1024) -> DataFrame:
    """``conv_id``, ``gaps``, ``blank``, ``duplicate``, ``truncated``, ``illegal``, ``cost``, ``audit``, ``repaired_sha256`` for
    every conversation.

    A null role or text is one space (so blank); a null turn comes first and is in no gap; null ids are one conversation;
    rows of one turn come by role and text; repeated rows are duplicates; other columns are not read; a conversation
    whose rows are all dropped has zeros and empty texts; an empty table gives no rows.
    """
    key = free_name(conversations, "key")
    ids = conversations.select("conv_id").distinct().withColumn(key, key_of("conv_id"))
    plans, cut = repair(conversations, parts, most_rows)
    sized = damaged(conversations).groupBy("key").agg(
        (F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps")
    )
    sorted_bodies = cut.mapInPandas(bodies, BODY).repartition("key").sortWithinPartitions("key", "part", "slice")
    shas = sorted_bodies.mapInPandas(digests, "key string, repaired_sha256 string")
    full = plans.drop("pieces").join(shas, "key").join(sized, "key").withColumnRenamed("key", key)
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return ids.join(full, key, "left").select(
        "conv_id", *[zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )
