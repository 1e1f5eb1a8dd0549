"""Spelling variants by a trie-node pair dictionary.

All words are sorted once forwards and once backwards; a trie node is numbered where its prefix first comes up in that
order. A word of L letters then is two rows of integers: the nodes of its prefixes and those of its suffixes. The pair
(prefix node i, suffix node i + 1) names the word with position i skipped, (prefix node i, suffix node i) the word with
nothing skipped. Equal skipped pairs are words one replacement apart; a skipped pair that equals a whole one is a word
one deletion away. At most as many words share a pair as the alphabet has letters, so no group grows with the data.

Sorted ranges are numbered apart in their tasks. Only the nodes along the border of two neighbouring ranges belong to
both; the first and last word of each range are enough to hand them over.
"""

from __future__ import annotations

from collections.abc import Iterator
from os.path import commonprefix

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skirmish.llm.common import whole_text
from skirmish.session import small_table, stage

RUNS = "[A-Za-z\\u00C0-\\u00FF]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_LENGTH, LEAST_COUNT, TIMES, DAMAGED = 7, 2, 10, 31
NUMBERED = "part int, place long, word string, nodes array<long>, fresh long"


def word_counts(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``word``, ``n``: runs of letters with A-Z lowered; where DAMAGED divides the checksum of ``<id>:<run>`` a letter is cut."""
    run = F.explode(F.regexp_extract_all(F.translate(whole_text(text_column), UPPER, LOWER), F.lit(RUNS), F.lit(0))).alias("run")
    runs = docs.select(F.coalesce(F.col(id_column).cast("string"), F.lit("")).alias("doc"), run)
    runs = runs.withColumn("size", F.char_length("run")).where(F.col("size") >= LEAST_LENGTH)
    h = F.crc32(F.concat_ws(":", "doc", "run").cast("binary"))
    at = (F.col("h") % F.col("size")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.col("size")))
    words = runs.withColumn("h", h).select(F.when(F.col("h") % DAMAGED == 0, cut).otherwise(F.col("run")).alias("word"))
    words = words.where(F.char_length("word") >= LEAST_LENGTH)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_COUNT)


def number_range(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Trie nodes of one sorted range, numbered in the order of their first word from 0.

    A node that the first word brings may belong to the range before: these are numbered like others, and ``lift``
    replaces them. The root is node -1 everywhere.
    """
    part, place, fresh, before, held = TaskContext.get().partitionId(), 0, 0, "", []
    for batch in batches:
        out = []
        for word in batch["word"]:
            common = len(commonprefix((before, word))) if place else 0
            new = len(word) - common
            held = held[:common] + list(range(fresh, fresh + new))
            fresh += new
            out.append((part, place, word, held, fresh))
            before, place = word, place + 1
        yield pd.DataFrame(out, columns=["part", "place", "word", "nodes", "fresh"])


def borders(numbered: DataFrame) -> DataFrame:
    """For each range: how far to lift its numbers and ranks, and the nodes it has from the ranges before.

    The driver holds two words a range, however many words there are.
    """
    ends = numbered.groupBy("part").agg(
        F.min(F.struct("place", "word")).alias("first"), F.max(F.struct("place", "word", "nodes", "fresh")).alias("last")
    )
    rows, base, rank, before, stack = [], 0, 0, "", []
    for r in sorted(ends.collect(), key=lambda r: r.part):
        shared = stack[: len(commonprefix((before, r.first.word)))]
        rows.append((r.part, base, rank, shared))
        size = len(r.first.word)  # local numbers 0 .. size - 1 are the first word's own nodes
        stack = [shared[x] if x < min(len(shared), size) else base + x for x in r.last.nodes]
        before, base, rank = r.last.word, base + r.last.fresh, rank + r.last.place + 1
    return small_table(numbered.sparkSession, rows, "part int, base long, rank long, shared array<long>")


def numbered_words(words: DataFrame, carry: list[str], parts: int) -> DataFrame:
    """``words`` (distinct) in order, with ``rank`` from 0 and ``nodes``: the numbers of the prefixes of 1, 2, ... letters."""
    ranges = words.select("word").repartitionByRange(parts, "word").sortWithinPartitions("word")
    local = stage(ranges.mapInPandas(number_range, NUMBERED), "trie_nodes")
    lift = F.transform("nodes", lambda x: F.when(x < F.size("shared"), F.get("shared", x.cast("int"))).otherwise(x + F.col("base")))
    done = local.join(borders(local), "part").select("word", (F.col("rank") + F.col("place")).alias("rank"), lift.alias("nodes"))
    return done.join(words.select("word", *carry), "word") if carry else done


def with_nodes(words: DataFrame, parts: int) -> DataFrame:
    """``id`` (rank in code point order), ``word``, ``n``, ``ahead`` and ``behind``: numbers of the prefixes of 0 .. L letters
    and of the suffixes that leave out 0 .. L letters."""
    forward = numbered_words(words, ["n"], parts).withColumnRenamed("rank", "id")
    back = words.select(F.reverse("word").alias("word"))
    backward = numbered_words(back, [], parts).select(F.reverse("word").alias("word"), F.reverse("nodes").alias("behind"))
    root = F.array(F.lit(-1).cast("long"))
    return forward.join(backward, "word").select("id", "word", "n", F.concat(root, "nodes").alias("ahead"), F.concat("behind", root).alias("behind"))


def near_words(nodes: DataFrame) -> DataFrame:
    """``id``, ``near``, ``near_n``: each pair of words one letter apart, in both directions, once each."""
    size = F.size("ahead")
    whole = F.arrays_zip(F.col("ahead").alias("p"), F.col("behind").alias("s"))
    skipped = F.arrays_zip(
        F.slice("ahead", F.lit(1), size - 1).alias("p"), F.slice("behind", F.lit(2), size - 1).alias("s"),
        F.transform(F.sequence(F.lit(1), size - 1), lambda i: F.substring("word", i, F.lit(1)) != F.substring("word", i + 1, F.lit(1))).alias("ends"),
    )
    whole = nodes.select(F.col("id").alias("near"), F.col("n").alias("near_n"), F.explode(whole).alias("at")).select("near", "near_n", "at.p", "at.s")
    skips = nodes.select("id", "n", F.explode(skipped).alias("at")).select("id", "n", "at.*")
    other = skips.select(F.col("id").alias("near"), F.col("n").alias("near_n"), "p", "s")
    replaced = skips.join(other, ["p", "s"]).where(F.col("id") != F.col("near")).select("id", "near", "near_n")
    # the letters of a doubled run give one word when cut: the last of them stands for all
    cut = skips.where("ends").join(whole, ["p", "s"])
    return replaced.unionByName(cut.select("id", "near", "near_n")).unionByName(
        cut.select(F.col("near").alias("id"), F.col("id").alias("near"), F.col("n").alias("near_n"))
    )


def follow(forms: DataFrame) -> DataFrame:
    """``id``, ``root`` of every row of ``forms`` (id, form): pointers doubled until each ends at a row without a form.

    A form has TIMES the count of its word, so chains are short: 64-bit counts allow 19 steps, five doublings.
    """
    ahead = stage(forms, "forms")
    while True:
        ends = ahead.select(F.col("id").alias("form"), F.col("form").alias("next"))
        ahead = ahead.join(ends, "form", "left").select("id", F.coalesce("next", "form").alias("form"), F.col("next").isNotNull().alias("moved"))
        ahead = stage(ahead, "roots")
        if ahead.where("moved").isEmpty():
            return ahead.select("id", F.col("form").alias("root"))
        ahead = ahead.drop("moved")


def spelling_groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", parts: int | None = None) -> DataFrame:
    """``word``, ``n``, ``n_near``, ``form``, ``form_n``, ``root`` for each word of all texts.

    A null text has no words, a null id counts as an empty one; repeated rows count each; ties of ``n`` go to the word
    first in code point order; very long words cost memory by their length; other columns are not read; a table without
    words gives no rows.
    """
    parts = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    words = stage(word_counts(docs, id_column, text_column), "words")
    nodes = stage(with_nodes(words, parts), "nodes")
    best = F.max(F.struct("near_n", (-F.col("near")).alias("back"))).alias("best")
    found = near_words(nodes).groupBy("id").agg(F.count("*").alias("n_near"), best)
    known = nodes.select("id", "word", "n").join(found, "id", "left")
    holds = F.col("best.near_n") >= TIMES * F.col("n")
    known = stage(known.select("id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                               F.when(holds, -F.col("best.back")).alias("form_id"), F.when(holds, F.col("best.near_n")).alias("form_n")), "near")
    roots = follow(known.where("form_id is not null").select("id", F.col("form_id").alias("form")))
    name = lambda key, out: known.select(F.col("id").alias(key), F.col("word").alias(out))
    linked = known.where("form_id is not null").join(roots, "id").join(name("form_id", "form"), "form_id").join(name("root", "root_word"), "root")
    linked = linked.select("id", "form", F.col("root_word").alias("root"))
    return known.join(linked, "id", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
