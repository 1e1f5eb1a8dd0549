"""Spelling groups against comparison of all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from skirmish.llm.spelling import spelling_groups

DOCS = "doc_id long, text string"


def words_of(rows):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows):
    n = words_of(rows)
    links = {w: [v for v in n if near(w, v)] for w in n}
    form = {}
    for w, vs in links.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, n[w], len(links[w]), form[w], n[form[w]] if form[w] else None, root))
    return out


def got(df, **kw):
    return {tuple(r) for r in spelling_groups(df, **kw).select("word", "n", "n_near", "form", "form_n", "root").collect()}


@pytest.mark.parametrize("parts", [1, 5, 40])
def test_against_all_pairs(spark, parts):
    rng = random.Random(parts)
    base = ["".join(rng.choice("abé÷") for _ in range(rng.randint(6, 9))) for _ in range(60)] + ["aaaaaaa", "aaaaaaaa", "abababab"]
    rows = []
    for doc in range(300):
        text = []
        for _ in range(60):
            w = base[min(int(rng.expovariate(0.15)), len(base) - 1)]
            if rng.random() < 0.06:
                i = rng.randrange(len(w))
                w = w[:i] + rng.choice(["", "a", "b", w[i] + "a"]) + w[i + 1 :]
            text.append(w.upper() if rng.random() < 0.1 else w)
        rows.append((doc, " ".join(text)))
    rows += [(None, "Straßenweg straßenweg ÀÀÀÀÀÀÀÀ"), (7, None), (8, ""), (8, "x" * 3000 + " " + "x" * 3001), (9, "x" * 3000 + ", " + "x" * 3001)]
    rows += [rows[0], rows[0]]
    want = brute(rows)
    assert len(want) > 100 and any(r[3] for r in want)
    assert got(spark.createDataFrame(rows, DOCS).repartition(3), parts=parts) == want


def test_chain_of_forms_and_ties(spark):
    text = "correctly " * 1000 + "correctl " * 100 + "orrectl " * 10 + "orrectle orrectla " * 1 + "orrectle orrectla"
    rows = [(1, text)]
    found = got(spark.createDataFrame(rows, DOCS))
    assert found == brute(rows)
    assert all(r[5] == "correctly" or r[1] < 2 for r in found if r[0] in ("correctl", "orrectl"))


def test_empty_and_clashing_columns(spark):
    empty = spark.createDataFrame([], DOCS)
    assert spelling_groups(empty).count() == 0
    more = spark.createDataFrame([(1, "seventeen seventeen", 3, "q")], "doc_id long, text string, n int, word string").withColumn("id", F.lit(5))
    assert got(more) == brute([(1, "seventeen seventeen")])
