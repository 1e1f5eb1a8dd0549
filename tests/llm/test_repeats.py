"""Repeated passages against a table of all strings of 100 bytes."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skirmish.llm import repeats

DOCS = "doc_id long, text string"


def brute(rows):
    """(doc_id, n_bytes, n_removed, n_spans, sha) of rows in the order in which they come."""
    seen, out = set(), []
    for doc, text in rows:
        data = (text or "").encode()
        gone = [False] * len(data)
        for i in range(len(data) - 99):
            s = data[i : i + 100]
            if s in seen:
                gone[i : i + 100] = [True] * 100
            seen.add(s)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((doc, len(data), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(data, gone) if not g)).hexdigest()))
    return sorted(out, key=repr)


def got(df, **kw):
    return sorted((tuple(r) for r in repeats.without_repeats(df, digest=True, **kw).collect()), key=repr)


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdéß") for _ in range(rng.randint(1, 6))) for _ in range(40)]
    talk = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    shared = [talk(rng.choice([20, 30, 60])) for _ in range(12)]
    base = talk(150)
    texts = []
    for _ in range(120):
        parts = [talk(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            parts += [rng.choice(shared), talk(rng.randint(0, 8))]
        if rng.random() < 0.3:
            near = base.split()
            for _ in range(rng.randint(0, 4)):
                near[rng.randrange(len(near))] = "edit"
            parts.append(" ".join(near))
        texts.append(" ".join(parts))
    texts += [texts[3], texts[3] + "tail", "a" * 400, "a" * 101, "ab" * 90, "", None, "x" * 99, "y" * 100, "y" * 100, talk(30) * 9]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("most", [16_384, 3])
def test_against_all_strings(spark, most):
    rows = list(enumerate(corpus(most)))
    want = brute(rows)
    assert sum(w[2] for w in want) > 5000 and any(w[3] > 1 for w in want)
    shuffled = rows[:]
    random.Random(1).shuffle(shuffled)
    assert got(spark.createDataFrame(shuffled, DOCS).repartition(5), most=most) == want


def test_long_text_over_several_buffers(spark, monkeypatch):
    rng = random.Random(2)
    long = "".join(rng.choice("abcdefgh ") for _ in range(700_000))
    rows = [(0, long[:300_000]), (1, long[150_000:]), (2, long[200:320] + "." + long[262_100:262_300])]
    assert got(spark.createDataFrame(rows, DOCS)) == brute(rows)


def test_repeated_ids_nulls_and_empty(spark):
    text = "passage of its own " * 3 + "".join(chr(97 + i % 23) for i in range(200))
    rows = [(None, text), (1, text + "!"), (1, text + "!"), (2, None), (2, "short")]
    found = got(spark.createDataFrame(rows, DOCS).withColumn("key", F.lit(1)))
    assert found == brute(rows)
    assert repeats.repeat_report(spark.createDataFrame([], DOCS)).count() == 0


@pytest.mark.parametrize("shard", [300, 1 << 18])
def test_merged_transforms(shard):
    rng = random.Random(7)
    texts = [t.encode() for t in corpus(7) if t and len(t) >= 100]
    text, start = repeats.repeated(texts, shard)
    seen, want = set(), []
    for i, t in enumerate(texts):
        for j in range(len(t) - 99):
            if t[j : j + 100] in seen:
                want.append((i, j))
            seen.add(t[j : j + 100])
    assert sorted(zip(text.tolist(), start.tolist())) == want and rng


def test_merge_keeps_whole_keys_together():
    import pandas as pd

    rng = random.Random(9)
    rows, want = [], set()
    for key in range(30):
        base = "".join(rng.choice("abcd") for _ in range(130)).encode()
        for i in range(rng.randint(1, 5)):
            rows.append((key, key * 10 + i, 0, 0, base + b"%d" % i))
            if i:
                want |= {(key * 10 + i, s) for s in range(31)}
    frame = pd.DataFrame(rows, columns=["key", "doc", "tie", "start", "body"])
    for size in (1, 7, 1000):
        for most in (200, 1000, 1 << 21):
            out = pd.concat(list(repeats.merge(iter([frame.iloc[i : i + size] for i in range(0, len(frame), size)]), most)))
            assert {(d, s + k) for d, s, r in zip(out["doc"], out["start"], out["run"]) for k in range(r)} == want
    assert np.all(out["run"] > 0)
