"""The operators of the list on small fixtures: brute force, planted cases, nulls, repeated rows and empty tables."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from skirmish.llm import decontaminate, licences, pii, quality, simhash, tool_calls, urls
from skirmish.llm.packing import cutting_stock

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)], DOCS)


def test_shard_links_match_brute_force():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    fp = np.unique(np.concatenate([base] + [base ^ (np.uint64(1) << rng.integers(0, 63, 40).astype(np.uint64)) for _ in range(6)]))
    label = simhash.shard_links(fp, np.zeros(len(fp), np.int64), 3, at_once=500)
    want = np.arange(len(fp))
    near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 3
    while True:
        new = np.array([want[near[i]].min() for i in range(len(fp))])
        if (new == want).all():
            break
        want = new
    assert (label == want).all()


@pytest.mark.parametrize("limit", [8192, 4])
def test_near_duplicates_components(spark, limit):
    rng = random.Random(5)
    texts = [words(rng, 200) for _ in range(15)]
    texts += [t + " tail" for t in texts[:6]] + [texts[0], None, "", "one", "one"]
    got = simhash.near_duplicates(docs_of(spark, texts), limit=limit).collect()
    assert len(got) == len(texts)
    prints = {r.doc_id: int(r.fingerprint, 16) for r in got}
    root = {i: i for i in prints}
    changed = True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if (prints[a] ^ prints[b]).bit_count() <= 3 and root[b] < root[a]:
                    root[a], changed = root[b], True
    assert {r.doc_id: r.component_id for r in got} == root
    assert prints[22] == prints[23] == 0
    assert simhash.near_duplicates(docs_of(spark, []).limit(0)).count() == 0


def test_keep_one_matches_all_pairs(spark):
    rng = random.Random(8)
    texts = [words(rng, rng.choice([3, 60, 120, 400])) for _ in range(30)]
    for i in range(0, 24):  # edits in one to four places: some stay above 0.8, some fall below
        own = texts[i].split()
        for _ in range(1 + i % 4):
            own[rng.randrange(len(own))] = "edited"
        texts.append(" ".join(own))
    texts += [texts[1].upper(), texts[2], texts[2], None, "", ""]
    root = list(range(len(texts)))
    for _ in texts:
        for i, x in enumerate(texts):
            for j, y in enumerate(texts[:i]):
                if simhash.jaccard(x or "", y or "") >= 0.8:
                    root[i] = root[j] = min(root[i], root[j])
    kept = sorted(r.doc_id for r in simhash.keep_one(docs_of(spark, texts).coalesce(1).withColumn("row_mark", F.lit(1))).collect())
    assert kept == sorted(set(root))
    assert simhash.keep_one(docs_of(spark, []).limit(0)).count() == 0


def groups_of(texts):
    """The least place of each group of texts that links of 0.8 connect, by all pairs."""
    sets, root = [simhash.five_words(t) for t in texts], list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if len(x & y) >= 0.8 * len(x | y):
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    return {top(i) for i in range(len(texts))}


def test_keep_one_links_variants_through_a_base_in_the_middle(spark):
    rng = random.Random(21)
    base = words(rng, 200).split()
    texts = []
    for i in range(300):  # each variant is near the base, few variants are near each other
        own = list(base)
        for at in rng.sample(range(5, 195, 10), 4):
            own[at] = f"v{i}x{at}"
        texts.append(" ".join(own))
    texts.insert(150, " ".join(base))
    kept = {r.doc_id for r in simhash.keep_one(docs_of(spark, texts).coalesce(1)).collect()}
    assert kept == groups_of(texts) == {0}


def test_pairs_at_the_rule_are_never_ruled_out(spark):
    rng = random.Random(22)
    pairs = []
    for i in range(300):  # a tail that leaves 0.8 just reached; some with a passage repeated many times
        x = words(rng, 200)
        tail = words(rng, 48)
        pairs.append((x, f"{x} {tail}"))
    far = [(x, y) for x, y in pairs if (simhash.fingerprint(x) ^ simhash.fingerprint(y)).bit_count() > 14]
    x = words(rng, 250)
    far.append((x, x + f" {words(rng, 9)}" * 40))
    assert all(simhash.jaccard(x, y) >= 0.8 for x, y in [*pairs, *far]) and len(far) > 2
    for x, y in [*pairs, *far]:
        a, b = simhash.shingles(x), simhash.shingles(y)
        sizes = np.array([len(a)]), np.array([len(b)])
        assert simhash.may_link(sizes[0], simhash.sketch_of(a)[None], sizes[1], simhash.sketch_of(b)[None], 0.8).all()
    kept = {r.doc_id for r in simhash.keep_one(docs_of(spark, [t for p in far for t in p]).coalesce(1)).collect()}
    assert kept == set(range(0, 2 * len(far), 2))


def test_near_copies_of_the_pipeline_follow_fingerprints_and_verified_links(spark):
    rng, texts = random.Random(31), []
    while len(texts) < 8:  # long repeats and different ends: fingerprints at most 3 bits apart, sets of five words half the same
        body = words(rng, 40)
        x, y = (" ".join([body] * 8) + " " + words(rng, 20) for _ in "xy")
        if (simhash.fingerprint(x) ^ simhash.fingerprint(y)).bit_count() <= 3:
            texts += [x, y]
    texts += [f"{texts[1]} {words(rng, 12)}", *(words(rng, 400) for _ in range(6))]
    texts += [f"{t} {words(rng, 90)}" for t in texts[-3:]] + [texts[0].upper(), None, ""]  # tails: bits far apart, sets just above 0.8

    def linked(x, y, by_bits):
        bits = (simhash.fingerprint(x) ^ simhash.fingerprint(y)).bit_count()
        return simhash.jaccard(x, y) >= 0.8 or (by_bits and bits <= 3)

    def least(by_bits):
        root, own = list(range(len(texts))), [t or "" for t in texts]
        for _ in texts:
            for i, x in enumerate(own):
                for j, y in enumerate(own[:i]):
                    if root[i] != root[j] and linked(x, y, by_bits):
                        root[i] = root[j] = min(root[i], root[j])
        return set(root)

    kept = {r.doc_id for r in corpus_pipeline.near_copies(spark, docs_of(spark, texts).coalesce(1), "").collect()}
    assert kept == least(True) < least(False)


def test_block_pairs_cut_a_hot_shard_without_loss(spark):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, 100, dtype=np.uint64)
    sets = [np.r_[base[rng.random(100) < 0.93], rng.integers(0, 2**63, 4, dtype=np.uint64)] for _ in range(60)]
    rows = [(i, len(x), bytearray(simhash.sketch_of(x).tobytes()), 7, i % 20) for i, x in enumerate(sets)]
    table = spark.createDataFrame(rows, "id long, n long, sketch binary, shard long, root long")
    got = {(r.a, r.b) for r in simhash.block_pairs(table, 0.8, limit=8).collect()}
    alike = {(i, j) for i in range(60) for j in range(i) if i % 20 != j % 20 and len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j]))}
    assert alike and alike <= got and all(i > j and i % 20 != j % 20 for i, j in got)


def test_block_pairs_of_one_block_alone_in_its_task(spark):
    x = np.arange(100, dtype=np.uint64) << np.uint64(7)
    rows = [(i, 100, bytearray(simhash.sketch_of(x).tobytes()), 7, i) for i in range(3)]
    table = spark.createDataFrame(rows, "id long, n long, sketch binary, shard long, root long")
    assert {(r.a, r.b) for r in simhash.block_pairs(table, 0.8).collect()} == {(1, 0), (2, 0), (2, 1)}
    assert len(simhash.words_of([])) == 0


def shuffled(spark, job):
    """Bytes written to shuffles by ``job``."""
    store, empty = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._jvm.java.util.ArrayList()
    quantiles = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)
    stages = lambda: store.stageList(empty, False, False, quantiles, empty)
    last = max((s.stageId() for s in map(stages().apply, range(stages().size()))), default=-1)
    got = job()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(60_000)
    found = stages()
    return got, sum(s.shuffleWriteBytes() for s in map(found.apply, range(found.size())) if s.stageId() > last)


def test_keep_one_does_not_shuffle_texts_that_are_in_no_pair(spark):
    rng, own = np.random.default_rng(8), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    texts = [" ".join(f"{w:x}" for w in rng.integers(0, 2**60, 600)) for _ in range(300)]
    texts += [f"{t} tail {i}" for i, t in enumerate(texts[:5])] + texts[7:9]
    docs = docs_of(spark, texts).withColumns({"bits": F.col("doc_id"), "block": F.col("doc_id")})
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with tables that are too large to broadcast
    try:
        kept, moved = shuffled(spark, lambda: {r.doc_id for r in simhash.keep_one(docs, radius=3).collect()})
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", own)
    assert kept == set(range(300))
    assert moved < sum(map(len, texts)) / 2


@pytest.mark.parametrize("limit", [4096, 0])
def test_rows_among_bitmaps(spark, limit):
    ids = [0, 1, 7, 8, 32_767, 32_768, 32_769, 65_536, 1 << 33, (1 << 33) + 5, (3 << 33) + 32_768]
    asked = spark.createDataFrame([(i,) for i in [*ids, 7]], "id long")
    rows = spark.createDataFrame([(i + d, "x") for i in ids for d in (0, 1, 2, 32_768)], "id long, own string")
    got = sorted(r.id for r in simhash.among(rows, simhash.bitmaps(asked, limit)).collect())
    assert got == sorted(r.id for r in rows.collect() if r.id in ids)


def test_components_of_a_long_chain(spark):
    edges = spark.range(1, 200).select(F.col("id").alias("a"), (F.col("id") - 1).alias("b"))
    assert {r.root for r in simhash.components(edges).collect()} == {0}


def test_myers_matches_the_table():
    rng = random.Random(1)
    for _ in range(60):
        item, text = ("".join(rng.choice("abc") for _ in range(n)) for n in (rng.randint(1, 12), rng.randint(0, 30)))
        row = [0] * (len(text) + 1)
        for i, c in enumerate(item, 1):
            new = [i]
            for j, d in enumerate(text, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
            row = new
        assert decontaminate.myers(item, text) == min(row)


def test_edited_items_are_found_and_clean_rows_stay(spark):
    rng = random.Random(2)
    item = words(rng, 40)
    edited = item[:60] + "zz" + item[62:120] + item[122:]
    docs = docs_of(spark, [words(rng, 50) + " " + edited + " " + words(rng, 9), words(rng, 100), None, "", item.upper()])
    bench = spark.createDataFrame([(7, item), (8, None), (9, "tiny")], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.found_items(docs, bench).collect()} == {(0, 7), (4, 7)}
    assert {r.doc_id for r in decontaminate.without_items(docs, bench).collect()} == {1, 2, 3}
    assert decontaminate.found_items(docs, bench.limit(0)).count() == 0


def test_repeated_words_match_brute_force():
    rng = random.Random(4)
    for _ in range(50):
        ws = [rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randint(0, 30))]
        windows = [tuple(ws[i : i + 5]) for i in range(len(ws) - 4)]
        want = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)}
        assert quality.repeated_words(ws) == len(want)


def test_quality_keeps_clean_and_drops_junk(spark):
    rng = random.Random(6)
    clean = [words(rng, 80) + "." for _ in range(30)]
    junk = [" ".join(w.upper() + "$$$" for w in words(rng, 60).split()) for _ in range(8)]
    got = {r.doc_id: r for r in quality.quality(docs_of(spark, [*clean, *junk, None, ""])).collect()}
    assert all(got[i].kept for i in range(30)) and not any(got[i].kept for i in range(30, 40))
    assert got[38].n_words == 0 and got[38].base_failed


def test_personal_data(spark):
    text = "write to a.b@mail.example.com or 10.0.0.256 10.0.0.25 now, +1 (743) 555-3824, 4111 1111 1111 1111."
    found = [(pii.KINDS[k], text[a:b]) for a, k, b in pii.base_spans(text)]
    assert found == [("email", "a.b@mail.example.com"), ("ip", "10.0.0.25"), ("phone", "+1 (743) 555-3824"), ("card", "4111 1111 1111 1111")]
    docs = docs_of(spark, [text, None, "", "plain words only", 'the token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" here'])
    clean = {r.doc_id: r.text for r in pii.without_personal_data(docs).collect()}
    assert "<EMAIL>" in clean[0] and "a.b@" not in clean[0] and clean[1] is None and clean[3] == "plain words only"
    assert "24be" not in clean[4]


def test_field_on_held_out_words():
    field = pii.default_field()
    rows = {}
    for s, _, w, t in pii.labelled_words(seed=99, stretches=160):
        rows.setdefault(s, []).append((w, t))
    texts = [" ".join(w for w, _ in seq) for seq in rows.values()]
    want = [{t for _, t in seq} - {"O"} for seq in rows.values()]
    got = [{pii.KINDS[k] for _, k, _ in spans} for spans in pii.Decoder(field).spans(texts)]
    assert sum(a == b for a, b in zip(got, want)) / len(want) > 0.9


def test_urls(spark):
    rows = [(1, "http://a.Example.org/es/1"), (2, "x://example.org/en/12#y"), (3, None), (4, "no"), (5, "http://b.com/fr/1"), (6, "https://www.c.net/a.html?utm_source=f"), (7, "http://c.net/a/"), (7, "http://c.net/b")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    got = sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in urls.judge_urls(pages, urls.tracked(pages)).collect() if r.page_id != 7)
    assert [(g[0], g[4]) for g in got] == [(1, "block"), (2, "block"), (3, "allow"), (4, "allow"), (5, "allow"), (6, "block")]
    assert got[0][1:4] == ("a.example.org", "/es/1", "example.org/es/") and got[2][1:4] == ("", "", None)


def test_licences(spark):
    docs = docs_of(spark, ["some words\nReleased under the MIT License.\nmore", "Licensed under the Apache License, Version 2.0.", "a license to drive the car", None, ""])
    got = {(r.doc_id, r.paragraph, r.family, r.confirmed) for r in licences.licence_paragraphs(docs).collect()}
    assert got == {(0, 1, "mit", True), (1, 0, "apache", True)}


def test_tool_calls(spark):
    calls = spark.createDataFrame([("a", None, "ask", '{"words": 1, "chars": 2}'), ("b", "a", "ask", '{"chars": 2}'), ("c", "b", "none", "{}"), ("x", "y", "ask", "{}"), ("y", "x", "ask", "{}"), ("a", None, "ask", '{"words": 1, "chars": 2}')], "call_id string, after string, name string, arguments string")
    results = spark.createDataFrame([("a", "r"), ("z", "s")], "call_id string, content string")
    got = {r.call_id: r for r in tool_calls.link_calls(calls, results).collect()}
    assert [got[c].place for c in "abcxy"] == [0, 1, 2, None, None]
    assert got["a"].is_valid and got["a"].has_result and got["a"].n_calls == 2 and not got["b"].is_valid and not got["c"].is_valid
    assert '"arguments":{"chars":"2","words":"1"}' in got["a"].json


def test_canonical_calls_keep_types_and_sort_every_level(spark):
    one = '{"b": {"y": [true, null, {"q": 1, "p": "2"}], "x": 12345678901234567890123456789012345678901.5}, "a": 2}'
    two = '{"a": 2, "b": {"x": 12345678901234567890123456789012345678901.5, "y": [true, null, {"p": "2", "q": 1}]}}'
    arguments = [one, two, '{"a": 2}', '{"a": "2"}', '{"a": 1, "a": 2}', "no json {", None]
    calls = spark.createDataFrame([(str(i), None if i else "x", "ask", a) for i, a in enumerate(arguments)], "call_id string, after string, name string, arguments string")
    results = spark.createDataFrame([("0", 'r"')], "call_id string, content string")
    got = {int(r.call_id): r.canonical for r in tool_calls.link_calls(calls, results).collect()}
    whole = '{"a":2,"b":{"x":12345678901234567890123456789012345678901.5,"y":[true,null,{"p":"2","q":1}]}}'
    assert got[0] == '{"after":"x","arguments":%s,"id":"0","name":"ask","place":0,"result":"r\\""}' % whole
    inside = ["", whole, '{"a":2}', '{"a":"2"}', '{"a":1,"a":2}', '"no json {"']
    assert all(got[i] == '{"arguments":%s,"id":"%d","name":"ask","place":0}' % (inside[i], i) for i in range(1, 6))
    assert got[6] == '{"id":"6","name":"ask","place":0}'


def test_cutting_stock_holds_the_demand():
    demand = {3: 50, 5: 40, 9: 11, 10: 3}
    held = {}
    for times, pattern in cutting_stock(demand, 10):
        assert sum(s * c for s, c in pattern.items()) <= 10
        for s, c in pattern.items():
            held[s] = held.get(s, 0) + times * c
    assert held == demand


def test_short_items_count_as_they_are_between_word_borders(spark):
    bench = spark.createDataFrame([(1, "What is the capital of Peru?"), (2, "ok"), (3, "!?"), (4, None)], "item_id long, text string")
    docs = docs_of(spark, ["So: what is THE capital, of Peru", "what is the capital of Perugia", "What is a capital of Peru?", "book", "it is ok.", "", None])
    got = {(r.doc_id, r.item_id, r.distance) for r in decontaminate.found_items(docs, bench).collect()}
    assert got == {(0, 1, 0), (4, 2, 0)}
