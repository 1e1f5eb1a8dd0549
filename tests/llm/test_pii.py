"""The field on whole texts: cut lines against uncut ones, tables written by hand, whole rows, odd input."""

import hashlib
import random
import re

import numpy as np
import pytest

from skirmish.llm import pii

COLUMNS = "doc_id long, text string, found string, redacted string, n_chars long"


@pytest.fixture(scope="module")
def field():
    return pii.default_field()


def uncut_tags(field, line):
    """Best tags of a whole line by plain Viterbi over all of its words."""
    words = pii.WORD.findall(line)
    parts = [field.emissions(w) for w in words]
    emit = np.array([p[0] for p in parts])
    for i in range(1, len(words)):
        emit[i] += parts[i - 1][1]
        emit[i - 1] += parts[i][2]
    score, back = emit[0], []
    for row in emit[1:]:
        step = score[:, None] + field.moves
        back.append(step.argmax(axis=0))
        score = step.max(axis=0) + row
    tags = [int(score.argmax())]
    for b in reversed(back):
        tags.append(int(b[tags[-1]]))
    return tags[::-1]


def uncut_spans(field, text):
    out, at = [], 0
    for line in text.split("\n"):
        places = [m.span() for m in pii.WORD.finditer(line)]
        tags = uncut_tags(field, line) if places else []
        i = 0
        while i < len(tags):
            j = i
            while j < len(tags) and tags[j] == tags[i]:
                j += 1
            held = line[places[i][0] : places[j - 1][1]]
            core = held.strip(pii.EDGE)
            if tags[i] and core:
                start = at + places[i][0] + held.find(core)
                out.append((start, tags[i] - 1, start + len(core)))
            i = j
        at += len(line) + 1
    return sorted(out)


def test_cut_lines_give_the_tags_of_whole_lines(field):
    rng = random.Random(4)
    pool = [w for _, _, w, _ in pii.labelled_words(seed=31, stretches=120)] + ["字字字", "ßß", "É", "tokenKEY", "", "٣٤", "a" * 500]
    texts = ["".join(rng.choice(pool) + rng.choice([" ", " ", " ", "\n", "\t"]) for _ in range(rng.randint(0, 300))) for _ in range(40)]
    decoder = pii.Decoder(field, block=200, words=50)  # many blocks, a small memory of words
    assert [sorted(s) for s in decoder.spans(texts)] == [uncut_spans(field, t) for t in texts]


BY_HAND = [  # text, kind, what is to be found
    ('the key = "qzkwrtpxvbnmlkjhgfdsaqwrtypsdfghjklzxcv" for the build', "secret", "qzkwrtpxvbnmlkjhgfdsaqwrtypsdfghjklzxcv"),
    ("Her password is RkTzQpWmXvBnLsDfGhJkPqRtWz today", "secret", "RkTzQpWmXvBnLsDfGhJkPqRtWz"),
    ("token: 9f86d081884c7d659a2feaa0c55ad015a3bf4f1b, do not share", "secret", "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"),
    ("set secret = d41d8cd98f00b204e9800998ecf8427e and restart", "secret", "d41d8cd98f00b204e9800998ecf8427e"),
    ("call (415) 555-0132 after noon", "phone", "(415) 555-0132"),
    ("my number is 212-555-0199.", "phone", "212-555-0199"),
    ("paid with 4000 1234 5678 9010 in June", "card", "4000 1234 5678 9010"),
    ("card 5500000000000005 expired", "card", "5500000000000005"),
]
CLEAN = [
    "The treaty was signed in 1848 after two years of war.",
    "Donaudampfschifffahrtsgesellschaft is a famous long word",
    "see https://www.example.org/articles/history-of-tea-1900.html for more",
    "Version 2.10 of the library came out, and 35% of users moved.",
    "a state-of-the-art, well-thought-out, never-to-be-forgotten plan",
    "==================================================",
    "The key to success is patience. The secret is work.",
    "set max_number_of_open_files to 1024",
    "Chapter 12\nNothing\nIn the end",
    "internationalization and counterrevolutionaries met",
]


def test_field_on_lines_written_by_hand(field):
    decoder = pii.Decoder(field)
    got = decoder.spans([t for t, _, _ in BY_HAND])
    hits = sum((text.index(what), pii.KINDS.index(kind), text.index(what) + len(what)) in spans for (text, kind, what), spans in zip(BY_HAND, got))
    assert hits >= 7, [(t, [t[a:b] for a, _, b in s]) for (t, _, _), s in zip(BY_HAND, got)]
    false = [(t, [t[a:b] for a, _, b in s]) for t, s in zip(CLEAN, decoder.spans(CLEAN)) if s]
    assert len(false) <= 1, false


def test_recall_and_precision_by_kind_on_held_out_stretches(field):
    rows = {}
    for s, _, w, t in pii.labelled_words(seed=123, stretches=440):
        rows.setdefault(s, []).append((w, t))
    texts = [" ".join(w for w, _ in seq) for seq in rows.values()]
    want = [{t for _, t in seq} - {"O"} for seq in rows.values()]
    got = [{pii.KINDS[k] for _, k, _ in spans} for spans in pii.Decoder(field).spans(texts)]
    for kind in pii.KINDS:
        both = sum(kind in w and kind in g for w, g in zip(want, got))
        assert both >= 0.9 * sum(kind in w for w in want), kind
        assert both >= 0.9 * sum(kind in g for g in got), kind


def plain_base(text):
    """The base rules as they are stated, one search a kind."""
    spans = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    spans += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m.group() if c.isdigit()][::-1]
        if 14 <= len(digits) <= 19 and (sum(digits[::2]) + sum(sum(divmod(2 * d, 10)) for d in digits[1::2])) % 10 == 0:
            spans.append((m.start(), 2, m.end()))
    spans += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= sum(c.isdigit() for c in m.group()) <= 15]
    return sorted(spans)


def test_rows_match_the_stated_rules(spark):
    rng = random.Random(8)
    pieces = ["a@b.c", "x.y+z@host-1.example.org", "@", ".", "10.0.0.1", "256.1.1.1", "1.2.3.4.5", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (743) 555-3824", "+12", " ", "\n", "é", "7", "word", "@b", "%"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 25))) for _ in range(300)] + [None, "", "x" * 10_000, "1" * 5_000, ("word " * 60_000) + "a@b.c", 'the key = "qzkwrtpxvbnmlkjhgfdsaqwrtypsdfghjklzxcv"']
    rows = [(i, t, "clash", "clash", 0) for i, t in enumerate(texts)] + [(0, texts[0], "clash", "clash", 0), (None, "a@b.c", None, None, None)]
    out = pii.personal_data(spark.createDataFrame(rows, COLUMNS)).collect()
    assert len(out) == len(rows) and sum(r.doc_id == 0 for r in out) == 2 and sum(r.doc_id is None for r in out) == 1
    for r in out:
        text = "a@b.c" if r.doc_id is None else texts[r.doc_id] or ""
        base = plain_base(text)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for _, k, _ in base) for kind in range(4)]
        assert r.base_sha256 == hashlib.sha256(pii.written(base).encode()).hexdigest()
        spans = r.spans.split(",") if r.spans else []
        assert set(filter(None, pii.written(base).split(","))) <= set(spans) and r.n_added == len(spans) - len(base)
        assert [r[f"all_{k}"] for k in pii.KINDS] == [sum(s.startswith(f"{k}:") for s in spans) for k in pii.KINDS]
    assert max(r.all_secret for r in out) == 1


def test_empty_table_and_clashing_names(spark):
    empty = spark.createDataFrame([], COLUMNS)
    assert pii.personal_data(empty).count() == 0 and pii.without_personal_data(empty).count() == 0
    docs = spark.createDataFrame([(1, "to a@b.c now", "f", "r", 12), (2, None, "f", "r", 5)], COLUMNS)
    got = {r.doc_id: r for r in pii.without_personal_data(docs).collect()}
    assert got[1].asDict() == {"doc_id": 1, "text": "to <EMAIL> now", "found": "f", "redacted": "r", "n_chars": 14}
    assert got[2].text is None and got[2].n_chars == 5
