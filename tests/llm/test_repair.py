"""Conversation repair against a search over all edits."""

import hashlib
import random
import re
import zlib
from heapq import heappop, heappush

import pytest

from skirmish.llm.repair import Rope, cheapest, less, repair_report

ROWS = "conv_id long, turn long, role string, text string"
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}


def search(symbols):
    """Cheapest, then least audit by exhaustive best-first search over (row, state)."""
    seen, heap = {}, [(0, "", 0, 0)]
    while heap:
        cost, audit, row, state = heappop(heap)
        if row == len(symbols) and state in (0, 3):
            return cost, audit
        if seen.get((row, state, cost), 0) > 60:
            continue
        seen[(row, state, cost)] = seen.get((row, state, cost), 0) + 1
        for role in "ua":
            if (state, role) in STEP:
                heappush(heap, (cost + 5, audit + "I", row, STEP[state, role]))
        if row < len(symbols):
            s = symbols[row]
            heappush(heap, (cost + 2, audit + "D", row + 1, state))
            if s != "x":
                extra = 5 if s.isupper() else 0
                if (state, s.lower()) in STEP:
                    heappush(heap, (cost + extra, audit + "K", row + 1, STEP[state, s.lower()]))
                for role in "ua":
                    if (state, role) in STEP:
                        heappush(heap, (cost + 1 + extra, audit + "R", row + 1, STEP[state, role]))


def brute(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        kept = []
        for _, turn, role, text in [r for r in rows if r[0] == conv]:
            role, text = role if role is not None else " ", text if text is not None else " "
            h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            if h == 0:
                continue
            text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
            kept += [(turn, "user" if h == 4 else role, text)] * (2 if h == 3 else 1)
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        turns = [r[0] for r in kept if r[0] is not None]
        seen, faults = set(), ""
        for _, role, text in kept:
            bare = text.strip(SPACE)
            faults += "b" if not bare else "d" if (role, text) in seen else "." if bare[-1] in ".!?" else "t"
            seen.add((role, text))
        initials = [r[1][:1] for r in kept]
        symbols = "".join("x" if f in "bd" else (i if i in ("s", "u", "a") else "o").upper() if f == "t" else i if i in ("s", "u", "a") else "o" for i, f in zip(initials, faults))
        cost, audit = search(symbols)
        lines, row, state = [], 0, 0
        for e in audit:
            if e == "K":
                lines.append(kept[row][1] + ":" + kept[row][2])
                state = STEP[state, kept[row][1][0]]
            elif e in "RI":
                role = "u" if (state, "u") in STEP else "a"
                state = STEP[state, role]
                lines.append({"u": "user", "a": "assistant"}[role] + ":" + (kept[row][2] if e == "R" else ""))
            row += e != "I"
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def got(df, **kw):
    cols = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    rows = repair_report(df, **kw).collect()
    found = {r.conv_id: tuple(r[c] for c in cols) for r in rows}
    assert len(found) == len(rows)
    return found


def test_cheapest_matches_search():
    rng = random.Random(4)
    texts = ["".join(rng.choice("suaoSUAOx") for _ in range(rng.randint(0, 9))) for _ in range(600)] + ["ua" * 40 + "uuxa" * 3, "x" * 50, "s", ""]
    for text, best in cheapest(texts).items():
        assert best == search(text), text


def test_ropes_compare_like_texts():
    rng = random.Random(5)
    for _ in range(300):
        ropes = []
        for _ in range(2):
            rope = Rope(rng.choice(["DK", "DKI", "D"]))
            for _ in range(rng.randint(0, 6)):
                rope = Rope("", rope, Rope(rng.choice(["D", "K", "DK"]))) if rng.random() < 0.5 else Rope("", Rope(rng.choice(["D", "DK"])), rope)
            ropes.append(rope)
        assert less(*ropes) == (str(ropes[0]) < str(ropes[1]))


@pytest.mark.parametrize("most_rows", [1024, 3])
def test_against_search(spark, most_rows):
    rng = random.Random(6)
    said = ["Yes.", "No", "a b!", "why?  \n", " \t", "", None, "long " * 300 + "end."]
    rows = []
    for conv in range(120):
        for turn in range(rng.choice([1, 2, 4, 7, 12])):
            role = rng.choice(["user", "assistant", "system", "tool", "", None]) if rng.random() < 0.3 else ["user", "assistant"][turn % 2]
            rows.append((conv, None if rng.random() < 0.05 else turn + rng.choice([0, 0, 0, 5]), role, rng.choice(said) if rng.random() < 0.4 else f"t{turn}x{rng.random()}."))
    rows += [(500, t % 3, "user", "same.") for t in range(40)] + [(None, 1, "user", "Hi."), (None, 2, "assistant", "Ho.")]
    rows += rows[:5]
    assert got(spark.createDataFrame(rows, ROWS).repartition(3), parts=5, most_rows=most_rows) == brute(rows)


def test_all_dropped_empty_and_clashing_columns(spark):
    turn = next(t for t in range(1000) if zlib.crc32(f"1:{t}".encode()) % 20 == 0)
    rows = [(1, turn, "user", "x")]
    assert got(spark.createDataFrame(rows, ROWS)) == {1: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert repair_report(spark.createDataFrame([], ROWS)).count() == 0
    more = spark.createDataFrame([(2, 0, "user", "Hi.", "k", 1), (2, 1, "assistant", "Ho.", "k", 1)], ROWS + ", key string, place int")
    assert got(more) == brute([(2, 0, "user", "Hi."), (2, 1, "assistant", "Ho.")])
