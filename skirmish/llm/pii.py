"""Personal data: rules for four kinds, and a linear-chain conditional random field over word shapes for what they miss.

The field is trained on the driver from a small labelled table (by default ``labelled_words``, some thousand words made
from a rule) and decoded by Viterbi over every line of a text, in numpy and many stretches at a time. Where the weights
prove that a word is tagged ``O`` whatever stands around it, the line is cut there with the moves from and to ``O`` kept,
so the best tags are those of the uncut line. A span of the field that touches a rule's span gives way.
"""

from __future__ import annotations

import functools
import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skirmish.llm.common import free_name, in_slices, whole_text

KINDS = ("email", "ip", "card", "phone", "secret")  # the first four have rules
TAGS = ("O", *KINDS)
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")  # a match can only begin where a run of digits begins
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")
WORD = re.compile(r"[^\x20\x09-\x0d]+")
CONSONANTS = re.compile("[bcdfghjklmnpqrstvwxzBCDFGHJKLMNPQRSTVWXZ]+")
JUMP = re.compile("[a-z][A-Z]|[A-Za-z][0-9]|[0-9][A-Za-z]")
EDGE = ".,;:!?\"'*#$%&|<>"  # signs around a word that are no part of it
LINE = re.compile("\n")
CUES = ("token", "key", "secret", "password")
CUE = re.compile("|".join(CUES), re.I)


class Outline(dict):
    """For ``str.translate``: one sign for all letters or digits that ``features_of`` takes for the same in short words."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        self[code] = got = "0" if c in "0123456789" else "X" if c.isupper() else "x" if c.islower() else "\u4e00" if c.isalpha() else c
        return got


def emails(text: str) -> list[tuple[int, int]]:
    """Each ``@`` with the run of name signs before it; the run ends at the match before."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at) if start < at else None
        if domain:
            free = domain.end()
            out.append((start, free))
        at = text.find("@", max(at + 1, free))
        free = max(free, 0)
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` by the rules, sorted."""
    spans = [(a, 0, b) for a, b in emails(text)]
    if DIGIT.search(text):
        spans += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
        for m in CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                spans.append((m.start(), 2, m.end()))
        spans += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(DIGIT.findall(m.group())) <= 15]
    return sorted(spans)


# --- word shapes and the field


def shape_of(word: str) -> str:
    """Upper X, lower x, digits d, other letters l, signs themselves; runs of one kind up to four long."""
    out, run = [], 0
    for c in word:
        s = "d" if c in "0123456789" else "X" if c.isupper() else "x" if c.islower() else "l" if c.isalpha() else c
        run = run + 1 if out and out[-1] == s else 1
        if run <= 4:
            out.append(s)
    return "".join(out)


def features_of(word: str) -> tuple[str, ...]:
    core = word.strip(EDGE)
    digits = sum(c in "0123456789" for c in core)
    kinds = [f"shape={shape_of(core)}", f"digits={min(digits, 20) if digits == len(core) else 'some' if digits else 'none'}"]
    kinds += [f"has{s}" for s in "@+=()-./:_" if s in core[1:-1]] + [f"first={shape_of(core[:1])}", f"dots={min(core.count('.'), 4)} {digits > 0}"]
    if len(core) >= 20:
        unbroken = core.isalnum() and core.isascii()
        kinds.append(f"long={min(len(core) // 10, 4)} {unbroken} {digits > 0}")
        if unbroken:  # words can be said, keys can't: long runs of consonants, case that jumps
            vowels = sum(c in "aeiouyAEIOUY" for c in core) * 10 // len(core)
            kinds += [f"vowels={min(vowels, 5)}", f"few={len(set(core)) < 5}"]
            kinds += [f"consonants={min(max(map(len, CONSONANTS.findall(core)), default=0), 7)}", f"jumps={min(len(JUMP.findall(core)), 4)}"]
    elif core.lower() in CUES:
        kinds.append("cue")
    return tuple(kinds)


def labelled_words(seed: int = 7, stretches: int = 660) -> list[tuple[int, int, str, str]]:
    """``(stretch, position, word, tag)``: invented words around one example of a kind, or none."""
    rng = random.Random(seed)
    syllables = ["an", "the", "on", "er", "que", "ch", "ei", "ó", "li", "mar", "den", "tis"]
    said = ["ver", "an", "lung", "scha", "ti", "on", "al", "is", "mo", "ra", "den", "streng", "wort", "in", "ter"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 3)))
    long_word = lambda: "".join(rng.choice(said) for _ in range(rng.randint(6, 14)))
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    drawn = lambda signs, n: "".join(rng.choice(signs) for _ in range(n))
    low, both, hexes = "abcdefghijklmnopqrstuvwxyz", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdef"
    make = {
        "email": lambda: [[f"{word()}.{digits(2)}@{word()}.example.com"], [f"{word()}@{word()}{digits(1)}.org"], [f"{word()}_{word()}@{word()}.net"]],
        "ip": lambda: [[".".join(str(rng.randint(0, 255)) for _ in range(4))]],
        "card": lambda: [[digits(16)], [digits(4) for _ in range(4)], ["-".join(digits(4) for _ in range(4))]],
        "phone": lambda: [[f"+{digits(1)}", f"({digits(3)})", f"{digits(3)}-{digits(4)}"], [f"({digits(3)})", f"{digits(3)}-{digits(4)}"], [f"{digits(3)}-{digits(3)}-{digits(4)}"]],
        "secret": lambda: [[f'"{drawn(hexes, 40)}"'], [drawn(hexes, 32)], [drawn(hexes, 40)], [f'"{drawn(low, rng.randint(24, 48))}"'], [drawn(both, rng.randint(24, 44))], [f'"{drawn(both + "0123456789", rng.randint(24, 64))}"']],
    }
    plain = lambda: [
        [digits(rng.randint(1, 5))], [f"{digits(1)}.{digits(1)}"], [f"{digits(1)}.{digits(1)}."], [f"{digits(1)}.{digits(2)}"], [f"{digits(2)}%"], [f"{word()}{digits(2)}"], [word()],
        [long_word()], [long_word().capitalize()], [f'"{long_word()}"'], ["-".join(word() for _ in range(rng.randint(3, 8)))], ["_".join(word() for _ in range(rng.randint(3, 6)))], [f'"{word()}"'],
        [f"https://{word()}.{word()}.org/{word()}/{word()}-{digits(2)}.html"], ["/".join(word() for _ in range(rng.randint(3, 6)))], [rng.choice("#=*-_") * rng.randint(3, 60)], [rng.choice(low) * rng.randint(20, 60)],
    ]
    rows = []
    for s in range(stretches):
        kind = (*KINDS, "secret", *"OOOOO")[s % (len(KINDS) + 6)]
        tails = ["", "", "", ".", ","] if rng.random() < 0.8 else ["", *(3 * sign for sign in "#*$%&~=")]
        left, right = ([(w.capitalize() if rng.random() < 0.2 else w) + rng.choice(tails) for w in (word() for _ in range(rng.randint(0, 8)))] for _ in range(2))
        middle = rng.choice(make[kind]() if kind != "O" else plain())
        if (kind == "secret" and rng.random() < 0.8) or (kind == "O" and rng.random() < 0.15):
            left += [rng.choice(CUES), rng.choice(["=", ":", "is"])]
        middle[-1] += rng.choice(tails)
        if kind == "O" and rng.random() < 0.4:
            left, middle, right = [], [w.capitalize() if rng.random() < 0.5 else w for w in middle], right[: rng.randint(0, 2)]
        elif kind == "O":
            left.insert(0, rng.choice(["Version", "CC", "BY-NC", "No", word()]))
        words = [(w, "O") for w in left] + [(w, kind) for w in middle] + [(w, "O") for w in right]
        rows += [(s, i, w, t) for i, (w, t) in enumerate(words)]
    return rows


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


class Field:
    """Weights of a linear-chain field: features of the word, of the one before and of the one after; tag to tag."""

    def __init__(self, rows: list[tuple[int, int, str, str]], rounds: int = 120, rate: float = 0.1, decay: float = 1e-3):
        stretches: dict[int, list] = {}
        for s, i, w, t in sorted(rows):
            stretches.setdefault(s, []).append((features_of(w), TAGS.index(t)))
        self.index: dict[str, int] = {}
        for seq in stretches.values():
            for names, _ in seq:
                for f in names:
                    self.index.setdefault(f, len(self.index))
        n, length, k, size = len(stretches), max((len(s) for s in stretches.values()), default=1), len(TAGS), len(self.index)
        hot, tags, mask = np.zeros((n, length + 2, size)), np.zeros((n, length), int), np.zeros((n, length), bool)
        for r, seq in enumerate(stretches.values()):
            for i, (names, t) in enumerate(seq):
                hot[r, i + 1, [self.index[f] for f in names]] = 1
                tags[r, i], mask[r, i] = t, True
        joint = np.concatenate([hot[:, 1:-1], hot[:, :-2], hot[:, 2:]], axis=2)  # this word, before, after
        weights, step = {"w": np.zeros((3 * size, k)), "t": np.zeros((k, k))}, {}
        gold, pairs = np.eye(k)[tags] * mask[..., None], mask[:, 1:, None, None]
        gold_t = (gold[:, :-1, :, None] * gold[:, 1:, None, :]).sum(axis=(0, 1))
        for turn in range(1, rounds + 1):
            emit = joint @ weights["w"]
            alpha, beta = np.zeros_like(emit), np.zeros_like(emit)
            alpha[:, 0] = emit[:, 0]
            for i in range(1, length):
                new = log_sum(alpha[:, i - 1, :, None] + weights["t"], 1) + emit[:, i]
                alpha[:, i] = np.where(mask[:, i, None], new, alpha[:, i - 1])
            for i in range(length - 2, -1, -1):
                new = log_sum(weights["t"] + (emit[:, i + 1] + beta[:, i + 1])[:, None, :], 2)
                beta[:, i] = np.where(mask[:, i + 1, None], new, beta[:, i + 1])
            whole = log_sum(alpha[:, -1], 1)[:, None, None]
            share = np.exp(np.minimum(alpha + beta - whole, 0)) * mask[..., None]
            both = alpha[:, :-1, :, None] + weights["t"] + (emit + beta)[:, 1:, None, :] - whole[..., None]
            both = np.exp(np.minimum(both, 0)) * pairs
            slopes = {"w": joint.reshape(-1, 3 * size).T @ (gold - share).reshape(-1, k), "t": gold_t - both.sum(axis=(0, 1))}
            for name, slope in slopes.items():  # Adam
                slope = slope / max(n, 1) - decay * weights[name]
                m, v = step.get(name, (0.0, 0.0))
                m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
                step[name] = m, v
                weights[name] = weights[name] + rate * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.99**turn)) + 1e-8)
        self.moves, self.parts = weights["t"], weights["w"].reshape(3, size, k)

    def emissions(self, word: str) -> np.ndarray:
        """What a word says of its own tag, of the next word's and of the one before: (3, tags)."""
        known = [self.index[f] for f in features_of(word) if f in self.index]
        return self.parts[:, known].sum(axis=1) if known else np.zeros((3, len(TAGS)))

    def viterbi(self, emit: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Best tags of padded stretches (n, longest, tags), all at once."""
        n, longest, _ = emit.shape
        score, back = emit[:, 0].copy(), np.zeros(emit.shape, np.int8)
        for i in range(1, longest):
            step = score[:, :, None] + self.moves
            back[:, i] = step.argmax(axis=1)
            live = (i < lengths)[:, None]
            score = np.where(live, step.max(axis=1) + emit[:, i], score)
        tags = np.zeros((n, longest), np.int8)
        now = score.argmax(axis=1)
        for i in range(longest - 1, -1, -1):
            now = np.where(i + 1 < lengths, np.take_along_axis(back[:, min(i + 1, longest - 1)], now[:, None], 1)[:, 0], now) if i + 1 < longest else now
            tags[:, i] = np.where(i < lengths, now, 0)
        return tags


@functools.cache
def default_field() -> Field:
    return Field(labelled_words())


class Decoder:
    """Adds the field's spans to texts; every line is decoded, in blocks of lines of about a million signs."""

    def __init__(self, field: Field, block: int = 1_000_000, words: int = 100_000):
        self.field, self.block, self.most = field, block, words
        self.known: dict[str, int] = {}
        self.outline = Outline()
        self.rows = np.zeros((1024, 3, len(TAGS)))
        moves = field.moves
        gain = np.maximum((moves - moves[:, :1]).max(axis=0), 0) + np.maximum((moves - moves[:1]).max(axis=1), 0)
        self.gain = gain[1:]  # the most that another tag than O can win by its moves

    def numbers(self, words: list[str]) -> np.ndarray:
        """Rows of ``self.rows`` of the words; those seen are kept up to a number, which bounds memory only."""
        if len(self.known) > self.most:
            self.known.clear()
        for w in set(words) - self.known.keys():
            n = self.known[w] = len(self.known)
            if n == len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            self.rows[n] = self.field.emissions(w)
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))

    def blocks(self, text: str) -> Iterator[tuple[int, int]]:
        at = 0
        while at < len(text):
            cut = text.find("\n", at + self.block)
            end = len(text) if cut < 0 else cut + 1
            yield at, end
            at = end

    def stretches(self, text: str, at: int, end: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places and emissions of the runs of words that are not proven ``O``, the moves to their borders included."""
        places = np.array([m.span() for m in WORD.finditer(text, at, end)], np.int64).reshape(-1, 2)
        if not len(places):
            return
        keys = WORD.findall(text[at:end].translate(self.outline))
        cues = np.array([m.start() for m in CUE.finditer(text, at, end)], np.int64)
        own = np.union1d(np.flatnonzero(places[:, 1] - places[:, 0] >= 20), np.searchsorted(places[:, 0], cues, "right") - 1)
        for i in own.tolist():
            keys[i] = text[places[i, 0] : places[i, 1]]
        n = self.numbers(keys)
        breaks = np.array([m.start() for m in LINE.finditer(text, at, end)], np.int64)
        line = np.searchsorted(breaks, places[:, 0])
        same = line[1:] == line[:-1]
        emit = self.rows[n, 0]
        emit[1:] += self.rows[n[:-1], 1] * same[:, None]
        emit[:-1] += self.rows[n[1:], 2] * same[:, None]
        unsure = (emit[:, 1:] - emit[:, :1] + self.gain >= -1e-9).any(axis=1)
        joined = unsure[1:] & unsure[:-1] & same
        starts = np.flatnonzero(unsure & np.r_[True, ~joined])
        ends = np.flatnonzero(unsure & np.r_[~joined, True]) + 1
        for a, b in zip(starts.tolist(), ends.tolist()):
            part = emit[a:b].copy()
            if a and same[a - 1]:
                part[0] += self.field.moves[0]
            if b < len(n) and same[b - 1]:
                part[-1] += self.field.moves[:, 0]
            yield places[a:b], part

    def spans(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """``(start, kind, end)`` that the field finds in each text."""
        out: list[list] = [[] for _ in texts]
        jobs, held = [], 0
        for t, text in enumerate(texts):
            for at, end in self.blocks(text):
                for places, emit in self.stretches(text, at, end):
                    jobs.append((t, places, emit))
                    held += len(emit)
                if held > 500_000:
                    self.decode(jobs, texts, out)
                    jobs, held = [], 0
        self.decode(jobs, texts, out)
        return out

    def decode(self, jobs: list, texts: list[str], out: list[list]) -> None:
        jobs.sort(key=lambda j: len(j[2]))
        at = 0
        while at < len(jobs):
            end = at + 1
            while end < len(jobs) and end - at < 4096 and (end + 1 - at) * len(jobs[end][2]) < 200_000:
                end += 1
            group, at = jobs[at:end], end
            lengths = np.array([len(emit) for _, _, emit in group])
            emit = np.zeros((len(group), lengths[-1], len(TAGS)))
            for r, (_, _, part) in enumerate(group):
                emit[r, : len(part)] = part
            tags = self.field.viterbi(emit, lengths)
            for r in np.flatnonzero(tags.any(axis=1)):
                t, places, _ = group[r]
                row = tags[r, : len(places)]
                edges = np.flatnonzero(np.r_[True, row[1:] != row[:-1], True])
                for a, b in zip(edges, edges[1:]):
                    if row[a]:
                        start, stop = int(places[a, 0]), int(places[b - 1, 1])
                        held = texts[t][start:stop]
                        core = held.strip(EDGE)
                        if core:
                            start += held.find(core)
                            out[t].append((start, int(row[a]) - 1, start + len(core)))

    def all_spans(self, texts: list[str]) -> Iterator[tuple[list, list]]:
        """The rules' spans and all spans of each text, sorted."""
        for text, more in zip(texts, self.spans(texts)):
            base = base_spans(text)
            free, i, reach = [], 0, -1
            for span in sorted(more):
                while i < len(base) and base[i][0] < span[2]:
                    reach = max(reach, base[i][2])
                    i += 1
                if reach <= span[0]:
                    free.append(span)
            yield base, sorted(base + free)


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    parts, free = [], 0
    for a, k, b in spans:
        if b <= free:
            continue
        parts += [text[free : max(a, free)], f"<{KINDS[k].upper()}>"]
        free = b
    return "".join([*parts, text[free:]])


FOUND = "struct<n_email: long, n_ip: long, n_card: long, n_phone: long, base_sha256: string, spans: string, n_added: long, all_email: long, all_ip: long, all_card: long, all_phone: long, all_secret: long, redacted: string>"
COLUMNS = ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added", *(f"all_{k}" for k in KINDS))


def marked(docs: DataFrame, labelled: list[tuple[int, int, str, str]] | None, text_column: str, clean: bool):
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(default_field() if labelled is None else Field(labelled))  # some hundred weights

    @F.pandas_udf(FOUND)
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        decoder = Decoder(shared.value)
        for batch in batches:
            rows = []
            for texts in in_slices(batch):
                for text, (base, whole) in zip(texts, decoder.all_spans(texts)):
                    counts = [sum(k == kind for _, k, _ in base) for kind in range(4)]
                    every = [sum(k == kind for _, k, _ in whole) for kind in range(len(KINDS))]
                    digest = hashlib.sha256(written(base).encode()).hexdigest()
                    rows.append((*counts, digest, written(whole), len(whole) - len(base), *every, redacted(text, whole) if clean else None))
            yield pd.DataFrame(rows, columns=[*COLUMNS, "redacted"])

    return find(whole_text(text_column))


def personal_data(docs: DataFrame, labelled: list[tuple[int, int, str, str]] | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id``, counts and digest of the rules' spans, all spans, ``n_added`` by the field and ``all_<kind>`` of both; no shuffle.

    A null text is empty and has no spans; a null id, repeated rows and ties keep a row each; other columns are not
    read; an empty table gives no rows. ``n_email`` to ``n_phone`` count the rules' spans, as ``base_sha256`` covers.
    """
    found = docs.select(F.col(id_column).alias("doc_id"), marked(docs, labelled, text_column, False).alias("f"))
    return found.select("doc_id", *[f"f.{c}" for c in COLUMNS])


def without_personal_data(docs: DataFrame, labelled: list[tuple[int, int, str, str]] | None = None) -> DataFrame:
    """``docs`` with every span replaced by its kind, ``<EMAIL>``, and ``n_chars`` counted anew; a null text stays null."""
    name = free_name(docs, "found")
    found = docs.withColumn(name, marked(docs, labelled, "text", True))
    clean = F.when(F.col("text").isNotNull(), F.col(f"{name}.redacted"))
    out = found.withColumn("text", clean)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
