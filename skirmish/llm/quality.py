"""Weak supervision for text quality: rules vote or abstain, EM learns how far each can be trusted.

Every rule says 1 (good), -1 (bad) or 0 (no opinion). All a model of independent rules needs from the corpus is how
often each pattern of votes occurs: at most ``3 ** rules`` counts, whatever the number of documents. EM runs on these,
and each document gets the posterior of its pattern.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skirmish.llm.common import whole_text
from skirmish.session import small_table, stage

SYMBOLS = re.compile(r"[#*$%&|<>]")
MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_caps long, n_stops long, n_letters long"
RULES = ("length", "symbols", "capitals", "repeats", "lines", "word_length", "letters")
HOLDS = np.array([0.75, 0.9, 0.9, 0.85, 0.75, 0.75, 0.9])  # where EM starts: the share of right votes of each rule


def repeated_words(words: list[bytes], window: int = 5) -> int:
    """How many words lie in a window of words that the text holds at least twice."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    seen: dict[bytes, int] = {}
    code = np.array([seen.setdefault(w, len(seen)) for w in words], dtype=np.int64)
    kind = code[:n].copy()
    for i in range(1, window):  # pairs of (kind so far, next word), numbered anew each time
        kind = np.unique(kind * len(seen) + code[i : n + i], return_inverse=True)[1]
    twice = np.flatnonzero(np.bincount(kind)[kind] > 1)
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, twice, 1)
    np.add.at(change, twice + window, -1)
    return int((np.cumsum(change)[:-1] > 0).sum())


def measures_of(text: str) -> tuple[int, ...]:
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    word_chars = sum(map(len, words)) if text.isascii() else len(b"".join(words).decode("utf-8", "surrogatepass"))
    seen, double = set(), 0
    for line in raw.split(b"\n"):
        if line.strip(b" \t\n\r\x0b\x0c"):
            double += line in seen
            seen.add(line)
    caps = sum(w.isupper() for w in text.split())
    letters = sum(map(str.isalpha, text))
    stops = raw.count(b".") + raw.count(b"!") + raw.count(b"?")
    return len(words), word_chars, len(SYMBOLS.findall(text)), double, repeated_words(words), caps, stops, letters


def measures(texts: Column) -> Column:
    @F.pandas_udf(MEASURES)
    def measure(texts: pd.Series) -> pd.DataFrame:
        names = [m.split()[0] for m in MEASURES.split(", ")]
        return pd.DataFrame([measures_of(t) for t in texts], columns=names, dtype="int64")

    return measure(texts)


def votes() -> dict[str, Column]:
    """Each rule's vote from the measures of a document."""
    n, share = F.col("n_words"), lambda c: F.col(c) / F.greatest(F.col("n_words"), F.lit(1))
    mean = share("word_chars")
    vote = lambda bad, good: F.when(bad, -1).when(good, 1).otherwise(0)
    return {
        "length": vote(n < 10, n >= 30),
        "symbols": vote(share("n_symbols") > 0.2, share("n_symbols") < 0.05),
        "capitals": vote(share("n_caps") > 0.4, share("n_caps") < 0.15),
        "repeats": vote(share("n_repeat_words") > 0.2, share("n_repeat_words") < 0.1),
        "lines": vote(F.col("n_dup_lines") >= 3, F.col("n_dup_lines") == 0),
        "word_length": vote((mean < 2.5) | (mean > 15), mean.between(3, 10)),
        "letters": vote(F.col("n_letters") < 0.6 * F.col("word_chars"), F.col("n_letters") > 0.8 * F.col("word_chars")),
    }


def fit(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100, strength: float = 0.02) -> tuple[np.ndarray, np.ndarray, float]:
    """EM over vote patterns; returns each pattern's posterior of good, and P(vote | class) as (rule, class, vote + 1).

    Abstaining is a vote of its own. The start, with a weight of ``strength`` of all documents, stays as a prior, so that
    the two classes cannot change places and a rule that never votes keeps a defined table.
    """
    rules, total = patterns.shape[1], max(float(counts.sum()), 1.0)
    start = np.zeros((rules, 2, 3))
    for r, right in enumerate(HOLDS[:rules]):
        start[r, 1], start[r, 0] = ((1 - right) * 0.8, 0.2, right * 0.8), (right * 0.8, 0.2, (1 - right) * 0.8)
    table, good = start.copy(), 0.8
    posterior = np.zeros(len(patterns))
    for _ in range(rounds):
        logs = np.log(table)
        score = np.stack([logs[np.arange(rules), c, patterns + 1].sum(axis=1) for c in (0, 1)], axis=1) + np.log([1 - good, good])
        before, posterior = posterior, 1 / (1 + np.exp(np.clip(score[:, 0] - score[:, 1], -500, 500)))
        if np.abs(before - posterior).max(initial=0) < 1e-9:
            break
        for c, weight in ((1, counts * posterior), (0, counts * (1 - posterior))):
            for v in (0, 1, 2):
                table[:, c, v] = (weight[:, None] * (patterns + 1 == v)).sum(axis=0) + strength * total * start[:, c, v]
        table /= table.sum(axis=2, keepdims=True)
        good = float(np.clip((counts @ posterior + strength * total * 0.8) / (total * (1 + strength)), 0.01, 0.99))
    return posterior, table, good


def quality(docs: DataFrame, threshold: float = 0.5, carry: bool = False, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id``, the measures, ``base_failed``, ``posterior`` and ``kept`` for each row (``carry``: all columns of docs too,
    in a struct ``row``).

    A null text has no words and fails; a null id, repeated rows and ties each keep their row; other columns are not
    read unless carried; an empty table gives no rows. Counts of vote patterns cover all documents.
    """
    names = [m.split()[0] for m in MEASURES.split(", ")]
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_column).alias("doc_id"), measures(whole_text(text_column)).alias("m"))
    measured = rows.select(*(["row"] if carry else []), "doc_id", *[F.col(f"m.{n}") for n in names])
    voted = measured.withColumns({f"vote_{k}": v.cast("int") for k, v in votes().items()})
    code = sum((F.col(f"vote_{k}") + 1) * 3**i for i, k in enumerate(RULES))
    voted = stage(voted.withColumn("pattern", code.cast("int")), "votes")
    got = voted.groupBy("pattern").count().collect()  # 3 ** 7 rows at most
    codes, counts = np.array([r[0] for r in got], dtype=np.int64), np.array([r[1] for r in got], dtype=np.float64)
    patterns = np.stack([codes // 3**i % 3 - 1 for i in range(len(RULES))], axis=1) if len(codes) else np.zeros((0, len(RULES)), np.int64)
    posterior, _, _ = fit(patterns, counts)
    known = small_table(docs.sparkSession, list(zip(codes.tolist(), posterior.tolist())), "pattern int, posterior double")
    judged = voted.join(F.broadcast(known), "pattern")  # bounded by the patterns
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return (
        judged.withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & (F.col("posterior") > threshold))
        .select(*(["row"] if carry else []), "doc_id", *names[:5], "base_failed", "kept", "posterior", *[f"vote_{k}" for k in RULES])
    )
