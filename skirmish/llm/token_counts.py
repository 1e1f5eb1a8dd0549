"""Token counts of whole texts; huge ones by overlapping chunks that are joined where both are proven right."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skirmish.llm.bpe import Encoder, encoder
from skirmish.llm.common import whole_text


def resynchronised_ids(enc: Encoder, text: str, chunk: int = 32_768, overlap: int = 256) -> np.ndarray:
    """The ids of ``text``, made from chunks of ``chunk`` characters that reach ``overlap`` characters into the next.

    A chunk that begins at a true piece boundary cuts as the whole text does, up to ``enc.guard`` characters before its
    own end. The next chunk begins anywhere, so its first boundaries may be wrong; but from a boundary that both have,
    it reads what the whole text reads. The left ids up to that boundary and the right ids from it on are therefore
    the ids of the whole. Where the overlap holds no common boundary it is doubled, up to the whole rest of the text.
    """
    if len(text) <= chunk + overlap:
        return enc.ids(text)
    n, parts = len(text), []
    left, true_from, start = enc.coded(text[: chunk + overlap]), 0, 0
    left_end = chunk + overlap
    while left_end < n:
        start += chunk
        width, right_end = overlap, min(n, start + chunk + overlap)
        right = enc.coded(text[start:right_end], start)
        while True:
            proven = left.bounds[(left.bounds > max(start, true_from)) & (left.bounds <= (left_end if left_end == n else left_end - enc.guard))]
            common = np.intersect1d(proven, right.bounds[1:-1])
            if len(common) or left_end == n:
                break
            width *= 2
            left_end = min(n, start + width)
            left = enc.coded(text[true_from:left_end], true_from)
            if left_end > right_end - overlap:
                right_end = min(n, left_end + chunk)
                right = enc.coded(text[start:right_end], start)
        if not len(common):
            break  # the left chunk now holds the whole rest
        at = int(common[-1])
        a, b = (c.tokens[np.searchsorted(c.bounds, at)] for c in (left, right))
        parts.append(left.ids[_from(left, true_from) : a])
        left, true_from, left_end = right, at, right_end
        start = right_end - overlap - chunk
        assert b == _from(right, at)
    parts.append(left.ids[_from(left, true_from) :])
    return np.concatenate(parts)


def _from(coded, place: int) -> int:
    return int(coded.tokens[np.searchsorted(coded.bounds, place)])


def count_tokens(docs: DataFrame, path: str, limit: int = 1024, chunk: int = 32_768, overlap: int = 256, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for each row of ``docs``; no shuffle, one pass.

    A null text counts as empty (0 bytes, 0 tokens); a null id, repeated rows and ties give a row each; other columns of
    ``docs`` are not read; an empty table gives no rows. A text of any length is held once, its ids a chunk at a time.
    """

    @F.pandas_udf("long")
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoder(path)
        for batch in batches:
            yield pd.Series([enc.count(t) if len(t) <= chunk + overlap else len(resynchronised_ids(enc, t, chunk, overlap)) for t in batch], dtype="int64")

    text = whole_text(text_column)
    counted = docs.select(F.col(id_column).alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), tokens(text).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
