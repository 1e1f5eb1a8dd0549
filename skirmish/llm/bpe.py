"""Exact token ids of the public byte-pair vocabularies, in bulk.

Both vocabularies cut a text into pieces (words, numbers, signs, white space) and merge inside a piece only. The
``tokenizers`` library defines the ids. It takes about a microsecond a byte, so texts made of ``PLAIN`` characters
without a special token's string are merged by ``tiktoken`` with ranks read from the same file, several times as fast
and with equal ids (tests/llm/test_bpe.py); all other texts go to the library as they are.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

# Latin letters, digits and printable signs. \x85, \xa0, controls and the dotted capital I (two characters in lower
# case) are left to the library, so that no two regular-expression engines can disagree about a character.
NOT_PLAIN = re.compile("[^\t\n\r\x20-\x7e\xa1-įı-ɏ]")
LETTER = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ"
NUMBER = "0-9\xb2\xb3\xb9\xbc-\xbe"
SPACE = "\t\n\r "

# Fixed by the vocabulary files: how they cut. Letters may stand first, since no other branch begins with one.
SHORT = "'(?:[stmd]|re|ve|ll)"
WORD_PIECES = re.compile(f"[{LETTER}]+|{SHORT}|[{NUMBER}]|[^{SPACE}{LETTER}{NUMBER}]+")
SPACED_PIECES = r" ?\p{L}+| ?\p{N}+|'(?:[stmd]|re|ve|ll)| ?[^\s\p{L}\p{N}]+|"
# The look-ahead splits runs of white space only; without such a run the pattern needs none and is twice as fast.
LOOSE, TIGHT = SPACED_PIECES + r"\s+(?!\S)|\s+", SPACED_PIECES + r"\s+"
RUN_OF_SPACE = re.compile(f"[{SPACE}][{SPACE}]")
END_OF_WORD = "</w>"


def byte_signs() -> dict[str, int]:
    """The sign that byte-level vocabularies write for each byte: itself where it prints, else one from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@dataclass
class Coded:
    """A stretch of text with its ids; a piece begins at each of ``bounds``, its ids at the same entry of ``tokens``.

    The first bound is the stretch's first place, the last its end.
    """

    bounds: np.ndarray
    tokens: np.ndarray
    ids: np.ndarray


class Encoder:
    """``ids`` for whole texts, ``coded`` for stretches with the places of their pieces."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        #: No piece boundary further than this from the end of a stretch depends on what follows the stretch.
        self.guard = max([8, *(len(s) + 3 for s in self.special)])
        with open(path) as file:
            model = json.load(file)["model"]
        self.words = model["end_of_word_suffix"] == END_OF_WORD
        signs = byte_signs()

        def spelled(token: str) -> bytes:
            whole = token.removesuffix(END_OF_WORD) if self.words else token
            return bytes(signs[c] for c in whole) + b"\0" * (whole != token)

        known = {spelled(t): i for t, i in model["vocab"].items() if t not in self.special}
        if self.words:
            # A word's last byte and the end of the word are one symbol from the start: merging them comes before all else.
            order = [bytes([b]) for b in range(256)] + [bytes([b, 0]) for b in range(1, 256)]
            order += [spelled("".join(m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
            ranks = {token: rank for rank, token in enumerate(dict.fromkeys(order))}
            self.id_of = np.array([known.get(token, 0) for token in ranks], dtype="<u4")
            self.merge = self.merge_loose = tiktoken.Encoding("words", pat_str="[^\\x00]+\\x00", mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        else:
            self.id_of = None
            self.merge, self.merge_loose = (tiktoken.Encoding(n, pat_str=p, mergeable_ranks=known, special_tokens={}).encode_ordinary for n, p in (("tight", TIGHT), ("loose", LOOSE)))
            size = max(known.values()) + 1
            self.token_bytes, self.opens = np.zeros(size, np.int64), np.zeros(size, bool)
            for token, i in known.items():
                self.token_bytes[i], self.opens[i] = len(token), token[:1] == b" " and token.strip() != b""

    def plain(self, text: str) -> bool:
        return not NOT_PLAIN.search(text) and not any(s in text for s in self.special)

    def _library_ids(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def _plain_ids(self, text: str) -> np.ndarray:
        if not self.words:
            merge = self.merge_loose if RUN_OF_SPACE.search(text) else self.merge
            return np.array(merge(text), dtype="<u4")
        pieces = WORD_PIECES.findall(text.lower())
        return self.id_of[np.array(self.merge("\0".join([*pieces, ""])), dtype=np.int64)] if pieces else np.zeros(0, "<u4")

    def ids(self, text: str) -> np.ndarray:
        """All ids of the text, unsigned 32-bit, without special tokens added."""
        return self._plain_ids(text) if self.plain(text) else self._library_ids(text)

    def count(self, text: str) -> int:
        if self.plain(text) and not self.words:
            return len((self.merge_loose if RUN_OF_SPACE.search(text) else self.merge)(text))
        return len(self.ids(text))

    def coded(self, text: str, base: int = 0) -> Coded:
        """Ids with places, counted from ``base``; for vocabularies whose pieces cover the text."""
        if self.words:
            raise ValueError("the pieces of this vocabulary leave out white space")
        if self.plain(text):
            ids = self._plain_ids(text)
            ends = np.cumsum(self.token_bytes[ids])
            first = np.flatnonzero(self.opens[ids])  # a token with a space before another sign begins a piece
            first = first[first > 0]
            starts = ends[first - 1]
            if not text.isascii():
                heads = (np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80
                starts = (np.cumsum(heads) - heads)[starts]
        else:
            got = self.library.encode(text, add_special_tokens=False)
            words, spans, ids = got.word_ids, got.offsets, np.array(got.ids, dtype="<u4")
            first = np.array([i for i in range(1, len(words)) if words[i] is not None and words[i] != words[i - 1]], dtype=np.int64)
            starts = np.array([spans[i][0] for i in first], dtype=np.int64)
        return Coded(np.array([0, *starts, len(text)]) + base, np.array([0, *first, len(ids)]), ids)


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One encoder for each vocabulary in a worker."""
    return Encoder(path)
