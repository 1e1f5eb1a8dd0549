"""Ids of the bulk encoder, and of spliced chunks, against the library."""

import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from skirmish.llm.bpe import encoder
from skirmish.llm.token_counts import resynchronised_ids

PARTS = ["word", "Words", "it's", "42", " ", "  ", "\n", "\n\n", "\t", "é", "ß", "Ünï", "…", "日本", "İ", "\xa0", "$#!", "<|endoftext|>", "a" * 40, "'ll", "_x_", "\r\n"]


def fuzz(rng, n):
    return "".join(rng.choice(PARTS) + rng.choice(["", " ", ""]) for _ in range(n))


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_equal_the_library(name):
    rng, path = random.Random(3), public_tokenizers.path(name)
    enc, library = encoder(path), Tokenizer.from_file(path)
    for text in ["", " ", *[fuzz(rng, rng.randint(1, 60)) for _ in range(400)]]:
        want = library.encode(text, add_special_tokens=False).ids
        assert enc.ids(text).tolist() == want and enc.count(text) == len(want), repr(text)


@pytest.mark.parametrize("chunk, overlap", [(64, 8), (200, 2), (1000, 64)])
def test_spliced_chunks_equal_the_whole(chunk, overlap):
    rng, enc = random.Random(4), encoder(public_tokenizers.path("byte_bpe_50k.json"))
    for _ in range(40):
        text = fuzz(rng, rng.randint(50, 1500))
        assert np.array_equal(resynchronised_ids(enc, text, chunk, overlap), enc._library_ids(text)), repr(text)
