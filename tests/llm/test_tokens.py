"""Ids through the cache of words against the tokenizer itself, for strings over all categories of Unicode."""

import random
from unicodedata import category

import pyarrow as pa
import pytest

from silverquill.llm.tokens import WordEncoder

ASCII = "abcXYZİıßǅ019 .,!?;:\n\t'-"


@pytest.mark.parametrize("seed", range(4))
def test_ids_of_random_strings(seed):
    by = {}
    for c in range(0x110000):
        if category(chr(c)) not in ("Cs", "Cn"):
            by.setdefault(category(chr(c)), []).append(chr(c))
    rng, names = random.Random(seed), sorted(by)
    word = lambda: "".join(rng.choice(by[rng.choice(names)]) if rng.random() < 0.5 else rng.choice(ASCII) for _ in range(rng.randrange(1, 9)))
    texts = [" ".join(word() + rng.choice(["", ".", ",", "!?", ":"]) for _ in range(rng.randrange(1, 8))) for _ in range(5000)]
    encoder = WordEncoder("word_bpe_49k.json")
    assert encoder.by_words
    ids, sizes = encoder.encode(pa.array(texts))
    at = 0
    for t, n, e in zip(texts, sizes.tolist(), encoder.tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
        assert ids[at : at + n].tolist() == e.ids, t
        at += n


def test_letters_that_become_marks():
    encoder = WordEncoder("word_bpe_49k.json")
    for t in ("DEVLETİ.", "... MECLİSİ, 1920", "Y̊", "ਗ਼:", "ज़, x"):
        ids, _ = encoder.encode(pa.array([t, "plain text."]))
        assert ids.tolist()[: -len(encoder.tokenizer.encode("plain text.", add_special_tokens=False).ids)] == encoder.tokenizer.encode(t, add_special_tokens=False).ids
