"""Token ids by a public tokenizer, through a cache of words.

A tokenizer that splits at white space before it merges gives a text the ids of its words (cut at ASCII white space and before
closing punctuation) one after another; a word is encoded once while it stays in the worker's cache. Opening a tokenizer tries this
on ``PROBES``; one that answers otherwise encodes whole texts.
"""

from __future__ import annotations

import os
from functools import cache
from itertools import chain
from unicodedata import category, normalize

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_OPEN: dict[str, WordEncoder] = {}
MARKED = "<|"
"""What the strings of special tokens hold; texts with it are encoded whole."""


@cache
def whole() -> str:
    """A pattern: texts with a match are encoded whole. Beside ``MARKED`` these are texts with letters that end in a mark once they are normalised and
    lower-cased (such as U+0130), so that what follows isn't cut off behind a letter, and with marks behind a capital letter, which may compose with the small one only."""

    def ends_in_mark(c: str) -> bool:
        return category(c)[0] in "LN" and category(normalize("NFC", normalize("NFC", c).lower())[-1])[0] == "M"

    odd = [c for c in range(0x80, 0x20000) if not 0xD800 <= c < 0xE000 and ends_in_mark(chr(c))]
    return "|".join(["<\\|", r"[A-Z]\p{M}", "[" + "".join(rf"\x{{{c:x}}}" for c in odd) + "]"])


PROBES = ("", " ", "Hello, world. It's 12,5!? x\x1cy", "  two  spaces\n\nlines\ttabs ", "É ç ΑΣ ß日本語 a.b. c... (d); e:", "lower UPPER Mixed 3.14 a1 1a", "«quoted» don't re-do e-mail@host.org/x?y=1", "word. Word! word? word, word; word: end.", "\u2028 \xa0 \u3000x", "DEVLETİ. MECLİSİ, 1920 İ!", "Y\u030a \u0a5a: \u095b,")


class WordEncoder:
    """Encodes batches of texts; keeps at most ``most`` words."""

    def __init__(self, name: str, most: int = 400_000) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(name if os.path.isabs(name) else public_tokenizers.path(name))
        self.most = most
        self.forget()
        # A special token that no word holds marks where words end, so that many are encoded at once.
        self.mark = next(((i, t.content) for i, t in sorted(self.tokenizer.get_added_tokens_decoder().items()) if t.special and MARKED in t.content), None)
        self.by_words = True
        ids, sizes = self.encode(pa.array(PROBES))
        whole = [self.tokenizer.encode(t, add_special_tokens=False).ids for t in PROBES]
        self.by_words = ids.tolist() == sum(whole, []) and sizes.tolist() == [len(w) for w in whole]

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.ids = np.zeros(1 << 16, np.uint32)
        self.start = np.zeros(1 << 16, np.int64)
        self.size = np.zeros(1 << 16, np.int64)
        self.used = 0

    def learn(self, words: list[str]) -> None:
        for i in range(0, len(words), 20_000):
            some = words[i : i + 20_000]
            flat, sizes = self.marked(some) if self.mark else self.apart(some)
            n, end = len(self.place), self.used + len(flat)
            if end > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), len(flat)), np.uint32)])
            while n + len(some) > len(self.start):
                self.start, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size))
            self.ids[self.used : end] = flat
            self.start[n : n + len(some)] = self.used + np.cumsum(sizes) - sizes
            self.size[n : n + len(some)] = sizes
            self.place.update(zip(some, range(n, n + len(some)), strict=True))
            self.used = end

    def apart(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in one array, and each word's number of ids."""
        got = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        sizes = np.fromiter(map(len, got), np.int64, len(got))
        return np.fromiter(chain.from_iterable(got), np.uint32, int(sizes.sum())), sizes

    def marked(self, words: list[str], at_once: int = 500) -> tuple[np.ndarray, np.ndarray]:
        """As ``apart``, with a mark behind each word."""
        number, mark = self.mark
        joined = [mark.join(words[i : i + at_once]) + mark for i in range(0, len(words), at_once)]
        flat = np.fromiter(chain.from_iterable(e.ids for e in self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)), np.uint32)
        ends = np.flatnonzero(flat == number)
        if len(ends) != len(words):
            return self.apart(words)
        return np.delete(flat, ends), np.diff(ends, prepend=-1) - 1

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in one array, and the number of ids of each text (null: none).

        Words are cut at ASCII white space and before closing punctuation, and lower-cased in ASCII, as
        the tokenizer does itself; a text that may hold a special token's string, or that matches ``whole`` otherwise, is encoded as it is.
        """
        texts = pc.fill_null(texts, "")
        if not self.by_words:
            got = [e.ids for e in self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
            return np.fromiter(chain.from_iterable(got), np.uint32), np.fromiter(map(len, got), np.int64, len(got))
        odd = np.flatnonzero(pc.match_substring_regex(texts, whole()).to_numpy(zero_copy_only=False))
        if len(odd):
            apart = {int(i): np.array(self.tokenizer.encode(texts[int(i)].as_py(), add_special_tokens=False).ids, np.uint32) for i in odd}
            mask = np.zeros(len(texts), bool)
            mask[odd] = True
            ids, sizes = self._encode(pc.if_else(pa.array(mask), "", texts))
            parts = np.split(ids, np.cumsum(sizes)[:-1])
            for i, own in apart.items():
                parts[i], sizes[i] = own, len(own)
            return np.concatenate(parts), sizes
        return self._encode(texts)

    def _encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        clean = pc.replace_substring_regex(pc.ascii_lower(texts), r"([\p{L}\p{N}])([.,!?;:]+)(\s|$)", r"\1 \2\3")
        words = pc.ascii_split_whitespace(clean)
        coded = pc.dictionary_encode(words.flatten())
        distinct, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        if len(self.place) > self.most:
            self.forget()
        place = self.place
        self.learn([w for w in distinct if w not in place])
        at = np.fromiter(map(place.__getitem__, distinct), np.int64, len(distinct))[codes]
        size = self.size[at]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        step = np.arange(total, dtype=np.int64) + np.repeat(self.start[at] - (ends - size), size)
        offsets = words.offsets.to_numpy()
        cut = np.concatenate([[0], ends])[offsets - offsets[0]]
        return self.ids[step], np.diff(cut)


def word_encoder(name: str = "word_bpe_49k.json") -> WordEncoder:
    """The worker's encoder, opened once."""
    if name not in _OPEN:
        _OPEN[name] = WordEncoder(name)
    return _OPEN[name]
