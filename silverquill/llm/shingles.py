"""Words, five-word shingles, Order MinHash signatures and banded alignment (numpy and whole numbers)."""

from __future__ import annotations

import zlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WIDTH = 5
_MIX1, _MIX2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def constants(n: int, seed: int) -> np.ndarray:
    """Odd 64-bit numbers."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * _STEP + np.uint64(seed)) | np.uint64(1)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A 32-bit hash of every word (lower-cased in ASCII, cut at ASCII white space), and the words' number in each text."""
    words = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    coded = pc.dictionary_encode(words.flatten())
    names = coded.dictionary.to_pylist()
    hashes = np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in names), np.uint32, len(names))
    offsets = words.offsets.to_numpy()
    codes, offsets = coded.indices.to_numpy(), offsets - offsets[0]
    blank = names.index("") if "" in names else -1
    keep = codes != blank
    kept = np.concatenate([[0], np.cumsum(keep)])
    return hashes[codes[keep]], np.diff(kept[offsets])


def shingles(words: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """64-bit hashes of the runs of ``width`` words; of all words where there are fewer; none without words."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    w, odd = words.astype(np.uint64), constants(width, 11)
    if n < width:
        return mix(np.array([(w * odd[:n]).sum() + np.uint64(n)], np.uint64))
    total = np.zeros(n - width + 1, np.uint64)
    for k in range(width):
        total += w[k : n - width + 1 + k] * odd[k]
    return mix(total)


def labelled(grams: np.ndarray) -> np.ndarray:
    """Make repeats differ: each shingle with the number of its occurrence."""
    order = np.argsort(grams, kind="stable")
    ranked = grams[order]
    same = np.concatenate([[False], ranked[1:] == ranked[:-1]])
    if not same.any():
        return grams
    place = np.arange(len(grams))
    nth = np.empty(len(grams), np.uint64)
    nth[order] = place - np.maximum.accumulate(np.where(same, 0, place))
    return np.where(nth > 0, mix(grams + nth * _STEP), grams)


def order_minhash(marks: np.ndarray, bands: int, sample: int, seed: int = 5) -> np.ndarray:
    """One 64-bit signature per band: the ``sample`` labelled shingles least by the band's hash, in text order."""
    n, take = len(marks), min(sample, len(marks))
    odd, fold, own = constants(bands, seed), constants(sample, seed + 1), constants(bands, seed + 2)
    out = np.empty(bands, np.uint64)
    step = bands if n <= 20_000 else 1
    for at in range(0, bands, step):
        if take == n:
            chosen = np.broadcast_to(np.arange(n), (min(step, bands - at), n))
        else:
            chosen = np.argpartition(marks[None, :] * odd[at : at + step, None], take - 1, axis=1)[:, :take]
            chosen.sort(axis=1)
        out[at : at + step] = mix((marks[chosen] * fold[:take]).sum(1) + own[at : at + step])
    return out


def rising(places: np.ndarray) -> int:
    """Length of the longest increasing subsequence."""
    if len(places) < 2 or (places[1:] > places[:-1]).all():
        return len(places)
    tails: list[int] = []
    for p in places.tolist():
        i = bisect_left(tails, p)
        if i == len(tails):
            tails.append(p)
        else:
            tails[i] = p
    return len(tails)


def alignment(a: np.ndarray, b: np.ndarray, threshold: float) -> tuple[float, float]:
    """(similarity, bound) of two labelled shingle sequences.

    Similarity is L / (n + m - L), with L the shingles matched by the best alignment inside the band that
    ``threshold`` leaves (an alignment outside needs too many gaps to reach it). As labels make the shingles
    of a text distinct, it is a longest increasing run of places. ``bound`` is the same with all common
    shingles, whatever their order: never less, and one minus it is a metric.
    """
    if not len(a) or not len(b):
        return (1.0, 1.0) if len(a) == len(b) else (0.0, 0.0)
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    total = len(a) + len(b)
    bound = len(i) / (total - len(i))
    if bound < threshold:
        return 0.0, bound
    order = np.argsort(i)
    i, j = i[order], j[order]
    near = np.abs(i - j) <= int(total * (1 - threshold) / (1 + threshold)) + 1
    matched = rising(j[near])
    return matched / (total - matched), bound


def banded_lcs(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """Length of the longest common subsequence whose places differ by ``band`` at most (each step along ``b`` is a few operations on whole numbers, a
    bit per place of ``a`` inside the band: where the length doesn't grow there)."""
    places: dict[int, int] = {}
    for j, w in enumerate(a.tolist()):
        places[w] = places.get(w, 0) | 1 << j
    low, high, found = 0, min(len(a), band + 1), 0
    flat = (1 << high) - 1
    for i, w in enumerate(b.tolist()):
        start, end = min(len(a), max(low, i - band)), min(len(a), i + band + 1)
        if start > low:
            found += start - low - (flat & (1 << (start - low)) - 1).bit_count()
            flat >>= start - low
            low = start
        if end > high:
            flat |= ((1 << (end - high)) - 1) << (high - low)
            high = end
        met = flat & (places.get(w, 0) >> low)
        if met:
            flat = ((flat + met) | (flat - met)) & ((1 << (high - low)) - 1)
    return found + high - low - flat.bit_count()


def chained(i: np.ndarray, j: np.ndarray, width: int = WIDTH) -> int:
    """Words that runs of ``width`` words, equal at places i and j, align one after another; runs that cross an earlier one are left out."""
    order = np.argsort(i, kind="stable")
    i, j = i[order], j[order]
    keep = j == np.maximum.accumulate(j)
    i, j = i[keep], j[keep]
    return width + int(np.minimum(np.minimum(np.diff(i), np.diff(j)), width).sum()) if len(i) else 0


class Marked:
    """The words of a text as numbers, the same with repeats told apart, and its labelled shingles (made when asked for)."""

    def __init__(self, words: np.ndarray) -> None:
        self.words, self.labels, self._grams = words, labelled(words.astype(np.uint64)), None

    @property
    def grams(self) -> np.ndarray:
        if self._grams is None:
            self._grams = labelled(shingles(self.words))
        return self._grams


def word_alignment(a: Marked, b: Marked, threshold: float) -> tuple[float, float]:
    """(similarity, bound) of two texts' words.

    Similarity is L / (n + m - L), with L the words matched by the best alignment inside the band that ``threshold`` leaves; where chained shingles
    alone reach the threshold, theirs, which is no more. ``bound`` is the same with all common words, whatever their order: never less, and one minus it is a metric.
    """
    n, m = len(a.words), len(b.words)
    if not n or not m:
        return (1.0, 1.0) if n == m else (0.0, 0.0)
    common = len(np.intersect1d(a.labels, b.labels, assume_unique=True))
    bound = common / (n + m - common)
    if bound < threshold:
        return 0.0, bound
    if min(n, m) >= WIDTH:
        _, i, j = np.intersect1d(a.grams, b.grams, assume_unique=True, return_indices=True)
        matched = chained(i, j)
        if matched >= threshold * (n + m - matched):
            return matched / (n + m - matched), bound
    matched = banded_lcs(a.words, b.words, int(max(n, m) - threshold * (n + m) / (1 + threshold)) + 1)
    return matched / (n + m - matched), bound
