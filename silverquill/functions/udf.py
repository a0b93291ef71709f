"""Vectorised functions that no built-in expresses: Unicode folding, float16 blobs, projection, EXIF."""

from __future__ import annotations

import math
import struct
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CJK = "぀-ヿ㐀-䶿一-鿿豈-﫿가-힯"


PIECE_BYTES = 1 << 20
"""Bytes of text that a function cuts or folds at a time: what it holds beside a batch doesn't grow with the batch."""


def _pieces(texts: pa.Array) -> Iterator[pa.Array]:
    """Slices of about ``PIECE_BYTES``, each of one text at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        before = ends[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(ends, before + PIECE_BYTES, "right")))
        yield texts.slice(at, end - at)
        at = end


def _by_pieces(work: Callable[[pa.Array], pa.Array], texts: pa.Array) -> pa.Array:
    """``work`` of every piece, put together; what the pieces took goes back to the system, as workers outlive their tasks."""
    done = [work(piece) for piece in _pieces(texts)]
    out = pa.concat_arrays(done) if done else work(texts)
    pa.default_memory_pool().release_unused()
    return out


@F.arrow_udf(T.StringType())
def _fold(texts: pa.Array) -> pa.Array:
    return _by_pieces(lambda t: pc.replace_substring_regex(pc.utf8_normalize(t, form="NFD"), r"\p{M}+", ""), texts)


def fold(text: Column) -> Column:
    """NFD without combining marks, lower-cased. ASCII texts, which folding can't change, don't leave the JVM: they are nulls in
    the function's argument."""
    return F.lower(F.coalesce(_fold(F.when(~text.rlike(r"^\p{ASCII}*$"), text)), text))


def tokens(text: Column, cjk_split: bool = False) -> Column:
    """Runs of letters and digits of the folded text; with ``cjk_split`` every CJK character alone."""
    folded = fold(F.coalesce(text, F.lit("")))
    if cjk_split:
        folded = F.regexp_replace(folded, f"([{CJK}])", " $1 ")
    return F.filter(F.split(folded, r"[^\p{L}\p{N}]+"), lambda t: t != "")


def _folded(texts: pa.Array) -> pa.Array:
    """As ``fold``, of a batch (null: empty); only texts beyond ASCII are normalised."""
    texts = pc.fill_null(texts, "")
    odd = pc.invert(pc.string_is_ascii(texts))
    if pc.any(odd).as_py():
        apart = pc.utf8_normalize(texts.filter(odd), form="NFD")
        texts = pc.replace_with_mask(texts, odd, pc.replace_substring_regex(apart, r"\p{M}+", ""))
    return pc.utf8_lower(texts)


def _cut(texts: pa.Array, cjk_split: bool) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(place of its text, code) of every token of a batch, and the tokens that the codes stand for."""
    folded = _folded(texts)
    if cjk_split:
        folded = pc.replace_substring_regex(folded, f"([{CJK}])", r" \1 ")
    words = pc.split_pattern_regex(folded, r"[^\p{L}\p{N}]+")
    coded = pc.dictionary_encode(words.flatten())
    codes = coded.indices.to_numpy()
    keep = codes != coded.dictionary.index("").as_py()
    return np.repeat(np.arange(len(texts)), np.diff(words.offsets.to_numpy()))[keep], codes[keep], coded.dictionary


def _lists(values: pa.Array, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), values)


def term_counts(text: Column, atoms: list[tuple[str, bool]], cjk_split: bool = False) -> Column:
    """(length, tf): the number of tokens of each text, and how often each atom (a token, or a prefix if true) stands in
    it. Tokens are cut and counted in Arrow; only numbers come back."""

    def piece(texts: pa.Array) -> pa.Array:
        place, codes, names = _cut(texts, cjk_split)
        of = lambda chosen: np.bincount(place[chosen.to_numpy(zero_copy_only=False)[codes]], minlength=len(texts)).astype(np.int32)
        tf = [of(pc.starts_with(names, a) if prefix else pc.equal(names, a)) for a, prefix in atoms]
        lists = _lists(pa.array(np.stack(tf, 1).ravel() if len(texts) and tf else [], pa.int32()), np.full(len(texts), len(tf)))
        return pa.StructArray.from_arrays([pa.array(np.bincount(place, minlength=len(texts)).astype(np.int32)), lists], ["length", "tf"])

    @F.arrow_udf("length int, tf array<int>")
    def count(texts: pa.Array) -> pa.Array:
        return _by_pieces(piece, texts)

    return count(text)


def token_totals(text: Column | str, cjk_split: bool = False) -> Column:
    """(tokens, distinct_tokens): how many tokens a text has, and how many different ones; cut and counted in Arrow, only numbers come back."""

    def piece(texts: pa.Array) -> pa.Array:
        place, codes, names = _cut(texts, cjk_split)
        kinds, n = max(1, len(names)), len(texts)
        return pa.StructArray.from_arrays([pa.array(np.bincount(of, minlength=n), pa.int64()) for of in (place, np.unique(place * kinds + codes) // kinds)], ["tokens", "distinct_tokens"])

    @F.arrow_udf("tokens long, distinct_tokens long")
    def count(texts: pa.Array) -> pa.Array:
        return _by_pieces(piece, texts)

    return count(text)


def counted_tokens(docs: DataFrame, key: str, text: str, cjk_split: bool = False) -> DataFrame:
    """(key, token_count, tokens, tf): the different tokens of each row of ``docs`` and how often each stands there; rows without tokens are left out."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            for texts in _pieces(b.column(1)):
                place, codes, names = _cut(texts, cjk_split)
                kinds, n = max(1, len(names)), len(texts)
                pairs, tf = np.unique(place * kinds + codes, return_counts=True)
                sizes = np.bincount(pairs // kinds, minlength=n)
                columns = [b.column(0).slice(at, n), pa.array(np.bincount(place, minlength=n), pa.int32()), _lists(names.take(pa.array(pairs % kinds)), sizes), _lists(pa.array(tf, pa.int32()), sizes)]
                yield pa.RecordBatch.from_arrays(columns, [key, "token_count", "tokens", "tf"]).filter(pa.array(sizes > 0))
                at += n
            pa.default_memory_pool().release_unused()

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(count, f"`{key}` {kind}, token_count int, tokens array<string>, tf array<int>")


@F.pandas_udf(T.ArrayType(T.FloatType()))
def decode_vector(blobs: pd.Series) -> pd.Series:
    """A packed vector: 1024 bytes are 512 half-precision numbers, any other size single-precision ones."""
    return blobs.map(lambda b: None if b is None else np.frombuffer(b, "<f2" if len(b) == 1024 else "<f4").astype(np.float32))


@F.pandas_udf(T.BinaryType())
def encode_float16(vectors: pd.Series) -> pd.Series:
    """Half precision, rounded to the nearest."""
    return vectors.map(lambda v: None if v is None else np.asarray(v, np.float32).astype("<f2").tobytes())


@F.pandas_udf(T.BinaryType())
def encode_float16_floor(vectors: pd.Series) -> pd.Series:
    """Half precision, with the bits of the mantissa that don't fit cut off."""

    def encode(v) -> bytes:
        x = np.asarray(v, np.float64)
        exponent = np.floor(np.log2(np.maximum(np.abs(x), 2.0**-14)))
        return (np.sign(x) * np.floor(np.abs(x) * 2.0 ** (10 - exponent)) * 2.0 ** (exponent - 10)).astype("<f2").tobytes()

    return vectors.map(lambda v: None if v is None else encode(v))


def projection_matrix(rows: int, columns: int) -> np.ndarray:
    """cos(31 r + 17 c degrees) / sqrt(rows), in single precision: the reference projection, of rank 2."""
    r, c = np.arange(rows)[:, None], np.arange(columns)[None, :]
    return (np.cos((r * 31 + c * 17) % 360 * math.pi / 180) / math.sqrt(rows)).astype(np.float32)


def random_matrix(rows: int, columns: int, seed: int = 1) -> np.ndarray:
    """Orthonormal columns: a projection that keeps angles better."""
    return np.linalg.qr(np.random.default_rng(seed).normal(size=(rows, columns)))[0]


def project(vector: Column, matrix: np.ndarray) -> Column:
    """Product with ``matrix``, at unit length where its length is over 1e-12."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def multiply(vectors: pd.Series) -> pd.Series:
        if not len(vectors):
            return pd.Series([], dtype=object)
        x = np.stack(vectors.to_list()).astype(np.float64) @ matrix.astype(np.float64)
        n = np.sqrt((x * x).sum(1, keepdims=True))
        return pd.Series(list(np.where(n > 1e-12, x / np.maximum(n, 1e-300), x)))

    return multiply(vector)


ALONE = {0x01, *range(0xD0, 0xD9)}
"""Fixed values: JPEG markers without a segment."""


def _tiff_part(data: bytes) -> tuple[bytes, bool]:
    """(the TIFF structure of a file's bytes, whether the bytes end before that is known)."""
    if data[:2] != b"\xff\xd8":
        return data, False
    at = 2
    while at + 1 < len(data):
        if data[at] != 0xFF:
            return b"", False
        if data[at + 1] == 0xFF:  # a fill byte
            at += 1
        elif data[at + 1] in ALONE:
            at += 2
        elif data[at + 1] in (0xD9, 0xDA):
            return b"", False
        elif at + 4 > len(data):
            break
        else:
            size = struct.unpack_from(">H", data, at + 2)[0]
            if size < 2:
                return b"", False
            if at + 2 + size > len(data):
                break
            if data[at + 1] == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
                return data[at + 10 : at + 2 + size], False
            at += 2 + size
    return b"", True


def scan_exif(data: bytes) -> tuple[str | None, str | None, bool]:
    """DateTimeOriginal and OffsetTimeOriginal of a JPEG or TIFF (nulls where the bytes hold none), and whether the bytes end before
    all of it is seen: a value that is cut isn't given."""
    tiff, cut = _tiff_part(data)
    order = {b"II*\0": "<", b"MM\0*": ">"}.get(tiff[:4])
    if order is None or len(tiff) < 8:
        return None, None, cut
    found: dict[int, str] = {}
    todo, seen = [struct.unpack_from(order + "I", tiff, 4)[0]], set()
    while todo:
        ifd = todo.pop()
        if ifd in seen:
            continue
        seen.add(ifd)
        count = struct.unpack_from(order + "H", tiff, ifd)[0] if ifd + 2 <= len(tiff) else 0
        cut = cut or ifd + 2 + 12 * count > len(tiff) or ifd + 2 > len(tiff)
        for place in range(ifd + 2, min(ifd + 2 + 12 * count, len(tiff) - 11), 12):
            tag, kind, size = struct.unpack_from(order + "HHI", tiff, place)
            if tag == 0x8769:
                todo.append(struct.unpack_from(order + "I", tiff, place + 8)[0])
            elif tag in (0x9003, 0x9011) and kind == 2:
                start = place + 8 if size <= 4 else struct.unpack_from(order + "I", tiff, place + 8)[0]
                if start + size <= len(tiff):
                    found[tag] = tiff[start : start + size].split(b"\0")[0].decode("ascii", "replace").strip()
                else:
                    cut = True
    return found.get(0x9003) or None, found.get(0x9011) or None, cut


def read_exif(data: bytes) -> tuple[str | None, str | None]:
    """The two fields of ``scan_exif``."""
    return scan_exif(data)[:2]


@F.pandas_udf(T.StructType().add("date_time_original", T.StringType()).add("offset_time_original", T.StringType()).add("cut", T.BooleanType()))
def exif_fields(contents: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([scan_exif(b or b"") for b in contents], columns=["date_time_original", "offset_time_original", "cut"])
