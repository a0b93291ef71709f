"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer network.

A word and its shape (``Aa!`` for ``Whence!!``) each have a sparse ternary index vector given by a hash.
A word's vector is its index vector plus the normalised sum of the index vectors of its neighbours,
gathered over all texts (no label is needed for that) in a table of fixed size, whose slices are added up on the executors. A document is the mean of its words' vectors,
the mean of its shapes' vectors, the length of both means (which is high where few words repeat) and its
size. The network gives a logit, which a temperature fitted on rows kept from training turns into a
probability.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc32_of_id, materialize, pieces_of, table, tidied

DIMS, ROWS, NONZERO, WINDOW, HIDDEN, SLICES = 48, 1 << 15, 4, 2, 32, 64
SAMPLE_ROWS = 12_000
"""At most so many labelled documents are learnt from: those with the smallest hashes of their ids."""
THRESHOLD = 0.3
#: Shape rules, in order: (pattern, replacement).
SHAPES = ((r"\p{Lu}+", "A"), (r"[\p{L}\p{M}]*[\p{Ll}\p{Lo}\p{Lm}\p{M}][\p{Ll}\p{Lo}\p{Lm}\p{M}]*", "a"), (r"\p{N}+", "0"))


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the nonzero parts of the index vector of each row of the table."""
    state = np.arange(ROWS * NONZERO, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    state ^= state >> np.uint64(29)
    state *= np.uint64(0xBF58476D1CE4E5B9)
    state ^= state >> np.uint64(32)
    return (state % np.uint64(DIMS)).astype(np.int64).reshape(ROWS, NONZERO), np.where(state >> np.uint64(40) & np.uint64(1), 1.0, -1.0).astype(np.float32).reshape(ROWS, NONZERO)


def dense_index() -> np.ndarray:
    where, sign = index_vectors()
    out = np.zeros((ROWS, DIMS), np.float32)
    np.add.at(out, (np.arange(ROWS)[:, None], where), sign)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-6)


@dataclass
class Words:
    """Distinct words of some texts: each token's word, each word's rows for itself and its shape, texts' ends."""

    codes: np.ndarray
    row: np.ndarray
    shape: np.ndarray
    ends: np.ndarray


def cut_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words of the texts (runs of anything but ASCII white space), each word's place among them, and texts' ends."""
    words = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    coded = pc.dictionary_encode(words.flatten())
    codes, offsets = coded.indices.to_numpy(), words.offsets.to_numpy()
    keep = pc.not_equal(coded.dictionary, "").to_numpy(zero_copy_only=False)[codes] if len(codes) else np.zeros(0, bool)
    return coded.dictionary, codes[keep], np.concatenate([[0], np.cumsum(keep)])[offsets[1:] - offsets[0]]


def read_words(texts: pa.Array) -> Words:
    distinct, codes, ends = cut_words(texts)
    shape = distinct
    shape = pc.replace_substring_regex(shape, r"(\P{L})\p{Lu}[\p{Ll}\p{M}]", r"\1Aa")
    for pattern, to in SHAPES:
        shape = pc.replace_substring_regex(shape, pattern, to)
    shape = pc.replace_substring_regex(pc.utf8_slice_codeunits(shape, 0, 12), r"([^\pL\pN])[^\pL\pN]+", r"\1")
    row = np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in pc.utf8_lower(distinct).to_pylist()), np.int64, len(distinct))
    kinds = pc.dictionary_encode(shape)
    own = np.fromiter((zlib.crc32(b"shape:" + w.encode("utf-8", "surrogatepass")) for w in kinds.dictionary.to_pylist()), np.int64, len(kinds.dictionary))
    return Words(codes, row % ROWS, (own % ROWS)[kinds.indices.to_numpy()] if len(own) else own, ends)


def word_rows(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The row of each word of the texts, and where each text ends among them."""
    distinct, codes, ends = cut_words(texts)
    row = np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in pc.utf8_lower(distinct).to_pylist()), np.int64, len(distinct))
    return (row % ROWS)[codes], ends


def neighbours(row: np.ndarray, ends: np.ndarray, out: np.ndarray) -> None:
    """Add to ``out`` (row, row of a neighbour: how often), as counts of pairs of rows, sorted: the pairs of the texts given."""
    text = np.repeat(np.arange(len(ends)), np.diff(np.concatenate([[0], ends])))
    where, sign = index_vectors()
    for step in range(1, WINDOW + 1):
        same = text[step:] == text[:-step]
        a, b = row[step:][same], row[:-step][same]
        pairs, times = np.unique(np.concatenate([a * ROWS + b, b * ROWS + a]), return_counts=True)
        centre, near = pairs // ROWS, pairs % ROWS
        for k in range(NONZERO):
            out += np.bincount(centre * DIMS + where[near, k], sign[near, k] * times, ROWS * DIMS)


def context_table(documents: DataFrame) -> np.ndarray:
    """Sums of the index vectors around each row's words, over all texts: a table of fixed size, which each task fills for its own
    texts and whose slices meet in a sum each."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, size = np.zeros(ROWS * DIMS), [], 0

        def count() -> None:
            if held:
                row, ends = zip(*held, strict=True)
                starts = np.cumsum([0, *(len(r) for r in row[:-1])])
                neighbours(np.concatenate(row), np.concatenate([e + s for e, s in zip(ends, starts, strict=True)]), total)
                held.clear()

        for whole in batches:
            for b in pieces_of(whole, most_bytes=4 << 20):
                held.append(word_rows(b.column(0)))
                size += len(held[-1][0])
                if size > 400_000:
                    count()
                    size = 0
        count()
        if total.any():
            parts = np.split(total.astype("<i8"), SLICES)
            yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([zlib.compress(p.tobytes(), 1) for p in parts], pa.binary())], ["slice", "part"])

    def add(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(zlib.decompress(p), "<i8") for p in rows["part"])
        return pd.DataFrame({"slice": [key[0]], "part": [zlib.compress(total.tobytes(), 1)]})

    schema = "slice int, part binary"
    out = np.zeros((SLICES, ROWS * DIMS // SLICES))
    for at, part in documents.select("text").mapInArrow(tidied(gather), schema).groupBy("slice").applyInPandas(add, schema).collect():
        out[at] = np.frombuffer(zlib.decompress(bytes(part)), "<i8")
    return out.reshape(ROWS, DIMS)


def pool(words: Words, vectors: np.ndarray, index: np.ndarray) -> np.ndarray:
    """One row of features per text."""
    n = len(words.ends)
    starts = np.concatenate([[0], words.ends[:-1]]).astype(np.int64)
    sizes = words.ends - starts
    means = np.zeros((n, 2 * DIMS), np.float32)
    if len(words.codes):
        for half, (own, base) in enumerate(((words.row, vectors), (words.shape, index))):
            rows = own[words.codes]
            at = 0
            while at < n:  # some texts at a time, so that the gathered vectors stay small
                to = at + 1
                while to < n and words.ends[to] - starts[at] <= 200_000:
                    to += 1
                filled = np.flatnonzero(sizes[at:to]) + at
                for lo in range(starts[at], words.ends[to - 1], 400_000) if to == at + 1 else [starts[at]]:
                    hi = min(words.ends[to - 1], lo + 400_000) if to == at + 1 else words.ends[to - 1]
                    if to == at + 1:
                        means[at, half * DIMS : (half + 1) * DIMS] += base[rows[lo:hi]].sum(0)
                    elif len(filled):
                        means[filled, half * DIMS : (half + 1) * DIMS] = np.add.reduceat(base[rows[lo:hi]], starts[filled] - lo, axis=0)
                at = to
    means /= np.maximum(sizes, 1)[:, None]
    norms = [np.linalg.norm(means[:, k * DIMS : (k + 1) * DIMS], axis=1, keepdims=True) for k in (0, 1)]
    return np.hstack([means, *norms, np.log1p(sizes)[:, None]]).astype(np.float32)


@dataclass
class Network:
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def train(x: np.ndarray, y: np.ndarray, kept: np.ndarray, seed: int = 7, epochs: int = 60) -> Network:
    """Adam on the rows not ``kept``; the temperature on those kept (or on all where none are)."""
    rng = np.random.default_rng(seed)
    fit = ~kept if (~kept).any() else np.ones(len(y), bool)
    net = Network(x[fit].mean(0), x[fit].std(0) + 1e-3, rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), 0.0)
    z, t = ((x[fit] - net.mean) / net.scale).astype(np.float64), y[fit].astype(np.float64)
    params = [net.w1, net.b1, net.w2, np.zeros(1)]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(epochs):
        order = rng.permutation(len(t))
        for at in range(0, len(t), 128):
            zb, tb = z[order[at : at + 128]], t[order[at : at + 128]]
            h = np.tanh(zb @ params[0] + params[1])
            gap = (1 / (1 + np.exp(-np.clip(h @ params[2] + params[3][0], -40, 40))) - tb) / len(tb)
            back = gap[:, None] * params[2] * (1 - h * h)
            grads = [zb.T @ back + 1e-4 * params[0], back.sum(0), h.T @ gap + 1e-4 * params[2], np.array([gap.sum()])]
            step += 1
            for p, g, m, v in zip(params, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= 0.003 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    net.b2 = float(params[3][0])
    hold = kept if kept.any() else fit
    logit, truth = net.logits(x[hold]), y[hold]
    losses = {temp: float(np.mean(np.logaddexp(0, np.where(truth > 0, -1, 1) * logit / temp))) for temp in np.geomspace(0.25, 8, 81)}
    net.temperature = float(min(losses, key=losses.get))
    return net


def _vectors(context: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(context, axis=1, keepdims=True)
    return (dense_index() + context / np.maximum(norm, 1e-9)).astype(np.float32)


def training_sample(documents: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """(doc_id, text, quality): at most ``most`` labelled rows outside the held-out fifth."""
    known = labels.select("doc_id", "quality").where("quality is not null and doc_id is not null").groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("quality"))
    some = known.where(F.pmod(crc32_of_id(), F.lit(5)) != 0).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return documents.select("doc_id", "text").join(F.broadcast(some), "doc_id")


def classify(documents: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted, text_hash) for every document; the hash is the text's xxhash64.

    Word vectors are gathered over all texts. At most ``sample_rows`` labelled rows train the network (a documented bound); their
    features are all that reaches the driver beside a table of fixed size, and scoring is a map over record batches. Null texts score as empty ones; repeated rows are scored each; without labels of
    both kinds every score is the smoothed share of label 1 (0.5 where there are none). Labels with null
    ids or qualities are ignored, contradicting ones of one document count by their majority.
    """
    spark = documents.sparkSession
    sample = materialize(training_sample(documents, labels, sample_rows).repartition(8), "quality-sample")

    shared = spark.sparkContext.broadcast(_vectors(context_table(documents)))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = dense_index()
        for whole in batches:
            for b in pieces_of(whole):
                x = pool(read_words(b.column(1)), shared.value, index)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in x], pa.binary()), b.column(2)], ["doc_id", "x", "quality"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    rows = sorted(sample.select("doc_id", "text", "quality").mapInArrow(tidied(features), f"doc_id {kind}, x binary, quality int").collect(), key=lambda r: (r[0], bytes(r[1])))
    y = np.array([r[2] for r in rows], np.int64)
    net: Network | float = (int(y.sum()) + 1) / (len(y) + 2)
    if len(set(y.tolist())) == 2:
        kept = np.array([zlib.crc32(str(r[0]).encode()) % 5 == 1 for r in rows])
        net = train(np.stack([np.frombuffer(r[1], np.float32) for r in rows]), y, kept)
    model = spark.sparkContext.broadcast(net)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = dense_index()
        for whole in batches:
            for b in pieces_of(whole):
                if isinstance(model.value, float):
                    p = np.full(b.num_rows, model.value)
                else:
                    p = model.value.probability(pool(read_words(b.column(1)), shared.value, index))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(p, pa.float64())], ["doc_id", "text_hash", "score"])

    scored = documents.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(tidied(score), f"doc_id {kind}, text_hash long, score double")
    return scored.select("doc_id", F.coalesce(F.pmod(crc32_of_id(), F.lit(5)) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "text_hash")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
