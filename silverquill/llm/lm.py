"""LM scoring by deleted interpolation of word bigrams.

A token's probability is ``a ML(word | previous) + b ML(word) + c / (V + 1)``; the weights depend on how
often the previous token occurs (a bucket per power of two) and are learnt by expectation-maximisation on
the counts of a deleted part of the training texts, with estimates from the rest.

Counting moves sorted arrays rather than rows: documents are packed into chunks of about ``CHUNK`` tokens,
each chunk sends its distinct keys (word or pair hashes) with their counts, cut into key ranges, one
task adds up a range and answers each chunk with the totals of its own keys. The number of ranges and of tasks follows
the corpus, so a task's share is bounded: about ``RANGE_TOKENS`` keys, and one more per chunk for a key that all chunks
hold (10 000 chunks at 30 GB). The deleted part's counts stay in a stored table; a round of expectation-maximisation is one
aggregate over it, of which three sums per bucket reach the driver.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, pieces_of, table, tidied

CHUNK, RANGE_TOKENS, FOLDS, TEST, DELETED, BUCKETS = 500_000, 1_000_000, 7, 2, 3, 24
TASK_CHUNKS = 8
"""Chunks whose counts one task joins."""
PRIOR, EM_ROUNDS, SETTLED = (0.5, 0.4, 0.1), 60, 1e-4
"""First weights (bigram, unigram, uniform), which also stand for one token in each bucket; most rounds; the change that ends them."""
END = np.uint64(0x7F4A7C15F39CC060)
_ONE, _TWO = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
TRAIN_PART, DELETED_PART, TEST_PART = 0, 1, 2


def squeeze(x: np.ndarray) -> bytes:
    """An integer array as compressed byte planes."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes())


def expand(blob: bytes, kind: type) -> np.ndarray:
    import zstandard

    raw, size = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8), np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).reshape(-1).view(kind)


def pack_ids(ids: pa.Array) -> bytes:
    """An array of ids of any type."""
    import zstandard

    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, pa.schema([("id", ids.type)])) as out:
        out.write_batch(pa.RecordBatch.from_arrays([ids], ["id"]))
    return zstandard.ZstdCompressor(level=1).compress(sink.getvalue().to_pybytes())


def unpack_ids(blob: bytes) -> pa.Array:
    import zstandard

    return pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(blob)).read_next_batch().column(0)


def part_of(doc_id: int | str | None) -> int:
    rest = zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS
    return {TEST: TEST_PART, DELETED: DELETED_PART}.get(rest, TRAIN_PART)


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word and of each text's end, and the number of tokens of each text."""
    import xxhash

    words = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    coded = pc.dictionary_encode(words.flatten())
    names = coded.dictionary.to_pylist()
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in names), np.uint64, len(names))
    offsets = words.offsets.to_numpy()
    codes, offsets = coded.indices.to_numpy(), offsets - offsets[0]
    keep = codes != (names.index("") if "" in names else -1)
    sizes = np.diff(np.concatenate([[0], np.cumsum(keep)])[offsets])
    out = np.empty(int(sizes.sum()) + len(sizes), np.uint64)
    ends = np.cumsum(sizes + 1) - 1
    inner = np.ones(len(out), bool)
    inner[ends] = False
    out[inner], out[ends] = hashes[codes[keep]], END
    return out, sizes + 1


@dataclass
class Chunk:
    ids: pa.Array
    sizes: np.ndarray
    words: np.ndarray
    """Distinct token hashes, sorted."""
    codes: np.ndarray

    @classmethod
    def of(cls, ids: pa.Array, sizes: np.ndarray, stream: np.ndarray) -> Chunk:
        words, codes = np.unique(stream, return_inverse=True)
        return cls(ids, sizes, words, codes.astype(np.int32))

    def pack(self) -> bytes:
        rank = np.argsort(-np.bincount(self.codes, minlength=len(self.words)), kind="stable")
        place = np.empty(len(rank), np.int32)
        place[rank] = np.arange(len(rank), dtype=np.int32)
        parts = [pack_ids(self.ids), squeeze(self.sizes.astype(np.int32)), squeeze(self.words[rank]), squeeze(place[self.codes])]
        return struct.pack("<4q", *map(len, parts)) + b"".join(parts)

    @classmethod
    def unpack(cls, blob: bytes) -> Chunk:
        at, parts = 32, []
        for n in struct.unpack("<4q", blob[:32]):
            parts.append(blob[at : at + n])
            at += n
        sizes, words, codes = (expand(p, k) for p, k in zip(parts[1:], (np.int32, np.uint64, np.int32), strict=True))
        order = np.argsort(words)
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        return cls(unpack_ids(parts[0]), sizes.astype(np.int64), words[order], place[codes])

    def contexts(self) -> np.ndarray:
        """The code of each token's context: the token before it, the end token for a text's first."""
        end = np.searchsorted(self.words, END)
        return np.concatenate([[end], self.codes[:-1]]).astype(np.int32)

    def pairs(self) -> np.ndarray:
        left, right = self.words * _ONE, (self.words ^ (self.words >> np.uint64(31))) * _TWO
        key = left[self.contexts()] + right[self.codes]
        key = (key ^ (key >> np.uint64(29))) * _ONE
        return (key ^ (key >> np.uint64(32))) & ~np.uint64(255)  # 56 bits tell pairs apart


def make_chunks(documents: DataFrame) -> DataFrame:
    """(chunk, part, n, payload): the documents' tokens, chunks of one part each."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {p: [[], [], []] for p in (TRAIN_PART, DELETED_PART, TEST_PART)}
        first, made, kind = TaskContext.get().partitionId() << 28, 0, None

        def flush(part: int) -> pa.RecordBatch:
            nonlocal made
            ids, sizes, streams = held[part]
            stream = np.concatenate(streams)
            held[part], made = [[], [], []], made + 1
            payload = Chunk.of(pa.array(ids, kind), np.array(sizes, np.int64), stream).pack()
            return pa.RecordBatch.from_arrays([pa.array([first + made], pa.int64()), pa.array([part], pa.int32()), pa.array([len(stream)], pa.int64()), pa.array([payload], pa.binary())], ["chunk", "part", "n", "payload"])

        for whole in batches:
            kind = whole.schema.field(0).type
            for b in pieces_of(whole, most_bytes=2 << 20):
                stream, sizes = tokens(b.column(1))
                pa.default_memory_pool().release_unused()
                for doc_id, n, own in zip(b.column(0).to_pylist(), sizes.tolist(), np.split(stream, np.cumsum(sizes)[:-1]), strict=True):
                    part = part_of(doc_id)
                    held[part][0].append(doc_id)
                    held[part][1].append(n)
                    held[part][2].append(own)
                for part, (_, sizes_of, _) in held.items():
                    if sum(sizes_of) >= CHUNK:
                        yield flush(part)
        for part, (ids, _, _) in held.items():
            if ids:
                yield flush(part)

    return documents.select("doc_id", "text").mapInArrow(tidied(pack), "chunk long, part int, n long, payload binary")


def count_keys(chunks: DataFrame, bits: int) -> DataFrame:
    """(kind, range, chunk, keys, counts, deleted) of every chunk: its sorted distinct keys and how often each
    occurs in training texts and in the deleted part of them. Test chunks ask, with counts of 0."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, part, payload in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                c = Chunk.unpack(payload.as_py())
                rows: list[list] = [[] for _ in range(6)]
                for kind, (keys, n) in enumerate(((c.words, np.bincount(c.codes, minlength=len(c.words))), np.unique(c.pairs(), return_counts=True)), 1):
                    cuts = np.searchsorted(keys >> np.uint64(64 - bits) if bits else np.zeros(len(keys), np.uint64), np.arange((1 << bits) + 1, dtype=np.uint64))
                    n = n.astype(np.uint32)
                    for r in np.flatnonzero(np.diff(cuts)):
                        own, times = keys[cuts[r] : cuts[r + 1]], n[cuts[r] : cuts[r + 1]]
                        for column, value in zip(rows, (kind, int(r), chunk, squeeze(np.diff(own, prepend=np.uint64(0))), squeeze(times * np.uint32(part != TEST_PART)), part == DELETED_PART), strict=True):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), pa.array(rows[1], pa.int32()), pa.array(rows[2], pa.int64()), pa.array(rows[3], pa.binary()), pa.array(rows[4], pa.binary()), pa.array(rows[5], pa.bool_())], ["kind", "range", "chunk", "keys", "counts", "deleted"])

    return chunks.select("chunk", "part", "payload").mapInArrow(tidied(send), "kind int, range int, chunk long, keys binary, counts binary, deleted boolean")


def add_up(sent: DataFrame, bits: int) -> DataFrame:
    """(kind, range, chunk, held, totals, deleted, n, n_deleted, distinct): a range's totals for each chunk's keys (held: of
    the deleted part); the row without a chunk has the range's sums."""

    def add(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        keys = [np.cumsum(expand(b, np.uint64), dtype=np.uint64) for b in rows["keys"]]
        counts = [expand(b, np.uint32) for b in rows["counts"]]
        every, back = np.unique(np.concatenate(keys), return_inverse=True)
        times = np.concatenate(counts).astype(np.float64)
        gone = np.repeat(rows["deleted"].to_numpy(), [len(k) for k in keys])
        total = np.bincount(back, times, len(every))
        deleted = np.bincount(back[gone], times[gone], len(every)) if gone.any() else np.zeros(len(every))
        cuts = np.cumsum([len(k) for k in keys])[:-1]
        out = [(key[0], key[1], chunk, bool(held), squeeze(total[own].astype(np.uint64)), squeeze(deleted[own].astype(np.uint64)), None, None, None) for chunk, held, own in zip(rows["chunk"], rows["deleted"], np.split(back, cuts), strict=True)]
        out.append((key[0], key[1], None, False, None, None, int(total.sum()), int(deleted.sum()), int((total > 0).sum())))
        return pd.DataFrame(out, columns=["kind", "range", "chunk", "held", "totals", "deleted", "n", "n_deleted", "distinct"]).astype({"chunk": "Int64", "n": "Int64", "n_deleted": "Int64", "distinct": "Int64"})

    tasks = max(int(sent.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1 << bits)
    return sent.repartition(tasks, "kind", "range").groupBy("kind", "range").applyInPandas(add, "kind int, range int, chunk long, held boolean, totals binary, deleted binary, n long, n_deleted long, distinct long")


def with_counts(chunks: DataFrame, answers: DataFrame, tasks: int) -> DataFrame:
    """(payload, answers) of each chunk, the answers in the order of its keys; ``tasks`` share the chunks."""
    got = answers.where("chunk is not null").repartition(tasks, "chunk").groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("kind", "range", "totals", "deleted"))).alias("answers"))
    return chunks.select("chunk", "payload").repartition(tasks, "chunk").join(got.hint("merge"), "chunk").select("payload", "answers")


@dataclass
class Counted:
    """Counts at every token of a chunk: of the token, its context and both, in all training texts and in the deleted part."""

    chunk: Chunk
    word: np.ndarray
    context: np.ndarray
    pair: np.ndarray
    word_deleted: np.ndarray
    context_deleted: np.ndarray
    pair_deleted: np.ndarray

    @classmethod
    def of(cls, payload: bytes, answers: list[dict]) -> Counted:
        c = Chunk.unpack(payload)
        read = lambda kind, name: np.concatenate([expand(a[name], np.uint64) for a in answers if a["kind"] == kind]).astype(np.float64)
        before, back = c.contexts(), np.unique(c.pairs(), return_inverse=True)[1]
        found = []
        for name in ("totals", "deleted"):
            one, two = read(1, name), read(2, name)
            found += [one[c.codes], one[before], two[back]]
        return cls(c, *found)


def bucket(context: np.ndarray) -> np.ndarray:
    """0 for a context never seen, else one more than the power of two below its count."""
    return np.minimum(np.where(context > 0, np.floor(np.log2(np.maximum(context, 1))) + 1, 0), BUCKETS - 1).astype(np.int64)


def deleted_cells(pairs: DataFrame) -> DataFrame:
    """(context, pair, word, times): how many tokens of the deleted part have these counts in the other training texts."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for payload, answers in zip(b.column(0), b.column(1), strict=True):
                c = Counted.of(payload.as_py(), answers.as_py())
                counts = [x.astype(np.int64) for x in (c.context - c.context_deleted, c.pair - c.pair_deleted, c.word - c.word_deleted)]
                order = np.lexsort(counts)
                counts = [x[order] for x in counts]
                first = np.flatnonzero(np.concatenate([[True], np.any([x[1:] != x[:-1] for x in counts], axis=0)]))
                times = np.diff(np.append(first, len(order)))
                yield pa.RecordBatch.from_arrays([*(pa.array(x[first]) for x in counts), pa.array(times, pa.int64())], ["context", "pair", "word", "times"])

    return pairs.mapInArrow(tidied(gather), "context long, pair long, word long, times long").groupBy("context", "pair", "word").agg(F.sum("times").alias("times"))


def expectation_maximisation(cells: DataFrame, n_kept: int, floor: float, rounds: int = EM_ROUNDS, settled: float = SETTLED) -> np.ndarray:
    """Weights (bigram, unigram, uniform) of each bucket from all counts of ``deleted_cells``; ``PRIOR`` stands for one
    token more in each bucket and keeps every weight above 0. A bucket without tokens takes the weights of the next lower one
    that has some (the lowest those of ``PRIOR``). Contexts never seen get no bigram weight."""
    seen = F.col("context") > 0
    group = F.when(seen, F.least(F.floor(F.log2(F.greatest("context", F.lit(1)).cast("double")) + 1e-12) + 1, F.lit(BUCKETS - 1))).otherwise(0).cast("int")
    rows = materialize(cells.select(group.alias("bucket"), F.when(seen, F.col("pair") / F.col("context")).otherwise(0.0).alias("p2"), (F.col("word") / F.lit(float(max(n_kept, 1)))).alias("p1"), F.col("times").cast("double").alias("times")), "cells")
    prior = np.array(PRIOR)
    weights, met = np.tile(prior, (BUCKETS, 1)), np.zeros(BUCKETS, bool)
    for _ in range(rounds):
        w = [F.element_at(F.array(*map(F.lit, weights[:, k].tolist())), F.col("bucket") + 1) for k in range(3)]
        parts = [w[0] * F.col("p2"), w[1] * F.col("p1"), w[2] * F.lit(floor)]
        share = rows.withColumn("_s", F.col("times") / (parts[0] + parts[1] + parts[2]))
        sums = share.groupBy("bucket").agg(F.sum("times"), *(F.sum(F.col("_s") * p) for p in parts)).collect()
        new = weights.copy()
        for b, total, *s in sums:
            new[b], met[b] = (np.array(s) + prior) / (total + 1), True
        change, weights = np.abs(new - weights).max(), new
        if change < settled:
            break
    for b in range(1, BUCKETS):
        if not met[b]:
            weights[b] = weights[b - 1] if met[:b].any() else prior
    weights[0, 1:] /= weights[0, 1:].sum()
    weights[0, 0] = 0
    return weights


def score(documents: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every document.

    Learns from documents whose crc32(doc_id) mod 7 is not 2 (a null id counts as an empty text's); those
    with 3 are the deleted part. A null or empty text is its end token alone. Repeated rows count and are scored each.
    A corpus without training texts scores every token 1 / (V + 1) with V = 0. Only sums of the training part and per bucket
    reach the driver. Ids may be of any type.
    """
    spark = documents.sparkSession
    chunks = materialize(make_chunks(documents), "chunks")
    tokens_in_all, of_chunks = chunks.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), of_chunks // TASK_CHUNKS + 1)
    bits = max(0, int(np.ceil(np.log2(max(1, tokens_in_all / RANGE_TOKENS)))))
    answers = materialize(add_up(count_keys(chunks, bits), bits), "answers")
    n, n_deleted, distinct = (int(x or 0) for x in answers.where("chunk is null and kind = 1").agg(F.sum("n"), F.sum("n_deleted"), F.sum("distinct")).first())
    cells = deleted_cells(with_counts(chunks.where(F.col("part") == DELETED_PART), answers.where("held"), tasks))
    weights = spark.sparkContext.broadcast(expectation_maximisation(cells, n - n_deleted, 1 / (distinct + 1)))
    names = ["doc_id", "n_tokens", "n_known", "base_score", "score"]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for payload, found in zip(b.column(0), b.column(1), strict=True):
                c = Counted.of(payload.as_py(), found.as_py())
                mix = weights.value[bucket(c.context)]
                p = mix[:, 0] * c.pair / np.maximum(c.context, 1) + mix[:, 1] * c.word / max(n, 1) + mix[:, 2] / (distinct + 1)
                starts = np.cumsum(c.chunk.sizes) - c.chunk.sizes
                sums = [np.add.reduceat(x, starts) for x in ((c.word > 0).astype(np.int64), np.log10((c.word + 1) / (n + distinct + 1)), np.log10(p))]
                yield pa.RecordBatch.from_arrays([c.chunk.ids, pa.array(c.chunk.sizes, pa.int64()), *map(pa.array, sums)], names)

    scored = with_counts(chunks, answers, tasks).mapInArrow(tidied(judge), f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, n_tokens long, n_known long, base_score double, score double")
    held_out = F.coalesce(F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)) == TEST, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
