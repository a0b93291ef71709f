"""Best-fit packing after Martello-Toth dominance reduction.

Only the number of pieces of each length decides a packing, so the plan is made from a histogram of at
most ``capacity`` numbers, whatever the size of the corpus: a list of runs, each of which places a range
of pieces of one length. Pieces are then numbered within their length and looked up in the plan.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bucket_count, materialize, pieces_of, running_total, table, tidied
from .tokens import word_encoder

CAPACITY, END_ID, TOKENIZER = 4096, 1, "word_bpe_49k.json"


@dataclass
class Plan:
    """runs: (length, first number, pieces, first sequence, pieces in each sequence, offset in it)."""

    runs: list[tuple[int, int, int, int, int, int]] = field(default_factory=list)
    sequences: int = 0
    reduced: int = 0
    """Sequences fixed by dominance."""

    def place(self, lengths: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of the pieces with these lengths and numbers within their length."""
        runs = np.array(sorted(self.runs), np.int64).reshape(-1, 6)
        key = (runs[:, 0] << 46) + runs[:, 1]
        r = runs[np.searchsorted(key, (lengths.astype(np.int64) << 46) + numbers, "right") - 1]
        k = numbers - r[:, 1]
        return r[:, 3] + k // r[:, 4], r[:, 5] + k % r[:, 4] * r[:, 0]


def plan_packing(histogram: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Pack ``histogram[length]`` pieces of each length into sequences of ``capacity``."""
    left = [0] * (capacity + 1)
    for length, n in histogram.items():
        if not 1 <= length <= capacity:
            raise ValueError(f"a piece of {length} tokens")
        left[length] += n
    plan, taken = Plan(), defaultdict(int)

    def fix(n: int, lengths: list[int]) -> None:
        at = 0
        for length in lengths:
            plan.runs.append((length, taken[length], n, plan.sequences, 1, at))
            taken[length] += n
            left[length] -= n
            at += length
        plan.sequences += n
        plan.reduced += n

    def smallest(k: int, but: int) -> int | None:
        """Sum of the k smallest pieces beside one of length ``but``; None: there are fewer."""
        total = 0
        for x in present:
            n = min(left[x] - (x == but), k)
            total, k = total + n * x, k - n
            if not k:
                return total
        return None

    changed = True
    while changed:
        changed = False
        present = [x for x in range(1, capacity + 1) if left[x]]
        for length in reversed(present):
            while left[length]:
                room, n = capacity - length, left[length]
                if room and (left[room] if room != length else left[length] > 1):  # an exact filling dominates every set
                    fix(min(n, left[room]) if room != length else n // 2, [length, room])
                    changed = True
                    continue
                one, two, three = (smallest(k, length) for k in (1, 2, 3))
                if one is None or one > room:  # nothing goes beside it
                    fix(1 if one is None or one <= length <= room else n, [length])
                    changed = True
                    continue
                i = bisect_left(present, room + 1) - 1
                while left[present[i]] - (present[i] == length) <= 0:
                    i -= 1
                best = present[i]
                if two is None or two > room:  # one piece at most: the largest dominates
                    fix(min(n, left[best]) if best != length else max(1, n // 2), [length, best])
                    changed = True
                    continue
                if three is None or three > room:  # two at most
                    second = _largest(left, present, room - best, {length: 1, best: 1})
                    most = _largest_lesser(left, present, room, length)
                    if second and most <= second and len({length, best, second}) == 3:
                        fix(min(n, left[best], left[second]), [length, best, second])
                        changed = True
                        continue
                break

    _best_fit(left, taken, plan, capacity)
    return plan


def _largest(left: list[int], present: list[int], room: int, used: dict[int, int]) -> int:
    for i in range(bisect_left(present, room + 1) - 1, -1, -1):
        if left[present[i]] > used.get(present[i], 0):
            return present[i]
    return 0


def _largest_lesser(left: list[int], present: list[int], room: int, but: int) -> int:
    """The largest y such that pieces x >= y, beside one of length ``but``, fit into ``room`` together."""
    for i in range(bisect_left(present, room // 2 + 1) - 1, -1, -1):
        y = present[i]
        n = left[y] - (y == but)
        if n <= 0:
            continue
        if n > 1:
            return y
        j = i + 1
        while j < len(present) and present[j] <= room - y:
            if left[present[j]] - (present[j] == but) > 0:
                return y
            j += 1
    return 0


def _best_fit(left: list[int], taken: dict[int, int], plan: Plan, capacity: int) -> None:
    """Best-fit decreasing over classes: bins with the same residue are one group (bins, first sequence)."""
    groups: dict[int, list[tuple[int, int]]] = defaultdict(list)
    residues: list[int] = []

    def put(residue: int, bins: int, first: int) -> None:
        if bins and residue:
            if not groups[residue]:
                insort(residues, residue)
            groups[residue].append((bins, first))

    for length in range(capacity, 0, -1):
        n = left[length]
        while n:
            i = bisect_left(residues, length)
            if i < len(residues):
                room = residues[i]
                bins, first = groups[room].pop()
                if not groups[room]:
                    residues.pop(i)
            else:
                room, first = capacity, plan.sequences
                bins = -(-n // (capacity // length))
                plan.sequences += bins
            per, at = room // length, capacity - room
            full = min(bins, n // per)
            rest = min(n - full * per, per) if full < bins else 0
            if full:
                plan.runs.append((length, taken[length], full * per, first, per, at))
                taken[length] += full * per
                put(room - per * length, full, first)
            if rest:
                plan.runs.append((length, taken[length], rest, first + full, rest, at))
                taken[length] += rest
                put(room - rest * length, 1, first + full)
            put(room, bins - full - bool(rest), first + full + bool(rest))
            n -= full * per + rest


def token_pieces(documents: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids and ``end_id``, cut at ``capacity``."""
    schema = f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long"
    names = [f.split()[0] for f in schema.split(", ")]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(tokenizer)
        for whole in batches:
            for b in pieces_of(whole, most_bytes=4 << 20):
                ids, sizes = encoder.encode(b.column(1))
                pa.default_memory_pool().release_unused()
                ends = np.cumsum(sizes)
                which, piece, start, length, crc = [], [], [], [], []
                for i, (a, z) in enumerate(zip((ends - sizes).tolist(), ends.tolist(), strict=True)):
                    own = np.append(ids[a:z], np.uint32(end_id)).astype("<u4")
                    for k, at in enumerate(range(0, len(own), capacity)):
                        part = own[at : at + capacity]
                        which.append(i)
                        piece.append(k)
                        start.append(at)
                        length.append(len(part))
                        crc.append(zlib.crc32(part))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(which, pa.int32())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], names)

    return documents.select("doc_id", "text").mapInArrow(tidied(cut), schema)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to ``pieces`` (doc_id, piece, length, ...).

    The histogram (at most ``capacity`` rows) is all that reaches the driver. Pieces of one length are
    numbered by hash buckets, so that a length shared by a third of all pieces is spread; the plan, whose
    size depends on the number of lengths and not on the corpus, is broadcast. An empty table gives an
    empty one; repeated rows are packed like any others; the columns sequence_id and offset are replaced, any other column stays,
    whatever its name.
    """
    spark = pieces.sparkSession
    pieces = pieces.drop("sequence_id", "offset")
    histogram = {r[0]: r[1] for r in pieces.groupBy("length").agg(F.count("*")).collect()}
    plan = spark.sparkContext.broadcast(plan_packing(histogram, capacity))
    buckets = bucket_count(sum(histogram.values()))
    columns = [F.col(f"`{c}`") for c in pieces.columns]
    boxed = pieces.select(F.struct(*columns).alias("row"), "length", "doc_id", "piece", F.lit(1).alias("one"))
    numbered = running_total(boxed, "length", ["doc_id", "piece"], "one", "number", buckets).select("row", F.col("length").cast("long"), "number")

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sequence, offset = plan.value.place(*(b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (1, 2)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], ["row", "sequence_id", "offset"])

    schema = f"row {boxed.schema['row'].dataType.simpleString()}, sequence_id long, offset long"
    return numbered.mapInArrow(look, schema).select("row.*", "sequence_id", "offset")


def pack_documents(documents: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Tokenize, cut and pack whole documents (null text: empty, one end id). Ids may be of any type."""
    return pack(materialize(token_pieces(documents, capacity), "pieces"), capacity)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
