"""Line dedup by overlapping three-line windows.

A line ends at a newline, or inside a paragraph after a sentence (``.``, ``!`` or ``?`` and a space) unless
``sentences`` is false, so that a repeated passage is found wherever it stands in its paragraph. A window is three consecutive
non-blank lines of a document. The windows that occur more than once in the corpus are found by their
hash; the first occurrence, by document and place, stays, and the lines that later occurrences cover go.
Overlapping windows cover the union of their lines, so a repeated passage of any length is removed whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, hot_keys, materialize, pieces_of, spread_join, table, tidied
from .shingles import constants, mix

WINDOW = 3


def line_array(text: Column, sentences: bool = True) -> Column:
    """The text's lines with what ends them; joined they are the text again."""
    return F.split(text, r"(?<=\n)|(?<=[.!?] )" if sentences else r"(?<=\n)")


def cut_lines(texts: pa.Array, sentences: bool = True) -> tuple[pa.Array, np.ndarray]:
    """The lines of all texts (as ``line_array``), and where each text's lines start among them, with their number at the end."""
    texts = texts.cast(pa.large_string())
    _, places, data = texts.buffers()
    places = np.frombuffer(places, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    byte = np.frombuffer(data, np.uint8)[: places[-1]] if data is not None else np.zeros(0, np.uint8)
    ends = byte == 10
    if sentences and len(byte):
        stop = np.isin(byte[:-1], np.frombuffer(b".!?", np.uint8)) & (byte[1:] == 32)
        stop[places[(places > 0) & (places < len(byte))] - 1] = False  # not from one text to the next
        ends[1:] |= stop
    cuts = np.unique(np.concatenate([places, np.flatnonzero(ends) + 1]))
    cuts = cuts[(cuts >= places[0]) & (cuts <= places[-1])]
    lines = pa.LargeStringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts.astype(np.int64)), data)
    return lines, np.searchsorted(cuts, places)


def key_of(text: Column) -> Column:
    """60 bits of the text's MD5, which tell rows with one doc_id apart (null text: as empty)."""
    return F.conv(F.substring(F.md5(F.coalesce(text, F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def windows(documents: DataFrame, width: int = WINDOW, sentences: bool = True) -> DataFrame:
    """(doc_id, key, first, last, hash, check, again): every window of every document.

    ``key`` is that of the text; first and last are places in ``line_array``; hash and check are 96 bits of the window's
    lines, trimmed; again marks a window that stands earlier in its document. A document of fewer lines than
    ``width`` is one window.
    """
    odd, other = constants(width, 3), constants(width, 17)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for whole in batches:
            for b in pieces_of(whole, most_bytes=4 << 20):
                texts = pc.fill_null(b.column(1), "")
                split, offsets = cut_lines(texts, sentences)
                trimmed = pc.utf8_trim(split, " \n")
                coded = pc.dictionary_encode(trimmed)
                names = coded.dictionary.to_pylist()
                own = np.fromiter((xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")) for t in names), np.uint64, len(names))
                codes = coded.indices.to_numpy()
                doc = np.repeat(np.arange(b.num_rows), np.diff(offsets))
                place = np.arange(len(doc)) - offsets[doc]
                full = codes != (names.index("") if "" in names else -1)
                doc, place, hashes = doc[full], place[full].astype(np.int32), own[codes[full]]
                lines = np.bincount(doc, minlength=b.num_rows)
                ends = np.cumsum(lines)
                start = np.arange(len(doc))
                start = start[(start + width <= ends[doc]) | (start == (ends - lines)[doc])]
                stop = np.minimum(start + width, ends[doc[start]])
                total, second = (stop - start).astype(np.uint64), np.zeros(len(start), np.uint64)
                for k in range(width):
                    at = start + k
                    inside = at < stop
                    total[inside] += hashes[at[inside]] * odd[k]
                    second[inside] += mix(hashes[at[inside]]) * other[k]
                value, check, row = mix(total), (mix(second) >> np.uint64(33)).astype(np.int32), doc[start]
                first = np.unique(mix(value + (row.astype(np.uint64) + np.uint64(1)) * odd[0]), return_index=True)[1]
                again = np.ones(len(row), bool)
                again[first] = False
                keys = np.fromiter((int(hashlib.md5(t.encode("utf-8", "surrogatepass")).hexdigest()[:15], 16) for t in texts.to_pylist()), np.int64, b.num_rows)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), pa.array(keys[row]), pa.array(place[start]), pa.array(place[stop - 1]), pa.array(value.view(np.int64)), pa.array(check), pa.array(again)], ["doc_id", "key", "first", "last", "hash", "check", "again"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(tidied(find), f"doc_id {kind}, key long, first int, last int, hash long, check int, again boolean")


def spans_to_remove(documents: DataFrame, width: int = WINDOW, sentences: bool = True) -> DataFrame:
    """(doc_id, key, spans): disjoint, sorted places (first, last) of the lines that go, for documents that lose any."""
    every = materialize(windows(documents, width, sentences), "windows")
    own = F.struct("doc_id", "key")
    repeated = every.where("not again").groupBy("hash", "check").agg(F.min(own).alias("_first"), F.count("*").alias("_rows")).where("_rows > 1")
    repeated = materialize(repeated, "repeated")
    later = spread_join(every.where("not again"), repeated.drop("_rows"), ["hash", "check"], ["doc_id", "key"], hot=hot_keys(repeated, ["hash", "check"])).where(~own.eqNullSafe(F.col("_first"))).select("doc_id", "key", "first", "last")
    gone = materialize(later.unionByName(every.where("again").select("doc_id", "key", "first", "last")).distinct(), "gone")
    discard(every, repeated)
    # Spans that touch are one island; each document's spans are sorted once and read once.
    document = Window.partitionBy("doc_id", "key").orderBy("first", "last")
    before = F.max("last").over(document.rowsBetween(Window.unboundedPreceding, -1))
    islands = gone.withColumn("_new", F.when(F.col("first") <= before + 1, 0).otherwise(1)).withColumn("_island", F.sum("_new").over(document))
    merged = islands.groupBy("doc_id", "key", "_island").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    return merged.groupBy("doc_id", "key").agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("spans"))


def dedup(documents: DataFrame, width: int = WINDOW, sentences: bool = True) -> DataFrame:
    """``documents`` with the columns n_removed and kept_text added (replaced if there).

    n_removed counts lines with text that go. Order is by doc_id (null first), then by the MD5 of the text, then by place: rows with
    one doc_id and different texts are documents of their own, rows with one doc_id and one text are the same document
    and share its fate. Blank lines go where the lines around them go; every other byte of a text stays. Null text has no lines and
    stays null; a text all of whose lines go is left empty. The first occurrence is a partial minimum per hash, and a
    very common window is cut among tasks (``spread_join``); only documents with something
    to remove bring places to the join with the texts, and only their texts are cut again, in time linear in their lines.
    """
    made = {"n_removed", "kept_text"}
    documents = documents.select(*(c for c in documents.columns if c not in made))
    names = list(documents.columns)
    boxed = documents.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"))
    gone = spans_to_remove(documents, width, sentences).select(F.struct(F.col("doc_id").alias("id"), "key", "spans").alias("cut"))
    joined = boxed.join(gone, F.col("row.doc_id").eqNullSafe(F.col("cut.id")) & (key_of(F.col("row.text")) == F.col("cut.key")), "left")
    joined = joined.withColumn("lines", F.when(F.col("cut").isNotNull(), line_array(F.col("row.text"), sentences)))
    spans, lines = F.col("cut.spans"), F.col("lines")
    start = lambda i: F.when(i == 0, 0).otherwise(F.get(spans, i - 1)["last"] + 1)
    stop = lambda i: F.when(i == F.size(spans), F.size(lines)).otherwise(F.get(spans, i)["first"])
    kept = F.array_join(F.transform(F.sequence(F.lit(0), F.size(spans)), lambda i: F.array_join(F.slice(lines, start(i) + 1, stop(i) - start(i)), "")), "")
    full = lambda s: F.size(F.filter(F.slice(lines, s["first"] + 1, s["last"] - s["first"] + 1), lambda x: F.trim(F.translate(x, "\n", " ")) != ""))
    removed = F.aggregate(F.transform(spans, full), F.lit(0).cast("long"), lambda n, s: n + s)
    uncut = F.col("cut").isNull()
    made = joined.select("row", F.when(uncut, F.lit(0).cast("long")).otherwise(removed).alias("n_removed"), F.when(uncut, F.col("row.text")).otherwise(kept).alias("kept_text"))
    return made.select("row.*", "n_removed", "kept_text")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_removed", "kept_text")


def op4_sql() -> str:
    return rf"""
WITH l AS (SELECT row_number() OVER () AS rid, doc_id, text, md5(coalesce(text, ''))[1:15] AS key, regexp_extract_all(coalesce(text, ''), '(?s).*?(?:\n|[.!?] )|.+') AS lines FROM documents),
c AS (SELECT rid, doc_id, key, i - 1 AS i, trim(translate(lines[i], chr(10), ' ')) AS t FROM l, unnest(range(1, len(lines) + 1)) AS r(i)),
d AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY i) AS n, count(*) OVER (PARTITION BY rid) AS m FROM c WHERE t <> ''),
w AS (SELECT rid, doc_id, key, n, m, i AS first, max(i) OVER a AS last, string_agg(t, chr(10)) OVER a AS body FROM d WINDOW a AS (PARTITION BY rid ORDER BY n ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING)),
later AS (SELECT rid, first, last FROM w WHERE n <= greatest(m - {WINDOW - 1}, 1) QUALIFY rank() OVER (PARTITION BY body ORDER BY doc_id NULLS FIRST, key, first) > 1),
gone AS (SELECT rid, list(DISTINCT i) AS g FROM later, unnest(range(first, last + 1)) AS r(i) GROUP BY rid),
lost AS (SELECT d.rid, count(*) AS n_removed FROM d JOIN gone USING (rid) WHERE list_contains(g, d.i) GROUP BY d.rid)
SELECT doc_id, coalesce(n_removed, 0)::bigint AS n_removed, CASE WHEN g IS NULL THEN text ELSE array_to_string(list_filter(lines, lambda x, i: NOT list_contains(g, i - 1)), '') END AS kept_text
FROM l LEFT JOIN gone USING (rid) LEFT JOIN lost USING (rid)
"""
