"""Inverted index and BM25."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.udf import CJK, counted_tokens, term_counts, tokens

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6


@dataclass(frozen=True)
class Atom:
    """One search term; ``prefix`` matches every token that starts with it."""

    text: str
    prefix: bool = False


def fold_text(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.category(c).startswith("M")).lower()


def parse_query(query: str, prefixes: bool = True, cjk_split: bool = False) -> list[Atom]:
    """Terms of a query; a word's last token is a prefix if the word ends in ``*`` (and ``prefixes`` is set)."""
    atoms = []
    for word in query.split():
        folded = fold_text(word)
        if cjk_split:
            folded = re.sub(f"([{CJK}])", r" \1 ", folded)
        parts = [t for t in re.split(r"[\W_]+", folded) if t]
        atoms += [Atom(t, prefixes and word.endswith("*") and i == len(parts) - 1) for i, t in enumerate(parts)]
    return list(dict.fromkeys(atoms))


def token_rows(docs: DataFrame, key: str, text: str, cjk_split: bool = False) -> DataFrame:
    return docs.select(key, F.explode(tokens(F.col(text), cjk_split)).alias("token"))


def postings(docs: DataFrame, key: str, text: str, cjk_split: bool = False) -> DataFrame:
    """(token, key, tf). Counted before it moves: a document's tokens are in one task, so the exchange holds
    a row for each distinct token of a document."""
    return summed_postings(each_posting(counted_tokens(docs, key, text, cjk_split), key), key)


def each_posting(counted: DataFrame, key: str) -> DataFrame:
    """(token, key, tf) of the rows of ``counted_tokens``; rows of one key are not yet one."""
    return counted.select(key, F.explode(F.arrays_zip("tokens", "tf")).alias("_p")).select(F.col("_p.tokens").alias("token"), key, F.col("_p.tf").alias("tf"))


def summed_postings(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy("token", key).agg(F.sum("tf").cast("int").alias("tf"))


def sorted_postings(rows: DataFrame, key: str) -> DataFrame:
    """Postings dealt by ranges of token and key and sorted in them; those of one token and key meet there, so nothing else moves."""
    return summed_postings(rows.repartitionByRange("token", key), key).sortWithinPartitions("token", key)


def summed_lengths(counted: DataFrame, key: str) -> DataFrame:
    """(key, token_count) of the rows of ``counted_tokens``."""
    return counted.groupBy(key).agg(F.sum("token_count").cast("int").alias("token_count"))


def document_lengths(docs: DataFrame, key: str, text: str, cjk_split: bool = False) -> DataFrame:
    """(key, token_count), blank documents left out."""
    return docs.select(key, term_counts(F.col(text), [], cjk_split)["length"].alias("token_count")).where("token_count > 0")


def document_frequency(index: DataFrame, key: str) -> DataFrame:
    return index.groupBy("token").agg(F.count("*").alias("df"))


def _matches(atom: Atom, token: Column) -> Column:
    return token.startswith(atom.text) if atom.prefix else token == atom.text


def bm25(index: DataFrame, lengths: DataFrame, key: str, atoms: list[Atom], limit: int | None = 100, allowed: DataFrame | None = None) -> DataFrame:
    """(key, score): documents that hold every atom, best (most negative) first; ``allowed`` (key) restricts them before they are scored, not the corpus's sums.

    Only the atoms' postings are read on, which a token-sorted index prunes to few row groups. Document frequencies and corpus sums are one row
    per atom, broadcast; the postings of a document meet in one group of at most a few rows per atom.
    """
    if not atoms:
        return lengths.select(key, F.lit(0.0).alias("score")).limit(0)
    wanted = F.lit(False)
    for a in atoms:
        wanted = wanted | _matches(a, F.col("token"))
    kinds = F.array(*(F.when(_matches(a, F.col("token")), F.lit(i)) for i, a in enumerate(atoms)))
    hits = index.where(wanted).select(key, F.explode(F.array_compact(kinds)).alias("atom"), "tf").groupBy(key, "atom").agg(F.sum("tf").alias("tf"))
    corpus = lengths.agg(F.count("*").alias("n"), F.coalesce(F.nullif(F.avg("token_count"), F.lit(0.0)), F.lit(1.0)).alias("average"))
    held = hits.groupBy("atom").agg(F.count("*").alias("df"))  # a row per atom
    weights = held.join(F.broadcast(corpus)).select("atom", "average", _idf(F.col("n"), F.col("df")).alias("idf"))
    wanted_hits = hits if allowed is None else hits.join(allowed.select(key), key, "left_semi")
    scored = wanted_hits.join(F.broadcast(weights), "atom").join(lengths, key)
    part = F.col("idf") * (F.col("tf") * (K1 + 1)) / (F.col("tf") + K1 * (1 - B + B * F.col("token_count") / F.col("average")))
    out = scored.withColumn("_p", part).groupBy(key).agg(F.count("*").alias("_n"), (-F.sum("_p")).alias("score")).where(F.col("_n") == len(atoms)).select(key, "score")
    return out.orderBy("score", key).limit(limit) if limit else out


def _idf(n: Column, df: Column) -> Column:
    raw = F.log((n - df + 0.5) / (df + 0.5))
    return F.when(raw <= 0, LEAST_IDF).otherwise(raw)


def search(docs: DataFrame, key: str, text: str, query: str, limit: int | None = 100, prefixes: bool = False, cjk_split: bool = False) -> DataFrame:
    """BM25 over unindexed documents, whose texts are read and cut once.

    A document's length and term frequencies are counted in Arrow; only these numbers meet in an exchange, which the corpus's sums and
    the scores both read. ``write_index`` and ``search_index`` answer alike without reading texts.
    """
    atoms = parse_query(query, prefixes, cjk_split)
    if not atoms:
        return docs.select(key, F.lit(0.0).alias("score")).limit(0)
    counted = docs.select(key, term_counts(F.col(text), [(a.text, a.prefix) for a in atoms], cjk_split).alias("_c"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counted = counted.select(key, F.col("_c.length").alias("_len"), F.col("_c.tf").alias("_tf")).repartition(parts, key)
    held = [F.count_if((F.col("_tf")[i] > 0) & (F.col("_len") > 0)).alias(f"_df{i}") for i in range(len(atoms))]
    corpus = counted.agg(F.count_if(F.col("_len") > 0).alias("_n"), F.avg(F.when(F.col("_len") > 0, F.col("_len"))).alias("_av"), *held)
    # The condition names the corpus, so that it stays above the exchange and both sides read the same one.
    rows = counted.join(F.broadcast(corpus)).where(F.when(F.col("_n") > 0, F.forall("_tf", lambda t: t > 0)).otherwise(False))
    part = lambda i: _idf(F.col("_n"), F.col(f"_df{i}")) * (F.col("_tf")[i] * (K1 + 1)) / (F.col("_tf")[i] + K1 * (1 - B + B * F.col("_len") / F.col("_av")))
    total = part(0)
    for i in range(1, len(atoms)):
        total = total + part(i)
    out = rows.select(key, (-total).alias("score"))
    return out.orderBy("score", key).limit(limit) if limit else out


def write_index(docs: DataFrame, key: str, text: str, folder: str, cjk_split: bool = False) -> None:
    """Postings sorted by token and document lengths, as Parquet under ``folder``: a search reads the row groups of its tokens only.

    Texts are read and cut once: what a document holds is stored under ``counted``, which the lengths, the ranges of tokens and the postings read.
    """
    spark = docs.sparkSession
    counted_tokens(docs, key, text, cjk_split).write.mode("overwrite").parquet(f"{folder}/counted")
    counted = spark.read.parquet(f"{folder}/counted")
    summed_lengths(counted, key).write.mode("overwrite").parquet(f"{folder}/lengths")
    sorted_postings(each_posting(counted, key), key).write.mode("overwrite").parquet(f"{folder}/postings")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/counted")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def search_index(spark: SparkSession, folder: str, key: str, query: str, limit: int | None = 100, prefixes: bool = False, cjk_split: bool = False, allowed: DataFrame | None = None) -> DataFrame:
    """BM25 from a stored index; ``allowed`` (key) restricts what is scored, not the corpus's sums."""
    return bm25(spark.read.parquet(f"{folder}/postings"), spark.read.parquet(f"{folder}/lengths"), key, parse_query(query, prefixes, cjk_split), limit, allowed)


def index_upsert(index: DataFrame, docs: DataFrame, key: str, text: str) -> DataFrame:
    """Postings after ``docs`` are indexed anew; blank texts leave the old postings."""
    fresh = docs.where(F.length(F.trim(F.coalesce(text, F.lit("")))) > 0)
    return index.join(fresh.select(key), key, "left_anti").unionByName(postings(fresh, key, text).select(*index.columns))


def ranked(df: DataFrame, score: Column, key: str) -> DataFrame:
    """Rank from 1 over a bounded result: the window holds the limited rows only."""
    return df.withColumn("rank", F.row_number().over(Window.orderBy(score, key)))
