"""The corpus pipeline: five stages from documents to packed sequences.

Each stage takes all that its predecessor kept and calls one operator of ``silverquill.llm``; all but the
last return the columns of ``documents``. Rows with equal doc_id and text are kept or dropped together by
the first two stages, and the third keeps one of them; rows with one doc_id (or none) and different texts are documents of
their own. An empty table passes through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from silverquill.llm.common import materialize, table
from silverquill.llm.lines import dedup
from silverquill.llm.mixing import mix
from silverquill.llm.near import near_duplicates
from silverquill.llm.packing import pack_documents
from silverquill.llm.quality import classify


def _matched(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """Rows of ``docs``, boxed as ``row``, joined with ``keys`` (id, hash, ...) on doc_id and the hash of the text: columns of any name
    stay apart from the stage's own, and rows with one doc_id and different texts are told apart."""
    boxed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.xxhash64("text").alias("own"))
    return boxed.join(keys.hint("merge"), F.col("row.doc_id").eqNullSafe(F.col("id")) & (F.col("own") == F.col("hash")), how)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; a null text is judged as an empty one. Labels belong to ids: rows with one doc_id and
    different texts are judged each by its text."""
    rejected = classify(docs, table(spark, sf_dir, "labels")).where("predicted = 0").select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash")).distinct()
    return _matched(docs, rejected, "left_anti").select("row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that later occurrences of a window cover go from the texts; a document that loses all its lines goes. Null and empty texts
    have no lines and stay as they are."""
    cut = dedup(docs)
    cut = cut.where(~((F.col("n_removed") > 0) & (F.trim(F.translate("kept_text", "\n\t\r", "   ")) == "")))
    return cut.select(*(F.col("kept_text").alias("text") if c == "text" else F.coalesce(F.length("kept_text"), F.lit(0)).cast("long").alias("n_chars") if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the least doc_id (null first) stays, once; null and empty texts are one group."""
    kept = near_duplicates(docs).where("kept").select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash")).distinct()
    alone = _matched(docs, kept, "left_semi")
    return alone.select("row", F.col("row.doc_id").alias("id"), "own").dropDuplicates(["id", "own"]).select("row.*")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document stands as many times in the mix as the mix takes it: its words taken by its size, rounded,
    where the fraction is a draw by the document's hash. Documents without words stay once. Rows with equal doc_id and text stand
    equally often, by what the mix takes of them together."""
    taken = mix(docs).groupBy(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash")).agg(F.sum("size").alias("size"), F.sum("taken").alias("taken"))
    draw = F.pmod(F.xxhash64("id", "hash", F.lit("mix")), F.col("size")) < F.expr("taken % size")
    times = taken.select("id", "hash", F.when(F.col("size") > 0, F.expr("taken div size") + draw.cast("long")).otherwise(1).cast("int").alias("times")).where("times > 0")
    mixed = _matched(docs, times, "inner")
    return mixed.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens; a document that the mix repeats is packed once for each copy."""
    return pack_documents(docs)


STAGES = [("quality classifier", quality), ("line dedup", line_dedup), ("near-dedup", near_dedup), ("mixing", mixing), ("best-fit packing", packing)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
