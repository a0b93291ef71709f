"""Monthly manifests as newline-delimited JSON."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import MANIFEST, schema
from .commits import Log

HASH = "^[0-9a-f]{64}$"


def parse_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Entries of JSON lines with ``problems``: what is wrong with a line (empty where it is good)."""
    parsed = lines.withColumn("_e", F.from_json(column, schema("manifest")))
    e = F.col("_e")
    checks = {
        "not an object": e.isNull() | F.get_json_object(column, "$").isNull(),
        "hash": ~F.coalesce(e["hash"].rlike(HASH), F.lit(False)),
        "file": F.coalesce(F.length(e["file"]) == 0, F.lit(True)),
        "kind": ~F.coalesce(e["kind"].isin("image", "video", "motion"), F.lit(False)),
        "bytes": F.coalesce(e["bytes"] < 0, F.lit(True)),
        "capturedAt": F.try_to_timestamp(e["capturedAt"]).isNull(),
    }
    problems = F.array_compact(F.array(*(F.when(bad, name) for name, bad in checks.items())))
    return parsed.select("_e.*", problems.alias("problems"))


def format_line(entry: Column) -> Column:
    """One line; empty keys are left out."""
    return F.to_json(entry)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Good entries under ``path``, with their month; months are folders, so a filter on month reads only those."""
    return spark.read.schema(MANIFEST + ", month string").json(path).where(F.col("hash").rlike(HASH))


def append(entries: DataFrame, path: str) -> None:
    """Add entries to the folder of their UTC month; no file is read or written anew."""
    entries.withColumn("month", F.substring("capturedAt", 1, 7)).write.partitionBy("month").mode("append").json(path)


def commit_append(entries: DataFrame, path: str) -> list[str]:
    """Add entries under ``path`` in one commit, of all their months together: new files are written apart, then named by the next version of each month's log.
    Months are not rewritten, writers at the same time lose no line (``commits.Log``), and readers see a month's lines of a commit whole or not
    at all. Returns the months."""
    spark = entries.sparkSession
    part = uuid.uuid4().hex
    entries.withColumn("month", F.substring("capturedAt", 1, 7)).write.partitionBy("month").json(f"{path}/parts/{part}")
    fs, p = Log(spark, path)._fs(f"{path}/parts/{part}")
    months = sorted(s.getPath().getName().removeprefix("month=") for s in fs.listStatus(p) if s.isDirectory())
    for month in months:
        Log(spark, f"{path}/months/{month}").commit(lambda s: {"parts": [*s.get("parts", []), part]})
    return months


def read_commits(spark: SparkSession, path: str, months: list[str] | None = None) -> DataFrame:
    """Committed good entries, with their month; only the named months' files are listed and read."""
    fs, p = Log(spark, path)._fs(f"{path}/months")
    there = sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []
    files = [f"{path}/parts/{part}/month={m}" for m in there if months is None or m in months for part in Log(spark, f"{path}/months/{m}").last()[1].get("parts", [])]
    if not files:
        return spark.createDataFrame([], MANIFEST + ", month string")
    month = F.regexp_extract(F.col("_metadata.file_path"), "/month=([^/]*)/", 1)
    return spark.read.schema(MANIFEST).json(files).withColumn("month", month).where(F.col("hash").rlike(HASH))
