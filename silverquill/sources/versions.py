"""Forward-only migrations of a table folder."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Sequence

from pyspark.sql import SparkSession

Step = Callable[[SparkSession, str], None]


class MigrationError(RuntimeError):
    """Steps out of order, or a folder written by a later version."""


def _file(spark: SparkSession, folder: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/schema_version.json")
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def current_version(spark: SparkSession, folder: str) -> int:
    """0 for a folder without a version file."""
    fs, path = _file(spark, folder)
    if not fs.exists(path):
        return 0
    text = spark.read.option("wholetext", "true").text(path.toString()).first()[0]
    version = str(json.loads(text)["version"])
    if not re.fullmatch(r"\d+", version):
        raise MigrationError(f"version {version!r}")
    return int(version)


def migrate(spark: SparkSession, folder: str, steps: Sequence[tuple[int, Step]]) -> int:
    """Apply the steps after the folder's version, recording each; returns the version reached."""
    if [n for n, _ in steps] != list(range(1, len(steps) + 1)):
        raise MigrationError("steps must be numbered from 1 without gaps")
    now = current_version(spark, folder)
    if now > len(steps):
        raise MigrationError(f"version {now} is later than {len(steps)}")
    fs, path = _file(spark, folder)
    for number, step in steps[now:]:
        step(spark, folder)
        out = fs.create(path, True)
        out.write(bytearray(json.dumps({"version": number}).encode()))
        out.close()
    return len(steps)
