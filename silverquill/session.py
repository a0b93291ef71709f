"""Sessions and table access."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "silverquill", **settings: str) -> SparkSession:
    """A session in UTC with adaptive execution; ``settings`` use ``__`` for dots."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    for key, value in settings.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


_OWN: dict[str, str] = {}


def scratch_folder(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; where it is unset a local folder, in local mode only."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    app = spark.sparkContext.applicationId
    if named:
        return f"{named.rstrip('/')}/{app}"
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="silverquill-")
    return "file://" + _OWN[app]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
