"""Exports made from the given documents: folders of 24 documents each, where a document's id and length choose its file among the cases below.

The cases are those of one archive in three parts. A folder tree ``r<number>`` has those that its documents choose, so sidecars, variants and
halves of pairs are there or missing as they fall.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table

# (part, dir, name, sidecar flags archived/trashed)
MEDIA = (
    (1, "Photos from 2019", "IMG_1234.jpg", False, False),
    (1, "Photos from 2019", "IMG_1234(1).jpg", False, False),
    (1, "Photos from 2019", "2019-06-08_family_reunion_backyard_barbecue_photo.jpg", False, False),
    (1, "Iceland 2019", "IMG_2001.HEIC", False, False),
    (1, "Iceland 2019", "IMG_2001.MOV", False, False),
    (1, "Iceland 2019", "IMG_2002.jpg", False, False),
    (1, "Iceland 2019", "IMG_2002-edited.jpg", False, False),
    (2, "Familienurlaub 2020", "IMG_3001.jpg", False, False),
    (2, "Familienurlaub 2020", "IMG_3001-bearbeitet.jpg", False, False),
    (2, "Familienurlaub 2020", "IMG_3002.jpg", False, False),
    (2, "Familienurlaub 2020", "IMG_3002-modifié.jpg", False, False),
    (2, "Familienurlaub 2020", "IMG_3002-editado.jpg", False, False),
    (2, "Photos from 2021", "IMG_0042.JPG", False, False),
    (2, "Photos from 2021", "VID_20210704_121314.mp4", False, False),
    (3, "Photos from 2021", "IMG_7777.jpg", False, False),
    (2, "Archive", "IMG_5001.jpg", True, False),
    (3, "Trash", "IMG_8001.jpg", False, True),
    (1, "Edge cases", "A.png", False, False),
    (1, "Edge cases", "A.mov", False, False),
    (1, "Edge cases", "B.heic", False, False),
    (1, "Edge cases", "B.jpg", False, False),
    (1, "Edge cases", "B.MOV", False, False),
    (1, "Edge cases", "C.gif", False, False),
    (1, "Edge cases", "D-edited.webp", False, False),
    (1, "Edge cases", "D.jpg", False, False),
    (1, "Edge cases", "D.png", False, False),
    (1, "Edge cases", "E.heic", False, False),
    (1, "Edge cases", "E.mov", False, False),
    (1, "Edge cases", "E.MOV", False, False),
)
SIDECARS = (
    ("Photos from 2019", "IMG_1234.jpg.json"),
    ("Photos from 2019", "IMG_1234.jpg(1).json"),
    ("Photos from 2019", "2019-06-08_family_reunion_backyard_barbecue_ph.json"),
    ("Iceland 2019", "IMG_2001.HEIC.supplemental-metadata.json"),
    ("Iceland 2019", "IMG_2002.jpg.json"),
    ("Familienurlaub 2020", "IMG_3001.jpg.supplemental-metadata.json"),
    ("Familienurlaub 2020", "IMG_3001-bearbeitet.jpg.supplemental-metadata.json"),
    ("Familienurlaub 2020", "IMG_3002.jpg.json"),
    ("Photos from 2021", "IMG_0042.jpg.json"),
    ("Photos from 2021", "IMG_7777.jpg.json"),
    ("Archive", "IMG_5001.jpg.json"),
    ("Trash", "IMG_8001.jpg.json"),
    ("Edge cases", "A.xyz.json"),
    ("Edge cases", "B.heic.json"),
    ("Edge cases", "C.1.json"),
    ("Edge cases", "C.2.json"),
)
# (name, sidecar seconds, EXIF time, EXIF offset, file time in ms)
TIMES = (
    ("exact", "1560003751", "2019:06:01 08:00:00", None, 1705313730000),
    ("zero-sidecar", "0", "2019:06:01 08:00:00", "+02:00", 1705313730000),
    ("exif-only", None, "2019:08:14 11:02:44", "-03:30", 1705313730000),
    ("same-instant", "1565780564", "2019:08:14 11:02:44", "+00:00", 1705313730000),
    ("mtime", None, None, None, 1625400794000),
    ("bad-exif", None, "2019:13:40 11:02:44", None, 1625400794000),
    ("bad-sidecar", "12x", None, None, 1625400794000),
)


def values(rows, names: str) -> str:
    """Rows as a SQL table that both engines read."""

    def lit(v) -> str:
        return "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"

    return "(VALUES " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows) + f") AS t({names})"


ROOT = 24
"""Documents in one folder tree."""


def _numbered(rows) -> tuple:
    return tuple((i, *r) for i, r in enumerate(rows))


_MEDIA, _SIDECAR, _TIMES = values(_numbered(MEDIA), "i, part, folder, name, archived, trashed"), values(_numbered(SIDECARS), "i, folder, name"), values(_numbered(TIMES), "i, name, sidecar_s, exif, exif_offset, mtime_ms")
_CHOICE = "(doc_id * {0} + coalesce(n_chars, 0)) % {1}"
MEDIA_SQL = f"(SELECT part, concat('r', doc_id // {ROOT}, '/', folder) AS dir, folder, name, archived, trashed FROM documents JOIN {_MEDIA} ON {_CHOICE.format(7, len(MEDIA))} = i) AS media"
SIDECAR_SQL = f"(SELECT concat('r', doc_id // {ROOT}, '/', folder) AS dir, folder, name FROM documents JOIN {_SIDECAR} ON {_CHOICE.format(5, len(SIDECARS))} = i) AS sidecars"
METADATA_SQL = f"(SELECT DISTINCT concat('r', doc_id // {ROOT}, '/Iceland 2019') AS dir FROM documents WHERE doc_id // {ROOT} % 2 = 0) AS metadata"
TIMES_SQL = f"(SELECT concat(name, '-', doc_id) AS name, CASE WHEN length(sidecar_s) > 3 THEN (sidecar_s::BIGINT + doc_id)::VARCHAR ELSE sidecar_s END AS sidecar_s, exif, exif_offset, mtime_ms + doc_id * 1000 AS mtime_ms FROM documents JOIN {_TIMES} ON {_CHOICE.format(3, len(TIMES))} = i) AS times"


def _chosen(spark: SparkSession, sf_dir: str, cases: str, factor: int, n: int) -> DataFrame:
    """A row of ``cases`` (a fixed list) for each document, with ``doc_id`` and the folder tree ``root``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.expr(_CHOICE.format(factor, n)).alias("i"), F.concat(F.lit("r"), F.expr(f"doc_id div {ROOT}").cast("string")).alias("root"))
    return docs.join(F.broadcast(spark.sql(f"SELECT * FROM {cases}")), "i").drop("i")


def media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chosen(spark, sf_dir, _MEDIA, 7, len(MEDIA)).select("part", F.concat_ws("/", "root", "folder").alias("dir"), "folder", "name", "archived", "trashed")


def sidecars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chosen(spark, sf_dir, _SIDECAR, 5, len(SIDECARS)).select(F.concat_ws("/", "root", "folder").alias("dir"), "folder", "name")


def metadata_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.expr(f"doc_id div {ROOT}").alias("r")).where("r % 2 = 0").distinct()
    return d.select(F.concat(F.lit("r"), F.col("r").cast("string"), F.lit("/Iceland 2019")).alias("dir"))


def times(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _chosen(spark, sf_dir, _TIMES, 3, len(TIMES))
    later = F.when(F.length("sidecar_s") > 3, (F.expr("try_cast(sidecar_s AS bigint)") + F.col("doc_id")).cast("string")).otherwise(F.col("sidecar_s"))
    return t.select(F.concat_ws("-", "name", F.col("doc_id").cast("string")).alias("name"), later.alias("sidecar_s"), "exif", "exif_offset", (F.col("mtime_ms") + F.col("doc_id") * 1000).alias("mtime_ms"))
