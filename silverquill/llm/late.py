"""A partitioned layout kept up to date by signed deltas as late rows arrive.

The layout keeps the latest-arrived row of each key, cut by day into sorted Parquet files of a given number of rows. Late rows that win
over what is stored emit a delta: minus the stored row, plus the new one. The days of the delta are dirty. The stored rows of
dirty days and the delta are consolidated by adding up weights, ranked again and written anew; all other files stay.

Rows are ranked by ranges over tasks (``ordered_index``), so a day may hold any share of them. A file goes through one task,
sorted and streamed. The driver sees file names and days, not rows.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, TimestampNTZType

from .common import crc32_of_id, materialize, ordered_index, scratch_root, scratch_scope, table

CUTOFF, FILES, COPY_OF, COPY_DAYS = "2024-04-10 00:00:00", 700, 3, 7
START, LATE = "start", "late"
DAY_US = 86_400_000_000


def micros(column: str, schema: StructType) -> Column:
    """Microseconds since 1970 in UTC, whatever the session's zone; a timestamp without a zone is one in UTC."""
    c = F.col(column)
    if isinstance(schema[column].dataType, TimestampNTZType):
        second = F.call_function("extract", F.lit("SECOND"), c).cast("decimal(8,6)")
        return F.datediff(c.cast("date"), F.lit("1970-01-01").cast("date")).cast("long") * DAY_US + F.hour(c).cast("long") * 3_600_000_000 + F.minute(c).cast("long") * 60_000_000 + (second * 1_000_000).cast("long")
    return F.unix_micros(c)


def day_of(us: Column) -> Column:
    """Whole days since 1970; -1 for null."""
    return F.coalesce(F.call_function("div", us - F.pmod(us, F.lit(DAY_US)), F.lit(DAY_US)), F.lit(-1).cast("long"))


def with_copies(sales: DataFrame) -> DataFrame:
    """``sales`` and the corrected copies that arrive later, for some keys of every seventh day."""
    h = crc32_of_id("sale_id")
    later = {"total": F.col("total") + 1, "sold_at": F.col("sold_at") + F.make_dt_interval((h % 2).cast("int")), "arrived_at": F.col("arrived_at") + F.make_dt_interval((h % 97 + 1).cast("int"))}
    chosen = sales.where((h % COPY_OF == 0) & (day_of(micros("sold_at", sales.schema)) % COPY_DAYS == 0))
    copies = chosen.select(*((later[c].cast(sales.schema[c].dataType) if c in later else F.col(f"`{c}`")).alias(c) for c in sales.columns))
    return sales.unionByName(copies)


def boxed(sales: DataFrame) -> DataFrame:
    """(row, _sale, _sold, _arrived, _day): the whole row, and what ranks it."""
    sold, arrived = (micros(c, sales.schema) for c in ("sold_at", "arrived_at"))
    return sales.select(F.struct(*(F.col(f"`{c}`") for c in sales.columns)).alias("row"), F.col("sale_id").alias("_sale"), sold.alias("_sold"), arrived.alias("_arrived"), day_of(sold).alias("_day"))


def winners(rows: DataFrame) -> DataFrame:
    """The latest-arrived row of each key; a null arrival is earliest, of rows that arrive together the greatest by its columns wins. Partial maxima go before the shuffle."""
    best = rows.groupBy("_sale").agg(F.max(F.struct(F.coalesce("_arrived", F.lit(-(1 << 63))).alias("at"), "row", "_sold", "_arrived", "_day")).alias("b"))
    return best.select("b.row", "_sale", "b._sold", "b._arrived", "b._day")


@dataclass(frozen=True)
class Layout:
    """Files ``day{day}-file{file_no}-{generation}.parquet`` in one folder."""

    spark: SparkSession
    root: str
    schema: StructType
    rows_per_file: int

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def names(self) -> list[str]:
        fs, p = self._fs(self.root)
        return [s.getPath().getName() for s in fs.listStatus(p) if s.getPath().getName().endswith(".parquet")]

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.root)

    def write(self, rows: DataFrame, generation: str, replaced_days: set[int] = frozenset()) -> None:
        """Write ``rows`` (``boxed``, one per key) as new files, which then take the place of all files of ``replaced_days``."""
        ranked = ordered_index(rows.select("row", "_sale", "_sold", "_day"), ["_day"], ["_sold", "_sale"], "late-ranked").withColumn("_file", F.expr(f"_index div {self.rows_per_file}"))
        day, file = _free("day", self.schema), _free("file_no", self.schema)
        dealt = ranked.repartition(int(self.spark.conf.get("spark.sql.shuffle.partitions")), "_day", "_file").sortWithinPartitions("_day", "_file", "_index")
        staged = f"{self.root}/_staged-{uuid.uuid4().hex}"
        dealt.select("row.*", F.col("_day").alias(day), F.col("_file").alias(file)).write.partitionBy(day, file).option("compression", "zstd").parquet(staged)
        fs, p = self._fs(staged)
        Path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        for old in self.names():
            if int(old.removeprefix("day").split("-file")[0]) in replaced_days:
                fs.delete(Path(f"{self.root}/{old}"), False)
        for d in fs.listStatus(p):
            if d.isDirectory():
                for f in fs.listStatus(d.getPath()):
                    (part,) = [x.getPath() for x in fs.listStatus(f.getPath()) if x.getPath().getName().endswith(".parquet")]
                    name = f"day{d.getPath().getName().split('=')[1]}-file{f.getPath().getName().split('=')[1]}-{generation}.parquet"
                    if not fs.rename(part, Path(f"{self.root}/{name}")):
                        raise OSError(f"can't rename {part}")
        fs.delete(p, True)

    def digests(self) -> DataFrame:
        """(day, file_no, n_rows, cents, rows_crc, path, columns, ids_sha256, rewritten) of every file, read back; ids are hashed in the file's order."""
        names = self.names()
        kinds = "file string, n_rows long, cents long, rows_crc long, ids_sha256 string"
        read = self.spark.read.option("mergeSchema", "true").parquet(self.root) if names else self.read()  # all footers
        text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
        crc = F.crc32(F.concat(text(F.col("sale_id")), F.lit(":"), text(micros("sold_at", read.schema)), F.lit(":"), text(micros("arrived_at", read.schema))).cast("binary"))
        rows = read.select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("at"), text(F.col("sale_id")).alias("id"), F.coalesce(F.floor(F.col("total") * 100 + 0.5), F.lit(0)).cast("long").alias("cents"), crc.alias("crc"))
        dealt = rows.repartition(int(self.spark.conf.get("spark.sql.shuffle.partitions")), "file").sortWithinPartitions("file", "at").drop("at")
        each = dealt.mapInArrow(_digest_files, kinds)
        part = lambda k: F.regexp_extract("file", r"^day(-?\d+)-file(\d+)-", k).cast("long")
        shown = self.root.removeprefix("file://") if self.root.startswith("file:///") else self.root
        return each.select(part(1).alias("day"), part(2).alias("file_no"), "n_rows", "cents", "rows_crc", F.concat(F.lit(f"{shown}/"), "file").alias("path"), F.lit(",".join(read.columns)).alias("columns"), "ids_sha256", F.col("file").endswith(f"-{LATE}.parquet").alias("rewritten"))


def _free(name: str, schema: StructType) -> str:
    """``name``, or a longer one where ``schema`` has it."""
    taken = {f.name.lower() for f in schema}
    while name in taken:
        name += "_"
    return name


def _digest_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each run of rows of one file; memory is that of a batch."""
    names = ["file", "n_rows", "cents", "rows_crc", "ids_sha256"]
    now, n, cents, crc, ids = None, 0, 0, 0, hashlib.sha256()

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([now]), *(pa.array([x], pa.int64()) for x in (n, cents, crc)), pa.array([ids.hexdigest()])], names)

    for b in batches:
        if not b.num_rows:
            continue
        runs = pc.run_end_encode(b.column(0))
        start = 0
        for file, end in zip(runs.values.to_pylist(), runs.run_ends.to_pylist(), strict=True):
            if file != now:
                if now is not None:
                    yield done()
                now, n, cents, crc, ids = file, 0, 0, 0, hashlib.sha256()
            some = b.slice(start, end - start)
            ids.update(("," * (n > 0) + ",".join(some.column(1).to_pylist())).encode())
            n += some.num_rows
            cents += int(np.sum(some.column(2).to_numpy(), dtype=np.int64))
            crc += int(np.sum(some.column(3).to_numpy(), dtype=np.int64))
            start = end
    if now is not None:
        yield done()


def delta(stored: DataFrame, late: DataFrame) -> DataFrame:
    """(weight, row, _sale, _sold, _arrived, _day): for each late winner that wins over the stored row of its key, minus the stored row (if any) and plus the new one."""
    rank = lambda arrived, row: F.struct(F.coalesce(arrived, F.lit(-(1 << 63))), row)
    names = ["row", "_sale", "_sold", "_arrived", "_day"]
    pairs = late.select(F.struct(*names).alias("new"), F.col("_sale").alias("_key")).join(stored.select(F.struct(*names).alias("old")), F.col("_key").eqNullSafe(F.col("old._sale")), "left")
    pairs = pairs.where(F.col("old").isNull() | (rank(F.col("new._arrived"), F.col("new.row")) > rank(F.col("old._arrived"), F.col("old.row"))))
    signed = F.array(F.struct(F.lit(1).alias("weight"), F.col("new").alias("v")), F.struct(F.lit(-1).alias("weight"), F.col("old").alias("v")))
    return pairs.select(F.explode(signed).alias("d")).where("d.v is not null").select("d.weight", "d.v.*")


def consolidated(rows: DataFrame) -> DataFrame:
    """Rows of (weight, ...) whose weights add up to more than nothing, each once."""
    names = ["_sale", "_sold", "_arrived", "_day", "row"]
    return rows.groupBy(*names).agg(F.sum("weight").alias("weight"), F.first("row").alias("kept")).where("weight > 0").select(F.col("kept").alias("row"), *names[:-1])


def maintain(sales: DataFrame, cutoff: str = CUTOFF, files: int = FILES, copies: bool = True) -> Layout:
    """The layout of the rows of ``sales`` that arrived before ``cutoff``, in a new folder, then brought up to all rows.

    A null arrival is late and earliest in rank; null keys are one key; null times stand on day -1, by key (nulls first); repeated
    rows are one. An empty table leaves an empty folder. Columns beside the named ones go along, whatever their names; maps can't be
    compared and are an error. Files have ``1 + rows // files`` rows of one day, the last of a day perhaps fewer.
    """
    spark = sales.sparkSession
    layout = Layout(spark, f"{scratch_root(spark)}/sales-layout-{uuid.uuid4().hex}", sales.schema, 1 + sales.count() // files)
    fs, p = layout._fs(layout.root)
    fs.mkdirs(p)
    every = boxed(with_copies(sales) if copies else sales)
    early = F.coalesce(F.col("_arrived") < F.lit(_micros_of(cutoff)), F.lit(False))
    with scratch_scope():
        layout.write(winners(every.where(early)), START)
        stored = boxed(layout.read())
        late = materialize(winners(every.where(~early)), "late-rows")
        signed = materialize(delta(stored, late), "late-delta")
        dirty = signed.select("_day").distinct()
        days = {r[0] for r in dirty.collect()}
        if days:
            touched = stored.join(dirty, "_day", "left_semi").withColumn("weight", F.lit(1))
            layout.write(consolidated(touched.unionByName(signed)), LATE, days)
    return layout


def _micros_of(text: str) -> int:
    return int(np.datetime64(text, "us").astype(np.int64))


def op13_late_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintain(table(spark, sf_dir, "sales")).digests()
