"""Helpers shared by the training-data operators: tables, scratch storage, numbering, components."""

from __future__ import annotations

import contextlib
import functools
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_OWN_ROOT: dict[str, str] = {}
_SCOPES: list[list[DataFrame]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names; where none is named a local folder, in local mode only (tests)."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_ROOT:
        _OWN_ROOT[app] = "file://" + tempfile.mkdtemp(prefix="silverquill-")
    return _OWN_ROOT[app]


def materialize(df: DataFrame, label: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends at replicated files.

    The files go when ``discard`` is called, or when the JVM exits (Hadoop's delete-on-exit), so a lazy result may
    still read them.
    """
    spark = df.sparkSession
    where = f"{scratch_root(spark)}/silverquill/{label}-{uuid.uuid4().hex}"
    writer = df.write.mode("error").option("compression", "zstd")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(where)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    back = spark.read.schema(df.schema).parquet(where)
    back._scratch = path
    if _SCOPES:
        _SCOPES[-1].append(back)
    return back


def discard(*tables: DataFrame | None) -> None:
    """Delete tables that ``materialize`` wrote and that nothing reads any more."""
    for df in tables:
        if df is not None:
            path = df._scratch
            path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


LEAST_HOT = 512


@contextlib.contextmanager
def scratch_scope():
    """Delete at the end what ``materialize`` wrote inside, but for the tables handed to the function that this yields."""
    made: list[DataFrame] = []
    kept: list[DataFrame] = []
    _SCOPES.append(made)
    try:
        yield kept.append
    finally:
        _SCOPES.pop()
        discard(*(d for d in made if all(d is not k for k in kept)))
        if _SCOPES:
            _SCOPES[-1].extend(kept)


def hot_keys(sizes: DataFrame, key: list[str]) -> DataFrame | None:
    """(key, _cuts): the keys of ``sizes`` (key, _rows) with more rows than an even task would have, and more than
    ``LEAST_HOT``; None if there are none. Fewer keys than there are tasks can be hot, and only these reach the driver."""
    spark = sizes.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows, top = sizes.agg(F.sum("_rows"), F.max("_rows")).first()
    even = max(LEAST_HOT, (rows or 0) // tasks)
    if (top or 0) <= even:
        return None
    listed = sizes.where(F.col("_rows") > even).select(*key, F.ceil(F.col("_rows") / even).cast("int").alias("_cuts")).collect()
    values = ", ".join("(" + ", ".join("NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in listed)
    hot = spark.sql(f"SELECT * FROM VALUES {values} AS h({', '.join(f'`{k}`' for k in key)}, `_cuts`)")
    return hot.select(*(F.col(k).cast(sizes.schema[k].dataType) for k in key), "_cuts")


def spread_join(many: DataFrame, one: DataFrame, key: list[str], by: list[str], how: str = "inner", hot: DataFrame | None | str = "find") -> DataFrame:
    """``many`` joined with ``one`` on ``key`` (integers or plain strings), where no task gets a whole hot key.

    The rows of a hot key (``hot_keys``) are cut by the hash of their columns ``by``, and its rows of ``one`` stand once in
    each cut. The hot keys are broadcast. ``many`` is read once more to find them, so it should be a stored table, unless ``hot`` is given.
    """
    if isinstance(hot, str):
        hot = hot_keys(many.groupBy(*key).agg(F.count("*").alias("_rows")), key)
    if hot is None:
        return many.join(one.hint("merge"), key, how)
    hot = F.broadcast(hot)
    cut = many.join(hot, key, "left").withColumn("_cut", F.coalesce(F.pmod(F.xxhash64(*by), F.col("_cuts")).cast("int"), F.lit(0))).drop("_cuts")
    each = one.join(hot, key, "left").withColumn("_cut", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_cuts") - 1, F.lit(0))))).drop("_cuts")
    return cut.join(each.hint("merge"), [*key, "_cut"], how).drop("_cut")


def pieces_of(batch, most_rows: int = 2000, most_bytes: int = 8 << 20):
    """Cut an Arrow record batch into slices of at most ``most_rows`` rows and about ``most_bytes`` bytes."""
    at = 0
    while at < batch.num_rows:
        n = min(most_rows, batch.num_rows - at)
        while n > 1 and batch.slice(at, n).nbytes > most_bytes:
            n = max(1, n // 2)
        yield batch.slice(at, n)
        at += n


def tidy() -> None:
    """Give memory back to the system: workers outlive their tasks, and what one stage held would stay beside the next."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def tidied(task):
    """``task`` (batches to batches) with a ``tidy`` at its end."""

    @functools.wraps(task)
    def run(batches):
        yield from task(batches)
        tidy()

    return run


def crc32_of_id(column: Column | str = "doc_id") -> Column:
    """crc32 of the id written as decimal text."""
    return F.crc32((F.col(column) if isinstance(column, str) else column).cast("string").cast("binary"))


def word_count(text: Column) -> Column:
    """Number of runs of characters other than ASCII white space; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def running_total(df: DataFrame, group: str, key: list[str], value: str, out: str, buckets: int) -> DataFrame:
    """Add ``out``: the sum of ``value`` over earlier rows of the same ``group``, in (hash bucket, key) order.

    A group is cut into ``buckets`` hash buckets, so that no window holds a whole hot group: one small
    window runs over the bucket sums, one over the rows of each bucket.
    """
    cut = df.withColumn("_b", F.pmod(F.xxhash64(*key), F.lit(buckets)))
    sums = cut.groupBy(group, "_b").agg(F.sum(value).alias("_s"))
    before = Window.partitionBy(group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(F.col(group).alias("_g"), F.col("_b").alias("_b2"), F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_o"))
    inside = Window.partitionBy(group, "_b").orderBy(*key).rowsBetween(Window.unboundedPreceding, -1)
    rows = cut.withColumn("_in", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return (
        rows.join(starts, rows[group].eqNullSafe(starts["_g"]) & (rows["_b"] == starts["_b2"]), "left")
        .withColumn(out, F.col("_o") + F.col("_in"))
        .drop("_b", "_b2", "_g", "_o", "_in")
    )


def bucket_count(rows: int) -> int:
    """Buckets for ``running_total``: about the square root of a large table's rows in each, 1000 at least."""
    return max(1, rows // max(1000, int(rows**0.5)))


FEW = 1_000_000
"""Edges that one task may join (16 bytes each)."""


def _few_components(batches):
    """(node, component) of the edges (u, v) of one task, integers: roots hook onto smaller roots until no edge joins two."""
    import numpy as np
    import pyarrow as pa

    ends = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if not ends:
        return
    u, v = (np.concatenate(x) for x in zip(*ends, strict=True))
    nodes, place = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = place[: len(u)], place[len(u) :]
    root = np.arange(len(nodes))
    while True:
        x, y = root[a], root[b]
        if (x == y).all():
            break
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], ["node", "component"])


def components(edges: DataFrame, label: str = "cc", most_rounds: int = 60, few: int = 0) -> DataFrame:
    """Connected components of undirected ``edges`` (a, b): one row (node, component) per node that has
    an edge to another node; the component is its smallest node.

    Alternating large-star and small-star steps: each round links every node to the smallest node that it
    or its neighbours know, and the edges of a settled component form a star. Minima are partial
    aggregates, a hub's edges are cut among tasks (``spread_join``), and each round is written to the
    shared folder, so that lineage stays short; the tables of the round before go. Null ends and self loops are ignored.
    Up to ``few`` edges between integers, counted first, are joined by one task instead, with the same answer.
    """
    pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    pairs = materialize(pairs, label)
    if few and pairs.count() <= few:
        return pairs.coalesce(1).mapInArrow(_few_components, "node long, component long")
    for _ in range(most_rounds):
        settled, degree = _stars(pairs)
        if settled:
            top = pairs.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(top)
        join = (lambda many, one: spread_join(many, one, ["u"], ["v"])) if degree > LEAST_HOT else (lambda many, one: many.join(one, "u"))
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = materialize(join(both.where("v > u"), least).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v"), label)
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = join(large, down).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        small = materialize(small.unionByName(down.select("u", F.col("m").alias("v"))).distinct(), label)
        discard(pairs, large)
        pairs = small
    raise RuntimeError("components did not settle")


def _stars(pairs: DataFrame) -> tuple[bool, int]:
    """Whether every node of ``pairs`` (u, v) is either a centre or linked with one centre only; and the most edges of a node."""
    ends = pairs.select(F.col("u").alias("n"), F.lit(1).alias("up")).unionByName(pairs.select(F.col("v").alias("n"), F.lit(0).alias("up")))
    roles = ends.groupBy("n").agg(F.sum("up").alias("ups"), F.count("*").alias("all"))
    open_, degree = roles.agg(F.count_if(F.expr("ups > 1 or (ups = 1 and all > 1)")), F.max("all")).first()
    return not open_, degree or 0


def ordered_index(df: DataFrame, group: list[str], order: list[str], label: str) -> DataFrame:
    """Add ``_index`` (from 0) and ``_count``: a row's place in its ``group`` by the columns ``order`` (nulls first), and the group's rows.

    Rows are dealt to tasks by ranges of (group, order) and written with their place in the task; a group that
    spans tasks is added up from one row per task, so no task holds a whole group. ``order`` should tell all rows apart that differ.
    """
    spark = df.sparkSession
    along = [F.col(c).asc_nulls_first() for c in (*group, *order)]
    dealt = df.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *along).sortWithinPartitions(*along)
    placed = materialize(dealt.withColumn("_at", F.monotonically_increasing_id()), label).withColumn("_task", F.shiftright("_at", 33))
    runs = placed.groupBy(*group, "_task").agg(F.min("_at").alias("_low"), F.count("*").alias("_rows"))
    whole = Window.partitionBy(*group)
    before = whole.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumns({"_before": F.coalesce(F.sum("_rows").over(before), F.lit(0)), "_count": F.sum("_rows").over(whole)})
    runs = runs.select(*(F.col(g).alias(f"_group{k}") for k, g in enumerate(group)), F.col("_task").alias("_task2"), (F.col("_before") - F.col("_low")).alias("_shift"), "_count")
    same = F.col("_task") == F.col("_task2")
    for k, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_group{k}"))
    joined = placed.join(runs.hint("merge"), same)
    return joined.withColumn("_index", F.col("_at") + F.col("_shift")).drop("_at", "_task", "_task2", "_shift", *(f"_group{k}" for k in range(len(group))))
