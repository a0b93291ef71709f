"""Merkle manifest of a dataset with proofs by coordinate lookup, in DataFrame functions only.

A row's leaf is the hash of its fields. Every source has a tree over its leaves by doc_id, in which runs of ``GROUP`` nodes
become one; the sources' roots (subroots) are the leaves of one more tree. All nodes are stored as (tree, level, place). A leaf
knows from its place and the group size which coordinates its proof needs: it explodes them, looks them up in the stored nodes, and
the siblings in order are the proof. Nodes near a root are asked for by many leaves: a node of level k is stored in as
many copies as keep each copy's askers within ``ASKERS``, and a leaf asks the copy that its place names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc32_of_id, materialize, ordered_index, scratch_scope, table

GROUP, FIELDS = 3, ("doc_id", "source", "lang", "n_chars", "text")
AT_ONCE = 5
"""Levels that one round of grouping climbs: a group holds GROUP ** AT_ONCE digests at most."""
ASKERS = 8
"""A copy of a node serves GROUP ** ASKERS leaves at most."""


def field(value: Column) -> Column:
    """A value as text, with its length in UTF-8 bytes before it; ``-`` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(**changed: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*(field(changed.get(c, F.col(c))) for c in FIELDS)), 256))


def digest(parts: Column) -> Column:
    """The hash (bytes) of an array of digests (bytes), written as hex text one after another."""
    return F.unhex(F.sha2(F.array_join(F.transform(parts, lambda d: F.lower(F.hex(d))), ""), 256))


def above(digests: Column, group: int = GROUP) -> Column:
    """The level above a level."""
    last = F.call_function("div", F.size(digests) - 1, F.lit(group))
    return F.transform(F.sequence(F.lit(0).cast("long"), last), lambda j: digest(F.slice(digests, (j * group + 1).cast("int"), F.lit(group))))


def powers(group: int) -> list[int]:
    found = [1]
    while found[-1] * group < 1 << 63:
        found.append(found[-1] * group)
    return found


def _array(numbers: list[int]) -> Column:
    return F.expr(f"array({', '.join(f'{n}L' for n in numbers)})")


def height(count: Column, group: int = GROUP) -> Column:
    """Levels above the leaves of a tree of ``count`` leaves: one leaf is its own root."""
    return F.size(F.filter(_array(powers(group)), lambda p: p < count))


def climbed(nodes: DataFrame, group: int = GROUP) -> list[DataFrame]:
    """All nodes (tree, level, place, digest, count) of the trees whose leaves are ``nodes`` (level 0), as stored tables of ``AT_ONCE`` levels each;
    ``count`` is the number of leaves in the tree. A tree of at most ``group ** AT_ONCE`` nodes is done after a round."""
    wide, found, level = group**AT_ONCE, [nodes], 0
    while True:
        top = found[-1].where(F.col("level") == level)
        open_ = top.where(height(F.col("count"), group) > level)
        if open_.isEmpty():
            return found
        blocks = open_.groupBy("tree", "count", F.expr(f"place div {wide}").alias("block")).agg(F.array_sort(F.collect_list(F.struct("place", "digest"))).alias("s"))
        blocks = blocks.withColumn("l0", F.col("s.digest"))
        for k in range(AT_ONCE):
            blocks = blocks.withColumn(f"l{k + 1}", above(F.col(f"l{k}"), group))
        levels = F.array(*(F.struct(F.lit(level + k + 1).alias("level"), F.lit(group ** (AT_ONCE - k - 1)).alias("n"), F.col(f"l{k + 1}").alias("digests")) for k in range(AT_ONCE)))
        each = blocks.select("tree", "count", "block", F.explode(levels).alias("v")).where(F.col("v.level") <= height(F.col("count"), group))
        made = each.select("tree", F.col("v.level").alias("level"), F.col("block") * F.col("v.n").cast("long"), "v.digests", "count").toDF("tree", "level", "_first", "digests", "count")
        made = made.select("tree", "level", F.posexplode("digests").alias("_k", "digest"), "_first", "count").select("tree", "level", (F.col("_first") + F.col("_k")).alias("place"), "digest", "count")
        found.append(materialize(made, "merkle-nodes"))
        level += AT_ONCE


def coordinates(place: Column, count: Column, group: int = GROUP) -> Column:
    """The coordinates (level, place) of all siblings on the way from leaf ``place`` of ``count`` to the root, level by level, left to right."""
    power = _array(powers(group))
    over = lambda a, b: F.call_function("div", a, b)

    def run(k: Column) -> Column:
        size = F.element_at(power, k + 1)
        own = over(place, size)
        first = own - own % group
        last = F.least(first + (group - 1), over(count - 1, size))
        return F.transform(F.filter(F.sequence(first, last), lambda j: j != own), lambda j: F.struct(k.alias("level"), j.alias("place")))

    levels = F.filter(F.sequence(F.lit(0), F.lit(len(powers(group)) - 1)), lambda k: F.element_at(power, k + 1) < count)
    return F.flatten(F.transform(levels, run))


def proofs(leaves: DataFrame, nodes: list[DataFrame], group: int = GROUP, askers: int = ASKERS) -> DataFrame:
    """(_row, own, proof) of ``leaves`` (_row, own, tree, place, count): the siblings (level, place, digest) in order; a lone leaf has none."""
    copies = lambda level: F.element_at(_array([1] * askers + powers(group)[1:]), level + 1)
    stored = reduce(DataFrame.unionByName, nodes).where(F.col("level") < height(F.col("count"), group)).select("tree", "level", "place", "digest", F.explode(F.sequence(F.lit(0).cast("long"), copies(F.col("level")) - 1)).alias("copy"))
    asked = leaves.select("_row", "tree", F.col("place").alias("_leaf"), F.explode(coordinates(F.col("place"), F.col("count"), group)).alias("c"))
    asked = asked.select("_row", "tree", "c.level", "c.place", (F.col("_leaf") % copies(F.col("c.level"))).alias("copy"))
    met = asked.join(stored.hint("merge"), ["tree", "level", "place", "copy"]).select("_row", F.struct("level", "place", "digest").alias("s"))
    own = leaves.select("_row", F.struct("tree", "place", "count", "own").alias("own"))
    both = met.withColumn("own", F.lit(None).cast(own.schema["own"].dataType)).unionByName(own, allowMissingColumns=True)
    return both.groupBy("_row").agg(F.first("own", ignorenulls=True).alias("own"), F.array_sort(F.collect_list("s")).alias("proof")).select("_row", "own.*", "proof")


def path(place: Column, count: Column, group: int = GROUP) -> Column:
    """The places of a leaf and of the nodes above it, without the root."""
    power = _array(powers(group))
    return F.transform(F.filter(power, lambda p: p < count), lambda p: F.call_function("div", place, p))


def fold(leaf: Column, places: Column, proof: Column) -> Column:
    """The root that ``leaf`` (bytes) has at ``places`` (one per level) with the siblings of ``proof`` (level, place, digest)."""

    def step(now: Column, k: Column) -> Column:
        at = F.element_at(places, k + 1)
        side = lambda keep: F.transform(F.filter(proof, keep), lambda x: x["digest"])
        return digest(F.concat(side(lambda x: (x["level"] == k) & (x["place"] < at)), F.array(now), side(lambda x: (x["level"] == k) & (x["place"] > at))))

    return F.aggregate(F.filter(F.sequence(F.lit(0), F.size(places)), lambda k: k < F.size(places)), leaf, step)


def manifest(documents: DataFrame, tampered: Column | None = None, group: int = GROUP) -> DataFrame:
    """(doc_id, source, leaf, subroot, root, path, proof, folded_root, verified): digests as bytes, the proof as siblings (level, place,
    digest), where the levels of the tree of sources follow those of the source's tree, the path as the places of the leaf and of the nodes above it; ``folded_root`` starts from the leaf of the text ``tampered`` (or the text itself).

    Null fields count as ``-``; rows stand by doc_id (null first), those with one doc_id by their leaf, and repeated rows are leaves each;
    a null source is a source, the first. An empty table has no rows. Columns beside ``FIELDS`` are left alone.
    """
    with scratch_scope() as keep:
        other = leaf_of() if tampered is None else leaf_of(text=tampered)
        leaves = materialize(documents.select("doc_id", "source", leaf_of().alias("leaf"), other.alias("other")).withColumn("_row", F.monotonically_increasing_id()), "merkle-leaves")
        placed = ordered_index(leaves, ["source"], ["doc_id", "leaf", "_row"], "merkle-placed")
        sources = materialize(ordered_index(leaves.groupBy("source").agg(F.count("*").alias("n")), [], ["source"], "merkle-order").select(F.col("source").alias("_source"), F.col("_index").alias("tree"), F.col("_count").alias("sources")), "merkle-sources")
        # The table of sources is stored, so its size is known: Spark sends it whole to the tasks only below its broadcast limit.
        rows = placed.join(sources, F.col("source").eqNullSafe(F.col("_source"))).select("_row", "tree", F.col("_index").alias("place"), F.col("_count").alias("count"), F.struct("doc_id", "source", "leaf", "other").alias("own"), "sources")
        rows = materialize(rows, "merkle-rows")
        level0 = lambda df, tree, place, count, leaf: df.select(tree.alias("tree"), F.lit(0).alias("level"), place.alias("place"), leaf.alias("digest"), count.alias("count"))
        nodes = climbed(level0(rows, F.col("tree"), F.col("place"), F.col("count"), F.col("own.leaf")), group)
        tops = reduce(DataFrame.unionByName, nodes).where(F.col("level") == height(F.col("count"), group)).select("tree", F.col("digest").alias("subroot")).join(sources.select("tree", "sources"), "tree")
        tops = materialize(tops, "merkle-subroots")
        upper = climbed(level0(tops, F.lit(-1).cast("long"), F.col("tree"), F.col("sources"), F.col("subroot")), group)
        root = reduce(DataFrame.unionByName, upper).where(F.col("level") == height(F.col("count"), group)).select(F.col("tree").alias("_one"), F.col("digest").alias("root"))
        up = proofs(tops.select(F.col("tree").alias("_row"), F.lit(-1).cast("long").alias("tree"), F.col("tree").alias("place"), F.col("sources").alias("count"), F.struct("subroot").alias("own")), upper, group)
        up = materialize(up.join(root, F.col("tree") == F.col("_one")).select(F.col("_row").alias("sid"), F.col("count").alias("sources"), "own.subroot", F.col("proof").alias("up"), "root"), "merkle-up")
        down = proofs(rows.select("_row", "own", "tree", "place", "count"), nodes, group)
        full = down.join(up, F.col("tree") == F.col("sid"))
        higher = F.transform("up", lambda x: F.struct((x["level"] + height(F.col("count"), group)).alias("level"), x["place"].alias("place"), x["digest"].alias("digest")))
        full = full.select("own.*", "subroot", "root", F.concat(path(F.col("place"), F.col("count"), group), path(F.col("sid"), F.col("sources"), group)).alias("path"), F.concat("proof", higher).alias("proof"))
        full = full.select("doc_id", "source", "leaf", "subroot", "root", "path", "proof", fold(F.col("other"), F.col("path"), F.col("proof")).alias("folded_root"))
        out = materialize(full, "merkle-proofs")
        keep(out)
        return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the documents lose the line ends of their texts after the manifest is made; those that had any are found."""
    tampered = F.when(crc32_of_id() % 2 == 0, F.translate("text", "\n", "")).otherwise(F.col("text"))
    hexed = lambda c: F.lower(F.hex(c)).alias(c)
    shown = F.sha2(F.array_join(F.transform("proof", lambda x: F.lower(F.hex(x["digest"]))), ""), 256).alias("proof_sha256")
    return manifest(table(spark, sf_dir, "documents"), tampered).select("doc_id", hexed("leaf"), hexed("subroot"), hexed("root"), shown, hexed("folded_root"), "verified")


CRC_SQL = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split({text}, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END))"""
"""The unsigned crc32 of an ASCII text, bit by bit."""


def op11_sql(group: int = GROUP) -> str:
    """The same level by level: trees by recursion over runs, proofs by a walk from every leaf."""
    part = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE concat(strlen({c}::VARCHAR), ':', {c}::VARCHAR) END"
    leaf = lambda text: f"sha256(concat({', '.join(part(text if c == 'text' else c) for c in FIELDS)}))"
    tree = lambda name, base: f"""{name}(tree, level, place, digest, n) AS ({base} UNION ALL
        SELECT tree, any_value(level) + 1, place // {group}, sha256(string_agg(digest, '' ORDER BY place)), (any_value(n) + {group - 1}) // {group} FROM {name} WHERE n > 1 GROUP BY tree, place // {group})"""  # noqa: E731
    return f"""
WITH RECURSIVE base AS (SELECT *, {leaf('text')} AS leaf, {leaf("CASE WHEN " + CRC_SQL.format(text="doc_id::VARCHAR") + " % 2 = 0 THEN replace(text, chr(10), '') ELSE text END")} AS other FROM documents),
placed AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY source) AS n, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree FROM base),
{tree('nodes', 'SELECT tree, 0, place, leaf, n FROM placed')},
subs AS (SELECT tree, digest, level FROM nodes WHERE n = 1),
{tree('tops', 'SELECT -1, 0, tree, digest, (SELECT count(*) FROM subs) FROM subs')},
whole AS (SELECT digest AS root, level AS height FROM tops WHERE n = 1),
asks AS (SELECT row_number() OVER () AS rid, placed.*, subs.digest AS subroot, subs.level AS height FROM placed JOIN subs USING (tree)),
walk(rid, step, height, inside, place, top, now, tree, proof) AS (
    SELECT rid, 0, height, height > 0, CASE WHEN height > 0 THEN place ELSE tree END, tree, other, CASE WHEN height > 0 THEN tree ELSE -1 END, '' FROM asks
    UNION ALL
    SELECT w.rid, w.step + 1, w.height, w.step + 1 < w.height, CASE WHEN w.step + 1 = w.height THEN w.top ELSE w.place // {group} END, w.top,
        sha256(string_agg(CASE WHEN x.place = w.place THEN w.now ELSE x.digest END, '' ORDER BY x.place)), CASE WHEN w.step + 1 < w.height THEN w.tree ELSE -1 END,
        concat(w.proof, coalesce(string_agg(x.digest, '' ORDER BY x.place) FILTER (x.place <> w.place), ''))
    FROM walk w JOIN (SELECT * FROM nodes UNION ALL SELECT * FROM tops) x ON x.tree = w.tree AND x.level = CASE WHEN w.inside THEN w.step ELSE w.step - w.height END AND x.place // {group} = w.place // {group} AND x.n > 1
    GROUP BY w.rid, w.step, w.height, w.inside, w.place, w.top, w.now, w.tree, w.proof),
ends AS (SELECT rid, arg_max(now, step) AS folded_root, arg_max(proof, step) AS proof FROM walk GROUP BY rid)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded_root, folded_root = root AS verified FROM asks JOIN ends USING (rid), whole
"""
