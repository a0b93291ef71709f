"""Export archives: merging parts, pairing sidecars, linking variants and live pairs, rebuilding albums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expr
from .ordered import running_sum

STEPS = ("exact", "exact", "truncated", "disambiguator-swap", "unique-basename")


def merge_parts(files: DataFrame, path: str = "path", size: str = "byte_size", part: str = "part", order: str = "part_index", outside: str | None = None) -> DataFrame:
    """(path, byte_size, part, part_index, copies, ordinal, conflict, source_path): one row per path and size.

    The earliest copy of a size stands for it. Where sizes differ the first keeps the path and each later one
    is named by its part; files outside the export are one per part.
    """
    key = F.col(path) if outside is None else F.when(F.col(outside), F.concat(F.col(part), F.lit("/"), F.col(path))).otherwise(F.col(path))
    rows = files.withColumn("_key", key)
    sizes = rows.groupBy("_key", F.col(size).alias("byte_size")).agg(F.min(F.struct(F.col(order).alias("i"), F.col(part).alias("p"), F.col(path).alias("path"))).alias("_k"), F.count("*").alias("copies"), F.max(F.lit(False) if outside is None else F.col(outside)).alias("_out"))
    by_key = Window.partitionBy("_key")
    placed = sizes.withColumn("ordinal", F.row_number().over(by_key.orderBy("_k", "byte_size"))).withColumn("conflict", F.count("*").over(by_key) > 1)
    name = F.when(F.col("_out") | (F.col("ordinal") > 1), F.concat(F.col("_k.p"), F.lit("/"), F.col("_k.path"))).otherwise(F.col("_k.path"))
    return placed.select(F.col("_k.path").alias("path"), "byte_size", F.col("_k.p").alias("part"), F.col("_k.i").alias("part_index"), "copies", "ordinal", "conflict", name.alias("source_path"))


def folders(files: DataFrame) -> DataFrame:
    """(dir, media, sidecars, parts, has_metadata) from classified files."""
    names = lambda kind: F.array_sort(F.collect_set(F.when(F.col("kind") == kind, F.col("name"))))
    return files.groupBy("dir").agg(names("media").alias("media"), names("sidecar").alias("sidecars"), F.array_sort(F.collect_set("part")).alias("parts"), F.max(F.col("kind") == "album-metadata").alias("has_metadata"))


def sidecar_candidates(media: DataFrame, sidecars: DataFrame) -> DataFrame:
    """(dir, name, sidecar, step, stem_length): every sidecar of a media file's folder that a step allows.

    Each step is an equi-join: on the two exact names, on every prefix of the media name, on the swapped
    name, and on the basename, which counts only where it is unique in the folder.
    """
    names = sidecars.select("dir", F.col("name").alias("sidecar")).distinct()
    stem = F.regexp_replace("sidecar", r"\.json$", "")
    m = media.select("dir", "name").distinct()

    def probe(step: int, wanted: Column) -> DataFrame:
        return m.withColumn("sidecar", wanted).where("sidecar is not null").join(names, ["dir", "sidecar"]).select("dir", "name", "sidecar", F.lit(step).alias("step"), F.lit(0).alias("stem_length"))

    prefixes = m.withColumn("stem", F.explode(F.transform(F.sequence(F.lit(1), F.length("name")), lambda n: F.substring(F.col("name"), F.lit(1), n))))
    stems = names.select("dir", "sidecar", stem.alias("stem")).where("stem <> ''")
    truncated = prefixes.join(stems, ["dir", "stem"]).select("dir", "name", "sidecar", F.lit(2).alias("step"), F.length("stem").alias("stem_length"))
    alone = names.groupBy("dir", expr.basename(F.col("sidecar")).alias("base")).agg(F.count("*").alias("_n"), F.first("sidecar").alias("sidecar"))
    unique = m.withColumn("base", expr.basename(F.col("name"))).join(alone.where("_n = 1"), ["dir", "base"]).select("dir", "name", "sidecar", F.lit(4).alias("step"), F.lit(0).alias("stem_length"))
    out = probe(0, F.concat("name", F.lit(".json"))).unionByName(probe(1, F.concat("name", F.lit(".supplemental-metadata.json"))))
    return out.unionByName(truncated).unionByName(probe(3, expr.disambiguator_probe(F.col("name")))).unionByName(unique)


def pair_sidecars(media: DataFrame, sidecars: DataFrame) -> DataFrame:
    """(dir, name, sidecar, step, shared, reason) for every media name of a folder.

    The first step that matches wins, the longest stem within it. A sidecar claimed by two names with a
    match of their own, or by several by basename alone, is contested: none gets it. Beside one owner, claims by
    basename share the sidecar. reason tells why a name has none.
    """
    candidates = sidecar_candidates(media, sidecars)
    best = candidates.groupBy("dir", "name").agg(F.min(F.struct("step", (-F.col("stem_length")).alias("l"), "sidecar")).alias("_b")).select("dir", "name", "_b.step", "_b.sidecar")
    claims = best.groupBy("dir", "sidecar").agg(F.count_if(F.col("step") < 4).alias("_own"), F.count_if(F.col("step") == 4).alias("_weak"))
    judged = best.join(claims, ["dir", "sidecar"]).withColumn("_contested", (F.col("_own") > 1) | ((F.col("_own") == 0) & (F.col("_weak") > 1)))
    shared = (F.col("step") == 4) & (F.col("_own") > 0)
    several = sidecars.select("dir", F.col("name").alias("sidecar")).distinct().groupBy("dir", expr.basename(F.col("sidecar")).alias("base")).agg(F.count("*").alias("_n")).where("_n > 1")
    rows = media.select("dir", "name").distinct().join(judged, ["dir", "name"], "left").withColumn("base", expr.basename(F.col("name"))).join(several, ["dir", "base"], "left")
    step = F.element_at(F.array(*map(F.lit, STEPS)), F.col("step") + 1)
    paired = F.col("sidecar").isNotNull() & ~F.col("_contested")
    return rows.select("dir", "name", F.when(paired, F.col("sidecar")).alias("sidecar"), F.when(paired, step).otherwise("unpaired").alias("step"), F.coalesce(paired & shared, F.lit(False)).alias("shared"), F.when(paired, None).when(F.col("_contested"), "contested-sidecar").when(F.col("_n").isNotNull(), "ambiguous-basename").otherwise("no-candidate").alias("reason"))


def link_variants(media: DataFrame) -> DataFrame:
    """(dir, name, base, matched_by) for every edited file: the file of the same name without the suffix, else
    the only unedited one of its stem and kind; else ``no-base`` or ``ambiguous-base``."""
    rows = media.select("dir", "name", expr.media_kind(F.col("name")).alias("kind"), expr.edited_base(F.col("name")).alias("base_stem"), expr.own_extension(F.col("name")).alias("ext")).distinct()
    edited = rows.where("base_stem is not null")
    plain = rows.where("base_stem is null").select("dir", F.col("name").alias("base"), F.col("kind").alias("_kind"), expr.stem(F.col("name")).alias("_stem"))
    same = edited.withColumn("base", F.concat("base_stem", F.lit("."), "ext")).join(plain.select("dir", "base"), ["dir", "base"]).select("dir", "name", F.col("base").alias("_same"))
    stems = edited.join(plain, (edited["dir"] == plain["dir"]) & (F.col("base_stem") == F.col("_stem")) & (F.col("kind") == F.col("_kind"))).groupBy(edited["dir"], "name").agg(F.count("*").alias("_n"), F.min("base").alias("_only"))
    joined = edited.join(same, ["dir", "name"], "left").join(stems, ["dir", "name"], "left")
    return joined.select("dir", "name", F.coalesce("_same", F.when(F.col("_n") == 1, F.col("_only"))).alias("base"), F.when(F.col("_same").isNotNull(), "same-name").when(F.col("_n") == 1, "same-stem").when(F.col("_n") > 1, "ambiguous-base").otherwise("no-base").alias("matched_by"))


def live_pairs(media: DataFrame, pairing: DataFrame) -> DataFrame:
    """(dir, stem, still, motion, sidecar_shared, status) for stems with stills and motions.

    One motion and one still are a pair; of several stills the one that owns the sidecar which the motion
    shares; anything else is ambiguous.
    """
    ext = expr.extension(F.col("name"))
    rows = media.select("dir", "name").distinct().join(pairing.select("dir", "name", "sidecar", "shared"), ["dir", "name"], "left")
    rows = rows.withColumn("stem", expr.stem(F.col("name"))).withColumn("role", F.when(ext.isin("heic", "heif", "jpg", "jpeg"), "still").when(ext == "mov", "motion")).where("role is not null")
    motions = rows.where("role = 'motion'").groupBy("dir", "stem").agg(F.count("*").alias("_m"), F.min(F.struct("name", "sidecar", "shared")).alias("_motion"))
    stills = rows.where("role = 'still'").join(motions, ["dir", "stem"])
    owns = F.coalesce((F.col("_motion.shared")) & ~F.col("shared") & (F.col("sidecar") == F.col("_motion.sidecar")), F.lit(False))
    found = stills.groupBy("dir", "stem").agg(F.first("_m").alias("_m"), F.first("_motion").alias("_motion"), F.count("*").alias("_s"), F.min("name").alias("_only"), F.count_if(owns).alias("_o"), F.min(F.when(owns, F.col("name"))).alias("_owner"))
    still = F.when(F.col("_m") == 1, F.when(F.col("_s") == 1, F.col("_only")).when(F.col("_o") == 1, F.col("_owner")))
    return found.select("dir", "stem", still.alias("still"), F.when(still.isNotNull(), F.col("_motion.name")).alias("motion"), F.coalesce(still.isNotNull() & (F.col("_o") == 1) & (F.col("_owner") == still), F.lit(False)).alias("sidecar_shared"), F.when(still.isNotNull(), "paired").otherwise("ambiguous").alias("status"))


def resolve_links(links: DataFrame, hashes: DataFrame) -> DataFrame:
    """(path, hash, target_hash, status): links (path, target) as hashes (path, hash); a target without a hash or
    with the file's own is unresolved."""
    own, target = hashes.select("path", "hash"), hashes.select(F.col("path").alias("target"), F.col("hash").alias("_t"))
    joined = links.join(own, "path", "left").join(target, "target", "left")
    good = F.col("_t").isNotNull() & F.col("hash").isNotNull() & (F.col("_t") != F.col("hash"))
    return joined.select("path", "hash", F.when(good, F.col("_t")).alias("target_hash"), F.when(good, "resolved").otherwise("unresolved").alias("status"))


def album_members(members: DataFrame, hashes: DataFrame) -> DataFrame:
    """(album_id, path, hash, status, position): members (album_id, path) in path order; the first file of a
    content is kept and numbered from 0, later ones are duplicates, files without a hash unresolved. Of members with one path and content, one is
    kept. Positions are a running count over sampled ranges of paths, so a very large album is many tasks."""
    joined = members.join(hashes.select("path", "hash"), "path", "left")
    nth = F.row_number().over(Window.partitionBy("album_id", F.coalesce("hash", "path")).orderBy("path"))
    judged = joined.withColumn("status", F.when(F.col("hash").isNull(), "unresolved").when(nth == 1, "kept").otherwise("duplicate")).withColumn("_kept", F.when(F.col("status") == "kept", 1).otherwise(0))
    placed = running_sum(judged, ["album_id"], ["path", "status"], "_kept", "_place")
    return placed.select("album_id", "path", "hash", "status", F.when(F.col("status") == "kept", F.col("_place")).cast("int").alias("position"))


def dispositions(media: DataFrame, folder_rows: DataFrame, include_trash: bool = False) -> DataFrame:
    """(dir, name, role, archived, archived_by, in_trash, in_trash_by, imported): media (dir, name, archived,
    trashed flags of the sidecar) with folders (dir, folder, has_metadata)."""
    rows = media.join(folder_rows, "dir").withColumn("role", expr.folder_role(F.col("folder"), F.col("has_metadata")))
    by = lambda role, flag: F.array_compact(F.array(F.when(F.col("role") == role, "folder"), F.when(F.coalesce(F.col(flag), F.lit(False)), "sidecar")))
    rows = rows.withColumn("archived_by", by("archive", "archived")).withColumn("in_trash_by", by("trash", "trashed"))
    return rows.select("dir", "name", "role", (F.size("archived_by") > 0).alias("archived"), "archived_by", (F.size("in_trash_by") > 0).alias("in_trash"), "in_trash_by", (F.lit(include_trash) | (F.size("in_trash_by") == 0)).alias("imported"))


def albums(folder_rows: DataFrame, media: DataFrame) -> DataFrame:
    """(id, dir, title, members): album folders (dir, folder, has_metadata, title); the folder's name where the
    metadata has no title."""
    rows = folder_rows.where(expr.folder_role(F.col("folder"), F.col("has_metadata")) == "album")
    per = media.groupBy("dir").agg(F.array_sort(F.collect_list("name")).alias("members"))
    return rows.join(per, "dir", "left").select(expr.album_id(F.col("dir")).alias("id"), "dir", F.coalesce(F.nullif(F.trim("title"), F.lit("")), "folder").alias("title"), F.coalesce("members", F.array().cast("array<string>")).alias("members"))
