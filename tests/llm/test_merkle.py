"""The Merkle manifest against trees built one node at a time."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from silverquill.llm import merkle
from silverquill.llm.queries import oracle_sql, queries

from ..oracle import check

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*row[:4], text)))


def levels(digests, group):
    found = [digests]
    while len(found[-1]) > 1:
        found.append([h(*found[-1][i : i + group]) for i in range(0, len(found[-1]), group)])
    return found


def around(tree, i, group):
    for level in tree[:-1]:
        first = i - i % group
        yield level[first:i], level[i + 1 : first + group]
        i //= group


def plain(rows, group=3, tampered=lambda r: r[4]):
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees, found = {}, []
    for s in sources:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4])))
        trees[s] = levels([leaf(r, r[4]) for r in by[s]], group)
    top = levels([trees[s][-1][0] for s in sources], group)
    for k, s in enumerate(sources):
        for i, r in enumerate(by[s]):
            way, now = [*around(trees[s], i, group), *around(top, k, group)], leaf(r, tampered(r))
            for left, right in way:
                now = h(*left, now, *right)
            found.append((r[0], trees[s][0][i], trees[s][-1][0], top[-1][0], h(*(d for pair in way for side in pair for d in side)), now, now == top[-1][0]))
    return sorted(found, key=str)


def asked(df):
    shown = df.select("doc_id", *(F.lower(F.hex(c)).alias(c) for c in ("leaf", "subroot", "root")), F.sha2(F.array_join(F.transform("proof", lambda x: F.lower(F.hex(x["digest"]))), ""), 256), F.lower(F.hex("folded_root")), "verified")
    return sorted(map(tuple, shown.collect()), key=str)


def test_query_matches_sql_and_plain_trees(spark):
    from ..oracle import DATA

    check(queries()["op11_merkle"], oracle_sql()["op11_merkle"], spark)
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select(*merkle.FIELDS[:4], "text").collect()]
    cut = lambda r: r[4].replace("\n", "") if r[4] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 else r[4]
    got = sorted((tuple(r) for r in queries()["op11_merkle"](spark, DATA).collect()), key=str)
    assert got == plain(rows, tampered=cut)
    assert {r[-1] for r in got} == {True, False}


@pytest.mark.parametrize("group", [2, 3, 5])
def test_sizes_and_groups(spark, group, monkeypatch):
    monkeypatch.setattr(merkle, "AT_ONCE", 2)  # several rounds
    rng = random.Random(group)
    rows = [(k, s, rng.choice([None, "en"]), rng.choice([None, k]), f"t{k}\n") for s, n in (("one", 1), ("a'b", 2), (None, 3), ("é", 4), ("", 9), ("z", 10), ("hot", 260)) for k in range(n)]
    df = spark.createDataFrame(rng.sample(rows, len(rows)), SCHEMA)
    assert asked(merkle.manifest(df, group=group)) == plain(rows, group)


def test_copies_of_nodes_answer_alike(spark):
    rows = [(k, "s", "en", 1, f"t{k}") for k in range(100)]
    df = spark.createDataFrame(rows, SCHEMA)
    leaves = df.select(F.col("doc_id").alias("_row"), F.struct("doc_id").alias("own"), F.lit(0).cast("long").alias("tree"), F.col("doc_id").alias("place"), F.lit(100).cast("long").alias("count"))
    level0 = df.select(F.lit(0).cast("long").alias("tree"), F.lit(0).alias("level"), F.col("doc_id").alias("place"), merkle.leaf_of().alias("digest"), F.lit(100).cast("long").alias("count"))
    nodes = merkle.climbed(level0)
    few, many = (sorted((r._row, [x.digest for x in r.proof]) for r in merkle.proofs(leaves, nodes, askers=a).collect()) for a in (1, 8))
    assert few == many and len(few) == 100 and all(d for _, d in few)


def test_odd_rows(spark):
    rows = [(None, None, None, None, None), (1, "s", "en", 3, ""), (1, "s", "en", 3, ""), (1, "s", "en", 3, None), (2, "s", None, 0, "x" * 300_000 + "\n"), (2, "s", None, 0, "é\n日本")]
    df = spark.createDataFrame([(*r, "x", 7) for r in rows], SCHEMA + ", leaf string, _row int")  # columns of the operator's own names
    cut = lambda r: r[4] and r[4].replace("\n", "")
    got = asked(merkle.manifest(df, F.translate("text", "\n", "")))
    assert got == plain(rows, tampered=cut)
    assert sum(not r[-1] for r in got) == 2


def test_empty_table(spark):
    assert merkle.manifest(spark.createDataFrame([], SCHEMA)).collect() == []
