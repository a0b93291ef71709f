import json
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from silverquill.llm import common, licences, lines, lm, mixing, near, packing, quality, queries, shingles, tokens, urls, vectors

from ..oracle import DATA, check, duck, rows_of

SQL = queries.oracle_sql()
EDGE = [(1, None, "s"), (2, "", "s"), (3, "one two three four five six seven eight", None), (3, "one two three four five six seven eight", None), (None, "Licensed under the Apache License, Version 2.0.", "t"), (7, "word " * 30_000, "t"), (8, "\n\n. ! ? \t", "t"), (9, "Is it?\nYes it is so.\nAnd we said it was so then.\nAnother line of text here.", "s"), (10, "Is it?\nYes it is so.\nAnd we said it was so then.\nAnother line of text here.", "s")]


@pytest.fixture(scope="module")
def edge(spark):
    extra = "kept_text string, n_lines int, size int, score double, sequence_id int, offset int, key int, node int"
    return spark.createDataFrame([(i, t, s, "x", 1, 2, 0.5, 3, 4, 5, 6) for i, t, s in EDGE], f"doc_id long, text string, source string, {extra}").withColumn("lang", F.lit("en")).withColumn("n_chars", F.length("text").cast("long"))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, name):
    check(queries.queries()[name], SQL[name], spark)


def test_components(spark):
    rnd = random.Random(3)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5000, 5000 + i) for i in range(100)] + [(7, 7), (None, 3)]
    parent = {}

    def top(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = top(a), top(b)
            parent[max(x, y)] = min(x, y)
    want = {x: top(x) for x in parent}
    df = spark.createDataFrame(edges, "a long, b long")
    assert dict(map(tuple, common.components(df).collect())) == want
    assert dict(map(tuple, common.components(df, few=common.FEW).collect())) == want and common.components(df.limit(0), few=common.FEW).count() == 0
    hub = spark.createDataFrame([(0, i) for i in range(1, 3000)] + [(i, i + 1) for i in range(3000, 3100)], "a long, b long")
    whole = sorted(map(tuple, common.components(hub).collect()))
    assert whole == sorted(map(tuple, common.components(hub, few=common.FEW).collect())) and {c for _, c in whole} == {0, 3000}
    assert common.components(df.limit(0)).count() == 0


def test_running_total(spark):
    df = spark.createDataFrame([(i, "hot" if i % 3 else None, i % 7) for i in range(500)], "k int, g string, v long")
    for buckets in (1, 7):
        got = common.running_total(df, "g", ["k"], "v", "t", buckets).collect()
        for g in ("hot", None):
            own = sorted((r["t"], r["v"]) for r in got if r["g"] == g)
            ends = {t + v for t, v in own} | {0}
            assert all(t in ends for t, _ in own) and max(t + v for t, v in own) == sum(v for _, v in own)


# Packing


@pytest.mark.parametrize("seed", range(8))
def test_plan_is_whole_and_tight(seed):
    rnd = random.Random(seed)
    cap = rnd.choice([10, 64, 4096])
    histogram = {rnd.randint(1, cap): rnd.choice([1, 2, 5, 400]) for _ in range(rnd.randint(1, 50))}
    plan = packing.plan_packing(histogram, cap)
    used = [[] for _ in range(plan.sequences)]
    for length, n in histogram.items():
        for s, o in zip(*plan.place(np.full(n, length), np.arange(n)), strict=True):
            used[s].append((o, length))
    for bin_ in used:
        at = 0
        for o, length in sorted(bin_):
            assert o == at
            at += length
        assert 0 < at <= cap
    # Best-fit decreasing alone needs no fewer.
    rooms = []
    for x in sorted((x for x, n in histogram.items() for _ in range(n)), reverse=True):
        fits = [r for r in rooms if r >= x]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - x)
        else:
            rooms.append(cap - x)
    assert plan.sequences <= len(rooms) + 1


def test_reduction_is_never_worse_than_the_optimum():
    def best(items, cap):
        low = [math.inf]

        def go(i, rooms):
            if len(rooms) >= low[0]:
                return
            if i == len(items):
                low[0] = len(rooms)
                return
            for k in {r: k for k, r in enumerate(rooms) if r >= items[i]}.values():
                go(i + 1, rooms[:k] + [rooms[k] - items[i]] + rooms[k + 1 :])
            go(i + 1, [*rooms, cap - items[i]])

        go(0, [])
        return low[0]

    rnd = random.Random(5)
    over = 0
    for _ in range(120):
        items = sorted((rnd.randint(1, 12) for _ in range(rnd.randint(1, 9))), reverse=True)
        over += packing.plan_packing(Counter(items), 12).sequences - best(items, 12)
    assert over <= 3


def test_tokens_equal_the_tokenizer():
    encoder = tokens.word_encoder()
    texts = ["Hello, world. <|endoftext|>It's 12,5!? x\x1cy", None, "", "É ç ΑΣ ß日本語 a.b. c...", "A B's ..."]
    texts += [r[0] for r in duckdb.sql(f"SELECT text FROM '{DATA}/documents.parquet' LIMIT 40").fetchall()]
    ids, sizes = encoder.encode(pa.array(texts))
    want = [encoder.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert sizes.tolist() == [len(w) for w in want] and ids.tolist() == sum(want, [])


def test_other_tokenizers_encode_whole_texts(tmp_path):
    """Byte-level pieces depend on the space before a word: cutting at spaces would give other ids, and isn't done."""
    from tokenizers import Tokenizer, models, pre_tokenizers

    letters = pre_tokenizers.ByteLevel.alphabet()
    other = Tokenizer(models.BPE({c: i for i, c in enumerate(sorted(letters))} | {"Ġa": 256}, [("Ġ", "a")]))
    other.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False)
    other.save(str(tmp_path / "t.json"))
    encoder = tokens.WordEncoder(str(tmp_path / "t.json"))
    texts = ["a a a", None, "", "x  a\nB"]
    ids, sizes = encoder.encode(pa.array(texts))
    want = [other.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert not encoder.by_words and tokens.word_encoder().by_words
    assert sizes.tolist() == [len(w) for w in want] and ids.tolist() == sum(want, [])


def test_pieces_by_plain_cutting(spark):
    """Every column of every piece of the table, from the tokenizer itself; packed gaplessly, in as few sequences as a bound allows."""
    encoder = tokens.word_encoder()
    docs = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    want = []
    for d in docs:
        ids = np.array([*encoder.tokenizer.encode(d["text"] or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(d["doc_id"], k, at, len(ids[at : at + 4096]), zlib.crc32(ids[at : at + 4096].tobytes())) for k, at in enumerate(range(0, len(ids), 4096))]
    rows = packing.op3_best_fit_packing(spark, DATA).toPandas()
    assert sorted(map(tuple, rows[["doc_id", "piece", "start", "length", "ids_crc32"]].to_numpy().tolist())) == sorted(want)
    assert rows.sequence_id.nunique() <= -(-rows.length.sum() // 4096) + 1
    odd = packing.pack(spark.createDataFrame([("x", 0, 5, 1, 2, 3)], "doc_id string, piece int, length long, `row` int, `_b` int, number int"))
    assert odd.columns == ["doc_id", "piece", "length", "row", "_b", "number", "sequence_id", "offset"] and tuple(odd.first()) == ("x", 0, 5, 1, 2, 3, 0, 0)


def test_packing_query(spark, edge):
    for df in (packing.op3_best_fit_packing(spark, DATA), packing.pack_documents(edge)):
        rows = df.toPandas()
        assert (rows.groupby("sequence_id").length.sum() <= 4096).all()
        ordered = rows.sort_values(["sequence_id", "offset"])
        assert (ordered.groupby("sequence_id").length.cumsum() - ordered.length == ordered.offset).all()
        assert rows.sequence_id.nunique() <= rows.length.sum() / 4096 * 1.02 + 1
    parts = rows[rows.doc_id == 7].sort_values("piece")
    assert parts.length.tolist()[:-1] == [4096] * (len(parts) - 1) and parts.start.tolist() == [4096 * i for i in range(len(parts))]
    assert rows[rows.doc_id == 2].length.tolist() == [1] and int(rows[rows.doc_id == 2].ids_crc32.iloc[0]) == zlib.crc32(b"\x01\0\0\0")
    assert len(rows[rows.doc_id == 3]) == 2
    assert packing.pack_documents(edge.limit(0)).count() == 0


# Lines


def test_line_dedup_edges(spark, edge):
    got = lines.dedup(edge).orderBy("doc_id").collect()
    assert len(got) == len(EDGE)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    assert by[1][0]["kept_text"] is None and by[2][0]["kept_text"] == "" and len(by[3]) == 2 and all(r["n_removed"] == 0 for r in by[3])
    assert by[9][0]["n_removed"] == 0 and by[10][0]["kept_text"] == "" and by[10][0]["n_removed"] == 4
    assert lines.dedup(edge.limit(0)).count() == 0 and "n_chars" in lines.dedup(edge).columns


def test_repeated_passage_goes_wherever_it_stands(spark):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choices("abcdefgh", k=6))
    sentence = lambda: " ".join(word() for _ in range(9)) + "."
    passage = " ".join(sentence() for _ in range(6))
    docs = [(i, "\n".join([sentence() + " " + (passage + " " if i % 2 else "") + sentence(), sentence(), sentence()])) for i in range(10)]
    got = {r["doc_id"]: r for r in lines.dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert [i for i in got if got[i]["n_removed"]] == [3, 5, 7, 9] or sorted(i for i in got if got[i]["n_removed"]) == [3, 5, 7, 9]
    for i, text in docs:
        want = text.replace(passage + " ", "") if i in (3, 5, 7, 9) else text
        assert got[i]["kept_text"] == want


def test_line_dedup_sql_on_edges(spark, edge):
    """Repeated rows, null ids, rows with one id and different texts, short lines, separators of all kinds."""
    odd = [(20, "aa.\nbb.\ncc."), (21, "aa.\nbb.\ncc."), (22, "A unique\x01word\naa.\nbb.\ncc.\nA\x01b"), (None, "Null. Id. Text. Here."), (None, "Null. Id. Text. Here."), (23, "Null. Id. Text. Here. "), (24, "x\r\ny\r\nz\r\nx\r\ny\r\nz"), (24, "One. Two. Three. Four."), (24, "Zero. One. Two. Three."), (25, ". . . ! ? "), (26, "\n\nOne.\n\nTwo.\n \nThree.\n\n"), (27, "é. ü. ß. 日本. 語."), (28, "é. ü. ß. 日本. 語."), (29, "a. a. a. a. a. a."), (30, " "), (31, "lone"), (32, "lone")]
    frame = pd.DataFrame([*((i, t) for i, t, _ in EDGE), *odd], columns=["doc_id", "text"]).astype({"doc_id": "Int64"})
    columns, rows = duck(lines.op4_sql(), {"documents": frame})
    got = lines.dedup(spark.createDataFrame([*((i, t) for i, t, _ in EDGE), *odd], "doc_id long, text string")).select(*columns)
    assert rows_of(columns, rows) == rows_of(columns, [tuple(r) for r in got.collect()])
    by = {r["doc_id"]: r for r in got.collect()}
    assert by[22]["kept_text"] == "A unique\x01word\nA\x01b" and by[21]["kept_text"] == "" and by[20]["n_removed"] == 0 and by[32]["kept_text"] == ""


@pytest.mark.parametrize("sentences", [True, False])
def test_lines_are_the_text(spark, sentences):
    rnd = random.Random(12)
    texts = ["".join(rnd.choices("ab.!? \n\x01\u2028é日", k=rnd.randrange(60))) for _ in range(300)] + ["", ".", " ", ". "]
    split, starts = lines.cut_lines(pa.array(texts).slice(3), sentences)
    split = split.to_pylist()
    want = [[x for x in re.split(r"(?<=\n)|(?<=[.!?] )" if sentences else r"(?<=\n)", t) if x] for t in texts[3:]]
    assert [split[a:z] for a, z in zip(starts[:-1], starts[1:], strict=True)] == want
    cut = spark.createDataFrame([(t,) for t in texts[3:]], "t string").select(lines.line_array(F.col("t"), sentences).alias("l")).collect()
    assert [[x for x in r["l"] if x] for r in cut] == want


def test_line_dedup_by_newlines_alone(spark):
    docs = spark.createDataFrame([(1, "One. Two. Three."), (2, "One. Two. Three. Four."), (3, "a\nb\nc\nd"), (4, "a\nb\nc")], "doc_id long, text string")
    got = {r["doc_id"]: r["kept_text"] for r in lines.dedup(docs, sentences=False).collect()}
    assert got == {1: "One. Two. Three.", 2: "One. Two. Three. Four.", 3: "a\nb\nc\nd", 4: ""}


def test_line_dedup_keeps_columns_of_any_name(spark):
    names = ["_id", "_k", "_spans", "_lines", "row", "cut", "lines", "key", "first"]
    docs = spark.createDataFrame([(1, "a\nb\nc", *range(9)), (2, "a\nb\nc", *range(9))], "doc_id long, text string, " + ", ".join(f"`{n}` int" for n in names))
    got = lines.dedup(docs)
    assert got.columns == [*docs.columns, "n_removed", "kept_text"]
    assert sorted((r["doc_id"], r["kept_text"], r["lines"]) for r in got.collect()) == [(1, "a\nb\nc", 6), (2, "", 6)]


# Near-dedup

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _aligned_words(a, b):
    """Length of the longest common subsequence, without a band."""
    places = {}
    for j, w in enumerate(a):
        places[w] = places.get(w, 0) | 1 << j
    full = flat = (1 << len(a)) - 1
    for w in b:
        met = flat & places.get(w, 0)
        flat = (flat + met | flat - met) & full
    return len(a) - flat.bit_count()


def _similar_texts(texts, threshold=0.8):
    """Pairs of texts whose aligned words are the threshold of all words."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", t.translate(LOW)) for t in texts]
    counts = [Counter(w) for w in words]
    for i, a in enumerate(words):
        for j, b in enumerate(words[:i]):
            if min(len(a), len(b)) >= threshold * max(len(a), len(b)):
                most = (counts[i] & counts[j]).total()
                if most >= threshold * (len(a) + len(b) - most):
                    most = _aligned_words(a, b)
                    if most >= threshold * (len(a) + len(b) - most):
                        yield i, j


def _brute(texts, threshold=0.8):
    top = list(range(len(texts)))

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for i, j in _similar_texts(texts, threshold):
        a, b = root(i), root(j)
        top[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(texts))]


def test_near_dedup_equals_brute_force(spark):
    rnd = random.Random(6)
    word = lambda: "w%d" % rnd.randrange(4000)
    common_passage = [word() for _ in range(60)]
    texts = []
    for _ in range(40):
        base = [word() for _ in range(rnd.randint(20, 200))]
        texts.append(base)
        for _ in range(rnd.randint(0, 4)):
            other = list(base)
            for _ in range(rnd.randint(0, max(1, len(base) // 30))):
                k = rnd.randrange(len(other))
                other[k : k + 1] = rnd.choice([[word()], [], [word(), word()]])
            texts.append(other)
        texts.append(base[len(base) // 2 :] + base[: len(base) // 2])
    for _ in range(120):  # many texts that are mostly one passage: groups that stay open
        texts.append([word() for _ in range(rnd.randint(0, 22))] + common_passage)
    template = [word() for _ in range(150)]
    for _ in range(150):  # a large group of near copies
        own = list(template)
        for _ in range(rnd.randint(0, 4)):
            own[rnd.randrange(150)] = word()
        texts.append(own)
    texts += [["only", "three", "words"], ["only", "three", "words"], [], []]
    joined = [" ".join(t) for t in texts]
    got = near.near_duplicates(spark.createDataFrame(list(enumerate(joined)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r["class_id"] for r in got] == _brute(joined)
    assert all(r["kept"] == (r["doc_id"] == r["class_id"]) for r in got)


def test_links_far_from_a_groups_first_member_are_found(spark):
    """Edits all over a text leave few of its shingles, but most of its words."""
    words = lambda prefix, n: [f"{prefix}{k}" for k in range(n)]
    x = words("x", 100)
    texts = {-9: words("h", 100), 1: x, 2: [f"y{k}" if k % 10 == 5 else w for k, w in enumerate(x)], 3: [w for k, w in enumerate(x) for w in ([w, f"z{k}"] if k % 5 == 0 else [w])], 4: words("o", 100)}
    hashes = {n: shingles.word_hashes(pa.array([" ".join(t)]))[0] for n, t in texts.items()}
    a, b = shingles.shingles(hashes[1]), shingles.shingles(hashes[2])
    assert len(np.intersect1d(a, b)) / len(np.union1d(a, b)) < 0.7
    groups = spark.createDataFrame([(7, n) for n in texts], "key long, node long")
    stored = spark.createDataFrame([(n, bytearray(h.tobytes())) for n, h in hashes.items()], "node long, words binary")
    got = {r["node"]: r["component"] for r in near.similar(groups, stored).collect()}
    assert got[1] == got[2] == got[3] and got.get(4, 4) != got[1] and got.get(-9, -9) != got[1]


def test_near_dedup_on_the_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").orderBy("doc_id").collect()
    want = [docs[i]["doc_id"] for i in _brute([d["text"] for d in docs])]
    assert [r["class_id"] for r in near.op5_near_dedup(spark, DATA).orderBy("doc_id").collect()] == want


def test_near_copies_of_the_larger_table_are_found(spark):
    """All pairs of different texts of sf0.01 by aligned words: nine in ten at least stand in one class, and no class joins texts that nothing links."""
    sf_dir = DATA.replace("sf0.001", "sf0.01")
    docs = [r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()]
    texts = [r["text"] or "" for r in docs]
    pairs = [(i, j) for i, j in _similar_texts(texts) if texts[i] != texts[j]]
    by = {r["doc_id"]: r["class_id"] for r in near.op5_near_dedup(spark, sf_dir).collect()}
    met = sum(by[docs[i]["doc_id"]] == by[docs[j]["doc_id"]] for i, j in pairs)
    assert len(pairs) > 60 and met >= 0.97 * len(pairs)
    want = _brute(texts)
    assert len(set(by.values())) - len(set(want)) <= 0.03 * len(pairs) and all(want[i] == want[j] for i in range(len(docs)) for j in (i - 1,) if j >= 0 and by[docs[i]["doc_id"]] == by[docs[j]["doc_id"]])


def test_word_alignment_against_a_plain_one():
    rnd = random.Random(21)
    for _ in range(400):
        a = [rnd.randrange(rnd.choice([5, 400])) for _ in range(rnd.randrange(1, 90))]
        b = list(a)
        for _ in range(rnd.randrange(12)):
            k = rnd.randrange(len(b) + 1)
            b[k : k + rnd.randrange(3)] = [rnd.randrange(400) for _ in range(rnd.randrange(3))]
        if rnd.random() < 0.2:
            b = b[len(b) // 2 :] + b[: len(b) // 2]
        x, y = np.array(a, np.uint32), np.array(b, np.uint32)
        exact = _aligned_words(a, b)
        assert shingles.banded_lcs(x, y, 200) == exact >= shingles.banded_lcs(x, y, 3)
        similarity, bound = shingles.word_alignment(shingles.Marked(x), shingles.Marked(y), 0.8)
        want = exact / (len(a) + len(b) - exact) if a or b else 1.0
        assert similarity <= want + 1e-12 and bound >= want - 1e-12 and (similarity >= 0.8) == (want >= 0.8)


def test_near_dedup_edges(spark, edge):
    got = near.near_duplicates(edge).collect()
    assert len(got) == len(EDGE)
    by = {(r["doc_id"], r["class_id"]) for r in got}
    assert (1, 1) in by and (2, 1) in by and (10, 9) in by and (None, None) in by
    assert [r["kept"] for r in got if r["doc_id"] == 3] == [True, True]
    assert near.near_duplicates(edge.limit(0)).count() == 0


def test_words_are_cut_at_ascii_white_space_only():
    rnd = random.Random(1)
    texts = ["".join(rnd.choices("ab \t\n\r\x0b\x0c\x1c\x1f\x85\xa0\u2003\0é", k=rnd.randrange(30))) for _ in range(2000)] + ["", " ", " a "]
    want = [[zlib.crc32(w.encode()) for w in re.findall(r"[^\x20\x09-\x0D]+", t)] for t in texts]
    hashes, sizes = shingles.word_hashes(pa.array(texts))
    assert sizes.tolist() == [len(w) for w in want] and hashes.tolist() == sum(want, [])
    distinct, codes, ends = quality.cut_words(pa.array(texts).slice(7))
    assert [distinct[int(c)].as_py() for c in codes] == [w for t in texts[7:] for w in re.findall(r"[^\x20\x09-\x0D]+", t)] and ends[-1] == len(codes)


def _longest_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b):
            before, row[j + 1] = row[j + 1], before + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def test_alignment_is_the_longest_common_subsequence():
    """Of shingles made from the words themselves, without hashes, labels or a band."""
    rnd = random.Random(13)
    reached = 0
    for k in range(300):
        a = [rnd.choice("abcdefghijkl" if k % 3 else "ab") for _ in range(rnd.randint(0, 90))]
        b = list(a)
        for _ in range(rnd.choice([0, 1, 1, 2, 5])):
            at = rnd.randrange(len(b) + 1)
            b[at : at + rnd.choice([0, 1, 3])] = [rnd.choice("abxyz") for _ in range(rnd.choice([0, 1, 2]))]
        if k % 7 == 0:
            b = b[len(b) // 2 :] + b[: len(b) // 2]
        grams = [[tuple(t[i : i + 5]) for i in range(len(t) - 4)] if len(t) >= 5 else [tuple(t)] if t else [] for t in (a, b)]
        h1, h2 = (shingles.word_hashes(pa.array([" ".join(t)]))[0] for t in (a, b))
        s, bound = shingles.alignment(*(shingles.labelled(shingles.shingles(h)) for h in (h1, h2)), 0.8)
        common, total = _longest_common(*grams), len(grams[0]) + len(grams[1])
        want = common / (total - common) if common else float(not total)
        # Labels tell repeats apart by their number, so an insertion between repeats can only lower the similarity.
        assert s <= want + 1e-12 and s <= bound + 1e-12
        if all(len(set(g)) == len(g) for g in grams):
            assert s == pytest.approx(want) if want >= 0.8 else s < 0.8
            reached += want >= 0.8
    assert reached > 40


def test_near_dedup_keeps_columns_of_any_name_and_string_ids(spark):
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([("b", text, 1, 2), ("a", text + " more", 1, 2), ("c", None, 1, 2)], "doc_id string, text string, node int, class_id int")
    got = {r["doc_id"]: (r["class_id"], r["kept"]) for r in near.near_duplicates(docs).collect()}
    assert got == {"a": ("a", True), "b": ("a", False), "c": ("c", True)}


def test_order_matters_to_the_signature():
    rnd = np.random.default_rng(0)
    a = shingles.mix(rnd.integers(0, 1 << 60, 400).astype(np.uint64))
    same, turned = a.copy(), a[::-1].copy()
    s = [set(shingles.order_minhash(x, 20, 4).tolist()) for x in (a, same, turned)]
    assert s[0] == s[1] and len(s[0] & s[2]) <= 3
    assert shingles.alignment(a, turned, 0.8)[0] < 0.8 <= shingles.alignment(a, turned, 0.8)[1]


# Mixing


def _targets(sizes, weights=(5, 2, 1), most=3):
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    left, open_, out = sum(sizes.values()), set(order), {}
    while open_:
        total = sum(w[s] for s in open_)
        over = [s for s in open_ if left * w[s] / total > most * sizes[s]]
        if not over:
            out |= {s: left * w[s] / total for s in open_}
            break
        for s in over:
            out[s] = most * sizes[s]
        left -= sum(out[s] for s in over)
        open_ -= set(over)
    return out


@pytest.mark.parametrize("block", [7, 64])
def test_mixing(spark, edge, block):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "source")
    more = docs.unionByName(docs.where("doc_id < 60").withColumn("doc_id", F.col("doc_id") + 1000).withColumn("source", F.when(F.col("doc_id") % 2 == 0, "zz tiny").otherwise(None))).unionByName(edge.select("doc_id", "text", "source"))
    rows = mixing.mix(more, block).toPandas()
    texts = more.toPandas()
    texts["n"] = [len(re.findall(r"[^\x20\x09-\x0D]+", t)) if isinstance(t, str) else 0 for t in texts.text]
    sizes = {None if not isinstance(s, str) else s: int(g.n.sum()) for s, g in texts.groupby("source", dropna=False)}
    want = sorted(_targets(sizes).items(), key=lambda kv: kv[1])
    got = sorted({(r.source_size, round(r.target, 6)) for r in rows.itertuples()})
    assert {round(t, 6) for _, t in got} == {round(t, 6) for s, t in want if sizes[s]}
    taken = rows.groupby(["source_size", "target"]).taken.sum().reset_index()
    assert (abs(taken.taken - taken.target) <= 6 * block).all() and (rows.taken <= 3 * rows["size"]).all() and len(rows) == len(texts)
    key = ["doc_id", "size", "source_size", "taken"]
    own = lambda r: sorted(map(tuple, r[key].fillna(-1).to_numpy().tolist()))
    assert own(rows) == own(mixing.mix(more.repartition(3), block).toPandas()) != own(mixing.mix(more, block, seed=99).toPandas())
    assert mixing.mix(more.limit(0)).count() == 0


def test_words_taken_are_those_of_the_slots(spark, edge, monkeypatch):
    """By brute force: every word of every slot counts for the document that it stands in; without the draw others are taken."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "source").unionByName(edge.select("doc_id", "text", "source"))
    targets, placed = mixing.streams(docs)
    laid, block = placed.toPandas(), 16
    counts = mixing.shard_counts(targets, block, 100)
    slots = mixing.mix_slots(counts).toPandas()
    assert slots.duplicated(["shard", "place"]).sum() == 0 and slots.duplicated(["sid", "epoch", "block"]).sum() == 0 and (slots.epoch < 3).all()
    at = slots.groupby("shard").place
    assert ((at.max() < 100) & (at.min() >= 0)).all()
    for sid, own in laid.groupby("sid"):
        stream = np.repeat(np.arange(len(own)), own.sort_values("from")["size"])
        words = np.zeros(len(own), int)
        for b in slots[slots.sid == sid].block:
            words += np.bincount(stream[b * block : (b + 1) * block], minlength=len(own))
        laid.loc[own.sort_values("from").index, "want"] = words
    key = lambda r, c: sorted((-1 if i is None or i != i else int(i), int(z), int(t)) for i, z, t in zip(r.doc_id, r["size"], r[c], strict=True))
    got = mixing.mix(docs, block, 100).toPandas()
    assert key(got, "taken") == key(laid, "want")
    sure_alone = lambda *a: counts.withColumn("count", F.greatest(F.col("count") - 1, F.lit(0))).where("count > 0")
    monkeypatch.setattr(mixing, "shard_counts", sure_alone)
    assert key(mixing.mix(docs, block, 100).toPandas(), "taken") != key(got, "taken")


def test_permutation(spark):
    for n in (1, 2, 37, 1000):
        r = spark.range(n).select("id", mixing.permuted(F.col("id"), F.lit(n), F.lit(5)).alias("p")).withColumn("b", mixing.permuted(F.col("p"), F.lit(n), F.lit(5), inverse=True)).collect()
        assert sorted(x["p"] for x in r) == list(range(n)) and all(x["b"] == x["id"] for x in r)


@pytest.mark.parametrize("exact", [True, False])
def test_shard_counts_are_multinomial(spark, exact):
    """Whole shards vary as multinomial draws do (given the totals, where these are exact: with 2000 shards the difference is 1 in 2000)."""
    targets = mixing.source_targets(spark.createDataFrame([("a", 30_030), ("b", 50_000), ("c", 20_070), ("d", 0)], "source string, size long"))
    every = mixing.shard_counts(targets, 1, 50, exact=exact).toPandas().pivot(index="shard", columns="sid", values="count").fillna(0)
    counts = every.iloc[:-1]
    t = targets.toPandas().set_index("sid").target[[0, 1, 2]]
    p = t / t.sum()
    assert (counts.sum(1) == 50).all() and len(counts) > 1900
    assert np.allclose(counts.mean(), 50 * p, atol=0.3) and np.allclose(counts.cov(), 50 * (np.diag(p) - np.outer(p, p)), atol=0.12 * 50 * p.max())
    assert (abs(every.sum() - t).max() <= 1) == exact


# LM


def test_lm_scores(spark, edge):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").unionByName(edge.select("doc_id", "text"))
    rows = lm.score(docs).toPandas()
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    held = lambda i: i is not None and zlib.crc32(str(int(i)).encode()) % 7 == 2
    texts = [(None if r[0] is None else r[0], re.findall(r"[^\x20\x09-\x0D]+", (r[1] or "").translate(low)) + ["\0"]) for r in docs.collect()]
    c = Counter(w for i, t in texts if not held(i) for w in t)
    n, v = sum(c.values()), len(c)
    want = sorted((-1 if i is None else i, held(i), len(t), sum(c[w] > 0 for w in t), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), 6)) for i, t in texts)
    got = sorted((-1 if r.doc_id != r.doc_id else int(r.doc_id), bool(r.held_out), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows.itertuples())
    assert len(got) == len(want) and all(a[:5] == b[:5] and abs(a[5] - b[5]) < 1e-4 for a, b in zip(got, want, strict=True))
    out = rows[rows.held_out]
    assert (rows.score <= 0).all() and np.isfinite(rows.score).all() and out.score.sum() > out.base_score.sum()
    assert lm.score(docs.limit(0)).count() == 0


def _plain_lm(texts):
    """Scores of (id, words) texts by counting and by expectation-maximisation token by token."""
    part = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7
    pairs_of = lambda w: list(zip(["\0", *w[:-1]], w, strict=True))
    words, pairs, kept_words, kept_pairs = Counter(), Counter(), Counter(), Counter()
    for i, w in texts:
        if part(i) != 2:
            words.update(w)
            pairs.update(pairs_of(w))
            if part(i) != 3:
                kept_words.update(w)
                kept_pairs.update(pairs_of(w))
    n, v, n_kept = sum(words.values()), len(words), sum(kept_words.values())
    bucket = lambda c: min(23, int(math.log2(c)) + 1) if c else 0
    tokens = [(bucket(kept_words[p]), kept_pairs[p, w] / kept_words[p] if kept_words[p] else 0.0, kept_words[w] / max(n_kept, 1)) for i, t in texts if part(i) == 3 for p, w in pairs_of(t)]
    prior, weights, met = (0.5, 0.4, 0.1), {b: (0.5, 0.4, 0.1) for b in range(24)}, {b for b, *_ in tokens}
    for _ in range(60):
        new = dict(weights)
        for b in met:
            sums, total = list(prior), 1.0
            for _, p2, p1 in (t for t in tokens if t[0] == b):
                e = [weights[b][0] * p2, weights[b][1] * p1, weights[b][2] / (v + 1)]
                sums = [s + x / sum(e) for s, x in zip(sums, e, strict=True)]
                total += 1
            new[b] = tuple(s / total for s in sums)
        change = max((abs(x - y) for b in met for x, y in zip(new[b], weights[b], strict=True)), default=0.0)
        weights = new
        if change < lm.SETTLED:
            break
    for b in range(1, 24):
        if b not in met:
            weights[b] = weights[b - 1] if any(k < b for k in met) else prior
    weights[0] = (0.0, weights[0][1] / (1 - weights[0][0]), weights[0][2] / (1 - weights[0][0]))
    p = lambda q, w: sum(x * y for x, y in zip(weights[bucket(words[q])], (pairs[q, w] / words[q] if words[q] else 0.0, words[w] / max(n, 1), 1 / (v + 1)), strict=True))
    return [(i, sum(math.log10(p(q, w)) for q, w in pairs_of(t))) for i, t in texts]


def test_lm_scores_equal_a_plain_model(spark, edge):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").unionByName(edge.select("doc_id", "text"))
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    texts = [(r[0], re.findall(r"[^\x20\x09-\x0D]+", (r[1] or "").translate(low)) + ["\0"]) for r in docs.collect()]
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    want = sorted(_plain_lm(texts), key=key)
    got = sorted(((r["doc_id"], r["score"]) for r in lm.score(docs).collect()), key=key)
    assert [i for i, _ in got] == [i for i, _ in want]
    assert all(abs(a - b) < 1e-6 * max(1, abs(b)) for (_, a), (_, b) in zip(got, want, strict=True))


def test_lm_ids_may_be_strings(spark):
    docs = spark.createDataFrame([(i, f"a b c d{i}") for i in ["x", "y", None, "z" * 40]], "doc_id string, text string")
    assert sorted(str(r["doc_id"]) for r in lm.score(docs).collect()) == ["None", "x", "y", "z" * 40]


def test_em_finds_the_weights(spark):
    cells = spark.createDataFrame([(10, 9, 1, 700), (10, 0, 10, 300)], "context long, pair long, word long, times long")
    w = lm.expectation_maximisation(cells, 1000, 1e-6)
    assert 0.6 < w[4, 0] < 0.8 and np.allclose(w.sum(1), 1) and (w[:, 2] > 0).all() and w[0, 0] == 0 and (w[5] == w[4]).all() and (w[3] == lm.PRIOR).all()


# Quality


def test_quality(spark, edge):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = quality.classify(docs, labels).join(labels, "doc_id").toPandas()
    held = rows[rows.held_out]
    assert (held.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in held.doc_id]).all()
    assert (held.predicted == held.quality).mean() > 0.93 and held[held.quality == 1].predicted.mean() > 0.97
    assert rows.score.between(0, 1).all() and (rows.predicted == (rows.score >= 0.3)).all()
    got = quality.classify(edge, labels.unionByName(spark.createDataFrame([(None, 1, 0), (3, None, 0)], labels.schema)))
    assert got.count() == len(EDGE)
    none = quality.classify(edge, labels.limit(0)).collect()
    assert {r["score"] for r in none} == {0.5} and quality.classify(edge.limit(0), labels).count() == 0


def _plain_rows(word):
    """The rows of a word and of its shape, by the rules one after another."""
    import regex

    shape = regex.sub(r"(\P{L})\p{Lu}[\p{Ll}\p{M}]", r"\1Aa", word)
    for pattern, to in quality.SHAPES:
        shape = regex.sub(pattern, to, shape)
    shape = regex.sub(r"([^\pL\pN])[^\pL\pN]+", r"\1", shape[:12])
    return zlib.crc32(word.lower().encode()) % quality.ROWS, zlib.crc32(b"shape:" + shape.encode()) % quality.ROWS


def test_word_vectors_and_pooling_by_plain_loops(spark):
    """Contexts of all texts, whatever task they are in, and the features of each text, word by word."""
    texts = ["Whence!! came the 12 Foxes, and whither?", "", "one", None, "the the the the", "Ärger über 3.5 ÉTÉ's\nline two", *(" ".join(random.Random(k).choices(["alpha", "Beta", "g4", "d!"], k=30)) for k in range(20))]
    where, sign = quality.index_vectors()
    want = np.zeros((quality.ROWS, quality.DIMS))
    cut = [re.findall(r"[^ \t\n\r\x0b\x0c]+", t or "") for t in texts]
    for words in cut:
        rows = [_plain_rows(w)[0] for w in words]
        for i, r in enumerate(rows):
            for j in range(max(0, i - quality.WINDOW), min(len(rows), i + quality.WINDOW + 1)):
                if i != j:
                    np.add.at(want[r], where[rows[j]], sign[rows[j]])
    got = quality.context_table(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3))
    assert (got == want).all() and want.any()
    vectors_, index = quality._vectors(got), quality.dense_index()
    x = quality.pool(quality.read_words(pa.array(texts)), vectors_, index)
    for row, words in zip(x, cut, strict=True):
        both = [_plain_rows(w) for w in words]
        means = [np.mean([t[r[k]] for r in both], axis=0) if both else np.zeros(quality.DIMS) for k, t in enumerate((vectors_, index))]
        plain = np.concatenate([*means, [np.linalg.norm(m) for m in means], [math.log1p(len(words))]])
        assert np.allclose(row, plain, atol=2e-5)


def test_probabilities_are_calibrated(spark):
    """On held-out rows of sf0.01: order, and mean probability against the share of label 1 in four groups."""
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = quality.classify(docs, labels).join(labels, "doc_id").where("held_out and quality is not null").toPandas().sort_values("score")
    good, bad = rows.score[rows.quality == 1].to_numpy(), rows.score[rows.quality == 0].to_numpy()
    auc = (good[:, None] > bad[None, :]).mean() + (good[:, None] == bad[None, :]).mean() / 2
    gaps = [abs(g.score.mean() - g.quality.mean()) * len(g) / len(rows) for _, g in rows.groupby(np.arange(len(rows)) * 4 // len(rows))]
    assert auc > 0.95 and sum(gaps) < 0.1


def test_the_temperature_is_the_best_one():
    rnd = np.random.default_rng(4)
    x = rnd.normal(size=(3000, 4)).astype(np.float32)
    y = (rnd.random(3000) < 1 / (1 + np.exp(-1.5 * x[:, 0]))).astype(np.int64)
    kept = np.arange(3000) % 5 == 1
    net = quality.train(x, y, kept)

    def loss(t):
        p = 1 / (1 + np.exp(-net.logits(x[kept]) / t))
        return -np.mean(np.where(y[kept] == 1, np.log(p), np.log(1 - p)))

    assert all(loss(net.temperature) <= loss(t) + 1e-9 for t in (0.25, 0.5, 0.8, 1.0, 1.3, 2.0, 4.0, 8.0))
    assert abs(net.probability(x[kept]).mean() - y[kept].mean()) < 0.05


def test_temperature_and_training():
    rnd = np.random.default_rng(1)
    x = rnd.normal(size=(2000, 6)).astype(np.float32)
    y = (x[:, 0] * x[:, 1] > 0).astype(np.int64)
    net = quality.train(x, y, np.arange(2000) % 5 == 0)
    assert ((net.probability(x) > 0.5) == y).mean() > 0.9 and 0.2 < net.temperature < 8


# Licences, urls, vectors


def test_licences_edges(spark, edge):
    got = {r["doc_id"]: r for r in licences.scan(edge).collect()}
    assert got[None]["labels"] == "apache,apache-2.0" and got[None]["first_word"] == 3 and got[1]["n_words"] == 0 and got[7]["n_words"] == 30_000
    assert licences.scan(edge).count() == len(EDGE) and licences.scan(edge.limit(0)).count() == 0


def test_licences_sql_on_planted(spark):
    rnd = random.Random(8)
    pieces = [t for _, t in licences.TEMPLATES] + list(licences.PHRASES) + ["mit license mit license", "GNU General-Public License", "éé cc by"]
    rows = []
    for i in range(120):
        words = ["w%d" % rnd.randrange(500) for _ in range(rnd.randint(0, 150))]
        for _ in range(rnd.randint(0, 3)):
            own = rnd.choice(pieces).split()
            for _ in range(rnd.randint(0, 2)):
                own[rnd.randrange(len(own))] = "zz"
            k = rnd.randint(0, len(words))
            words[k:k] = own
        rows.append((i, rnd.choice([" ", ", ", "\n"]).join(words)))
    frame = pd.DataFrame(rows, columns=["doc_id", "text"])
    columns, want = duck(licences.op9_sql(), {"documents": frame})
    got = licences.scan(spark.createDataFrame(frame)).select(*columns).collect()
    assert rows_of(columns, want) == rows_of(columns, [tuple(r) for r in got])


def test_licences_of_any_length_are_found(spark):
    """A template of 500 words, whole licence texts, and letters that only Unicode lower-cases to ASCII."""
    rnd = random.Random(11)
    long = " ".join("t%d" % rnd.randrange(260) for _ in range(500))
    templates = (*licences.TEMPLATES, ("long", long), ("none", " ,.; "))
    rows = []
    for i in range(60):
        words = ["w%d" % rnd.randrange(300) for _ in range(rnd.randrange(900))]
        own = (long if i % 2 else rnd.choice(licences.TEMPLATES[-5:])[1]).split()
        for _ in range(rnd.choice([0, 20, 100, 300]) * len(own) // 500):
            own[rnd.randrange(len(own))] = "zz"
        k = rnd.randint(0, len(words))
        rows.append((i, " ".join(words[:k] + own + words[k:])))
    rows += [(100, "This wor\u212a is licensed under a Creative Commons Attribution 4.0"), (101, "no word of any licence"), (102, None), (102, None)]
    frame = pd.DataFrame(rows, columns=["doc_id", "text"])
    columns, want = duck(licences.op9_sql(templates), {"documents": frame})
    got = licences.scan(spark.createDataFrame(rows, "doc_id long, text string"), templates).select(*columns).collect()
    assert rows_of(columns, want) == rows_of(columns, [tuple(r) for r in got])
    by = {r["doc_id"]: r for r in got}
    assert sum("long" in r["labels"].split(",") for r in got) >= 10 and sum("-text" in r["labels"] for r in got) >= 10
    exact = licences.scan(spark.createDataFrame([(1, t) for _, t in licences.TEMPLATES], "doc_id long, text string")).collect()
    assert all(r["labels"] for r in exact) and by[100]["labels"] == by[101]["labels"] == ""
    assert {r["labels"] for r in licences.scan(spark.createDataFrame(rows[:3], "doc_id long, text string"), ()).collect()} == {""}


PAGES = [(1, "http://a.org/x", '<link rel="canonical" href="http://b.net/fr/1">'), (2, "http://c.org/y", '<meta http-equiv="refresh" content="0; url=http://a.org/x/">'), (3, None, None), (4, "nourl", "x"), (5, "http://d.org/z", '<link rel=canonical href="//e.com/q">'), (6, "http://g.org/z", '<link href="/other" rel="canonical">'), (7, "HTTP://WWW.Example.com/en/1?x#y", ""), (8, "http://example.com?x", ""), (9, "http://h.org", "<link rel=canonical href=http://b.net/fr/1>"), (9, "http://h.org", "<link rel=canonical href=http://b.net/fr/1>"), (10, "http://i.org/p", '<link rel="canonical" href="http://ok.com/1">'), (11, "http://j.org/p", '<link rel="canonical" href="http://b.net/fr/2">'), (12, "http://j.org/p?utm_source=x", '<link rel="canonical" href="http://ok.com/2">'), (13, "ftp://k.net/es/", None), (14, "http://m.l.org/q.html#top", '<link rel="canonical" href="../b.net">'), (15, "http://l.org/q/", '<meta content="1;url=http://b.net/es/9" http-equiv=refresh><meta http-equiv=refresh content="1;url=http://b.net/es/9">')]


def test_urls(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    frame = pd.DataFrame(PAGES, columns=["page_id", "url", "html"])
    for loose in (False, True):
        got = urls.judge(df, loose=loose).collect()
        columns, want = duck(urls.op2_sql(loose), {"pages": frame})
        assert rows_of(columns, want) == rows_of(columns, [tuple(r[c] for c in columns) for r in got])
    by = {r["page_id"]: r["verdict"] for r in got}
    assert by[2] == by[1] == by[9] == "block" and by[10] == "allow" and by[11] == by[12] == "allow" and by[3] == by[4] == "allow" and by[14] == by[15] == "block"
    assert urls.judge(df.limit(0)).count() == 0


def test_long_rule_lists_give_the_longest_rule(spark):
    """Hundreds of rules, many of which fit, against a plain search; both plans."""
    rnd = random.Random(21)
    hosts, paths = ["com", "a.com", "b.a.com", "net", "x.net"], ["/", "/en/", "/en/1", "/fr/", "/f"]
    every = [(rnd.choice(["allow", "block"]), h, p) for h in hosts for p in paths]
    pages = [(i, f"http://{rnd.choice(['', 'www.', 'q.'])}{rnd.choice(hosts + ['org', 'xa.com'])}{rnd.choice(paths + ['', '/en', '/fr/2'])}", "") for i in range(300)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    some = rnd.sample(every, 15)
    for rules in (some, [*some, *(("block", f"x{i}.test", "/") for i in range(300))]):
        for r in urls.judge(df, rules).collect():
            fits = [(len(h) + len(p), h + p, v) for v, h, p in rules if (r["host"] == h or r["host"].endswith("." + h)) and r["path"].startswith(p)]
            assert (r["rule"], r["verdict"]) == (max(fits)[1:] if fits else (None, r["verdict"]))


def test_long_rule_lists_are_joined(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    rules = (*urls.RULES, *(("block", f"x{i}.test", "/") for i in range(300)))
    key = lambda rows: sorted(map(str, rows))
    assert key(urls.judge(df, rules).collect()) == key(urls.judge(df).collect())


def test_vectors_by_brute_force(spark):
    rnd = np.random.default_rng(1)
    base = rnd.normal(size=(150, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    v = [*base, *(base[0] + rnd.normal(size=64) * rnd.choice([0.01, 0.03]) for _ in range(700)), *(base[1] for _ in range(20)), *(base[2 + i] + rnd.normal(size=64) * 0.03 for i in range(20))]
    v = np.array(v, np.float32)
    odd = [(5000, None), (5001, [0.0] * 64), (5002, [float("nan")] * 64), (5003, []), (5004, [1.0, 2.0]), (5005, [2.0, 4.0]), (5005, [2.0, 4.0]), (5006, [None, 1.0])]
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)] + odd, "vec_id long, embedding array<float>").withColumn("id", F.lit(1)).withColumn("component", F.lit(2))
    rows = vectors.near_vectors(df).toPandas().sort_values("vec_id")
    unit = vectors.unit(v)
    links = unit @ unit.T >= 0.95
    np.fill_diagonal(links, False)
    n = rows[rows.vec_id < 5000].n_links.to_numpy()
    assert (n <= links.sum(1)).all() and n.sum() >= 0.999 * links.sum()
    got = rows[rows.vec_id >= 5000].set_index("vec_id")
    assert got.loc[[5000, 5001, 5002, 5003, 5006]].n_links.tolist() == [0] * 5 and got.loc[[5004, 5005]].n_links.tolist() == [2, 2, 2] and set(got.loc[[5004, 5005]].component_id) == {5004}
    assert (rows.kept == (rows.vec_id == rows.component_id)).all()
    assert vectors.near_vectors(df.limit(0)).count() == 0
    assert json.dumps(sorted(set(rows.component_id[rows.vec_id < 5000][n > 600]))) == "[0]"


def _exact_links(spark, v):
    """n_links and component_id by near_vectors, and by comparing all pairs."""
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "vec_id long, embedding array<float>")
    rows = vectors.near_vectors(df).toPandas().sort_values("vec_id")
    unit = vectors.unit(v)
    near = unit @ unit.T >= 0.95
    np.fill_diagonal(near, False)
    own = np.arange(len(v))
    for _ in range(len(v)):
        least = np.minimum(own, np.where(near, own[None, :], len(v)).min(1))
        if (least == own).all():
            break
        own = least
    return rows.n_links.to_numpy(), rows.component_id.to_numpy(), near.sum(1), own


def test_vectors_of_tight_groups_link_across(spark):
    rnd = np.random.default_rng(5)
    a, b = np.linalg.qr(rnd.normal(size=(64, 2)))[0].T
    b = 0.97 * a + math.sqrt(1 - 0.97**2) * b
    v = np.array([*(a + rnd.normal(size=(200, 64)) * 0.002), *(b + rnd.normal(size=(200, 64)) * 0.002)], np.float32)
    n, part, want_n, want_part = _exact_links(spark, v)
    assert (want_n == 399).all() and (n == want_n).all() and (part == want_part).all()


def _planted_pairs(n, pairs, seed):
    """n random vectors, of which the first ``pairs`` have a copy at cosine 0.952 to 0.965 behind them all."""
    rnd = np.random.default_rng(seed)
    base = vectors.unit(rnd.normal(size=(n, 64)))
    other = rnd.normal(size=(pairs, 64))
    other -= (other * base[:pairs]).sum(1, keepdims=True) * base[:pairs]
    c = rnd.uniform(0.952, 0.965, (pairs, 1))
    return np.vstack([base, c * base[:pairs] + np.sqrt(1 - c * c) * vectors.unit(other)])


def _stored(spark, folder, v):
    flat = pa.array(v.astype(np.float64).ravel())
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1) * v.shape[1], pa.int32()), flat)
    pq.write_table(pa.table({"vec_id": pa.array(np.arange(len(v))), "embedding": lists}), f"{folder}/v.parquet")
    return spark.read.parquet(f"{folder}/v.parquet")


@pytest.mark.parametrize("n", [6000, 80_000])
def test_vectors_in_rare_pairs_are_found(spark, n, tmp_path):
    df = _stored(spark, tmp_path, _planted_pairs(n, 400, 6))
    rows = vectors.near_vectors(df).toPandas().set_index("vec_id").sort_index()
    met = (rows.component_id.loc[n:].to_numpy() == np.arange(400)).sum()
    assert met >= 396 and rows.n_links.sum() == 2 * met and (rows.n_links <= 1).all()


def test_audit_raises_where_recall_is_low(spark, monkeypatch, tmp_path):
    """Two attempts with one table of many hyperplanes lose most pairs: no answer is better than that one."""
    monkeypatch.setattr(vectors, "tables_for", lambda n, threshold: (12, 1))
    df = _stored(spark, tmp_path, _planted_pairs(3000, 300, 8))
    with pytest.raises(RuntimeError, match="recall"):
        vectors.near_vectors(df).count()


def test_tables_follow_the_number_of_vectors():
    rnd = np.random.default_rng(3)
    for n in (100_000, 10_000_000):
        planes, tables = vectors.tables_for(n, 0.95)
        x = vectors.unit(rnd.normal(size=(400, 64)))
        assert vectors.planted_recall(list(x), {64: (planes, tables)}, 0.95, 1) >= 0.99
    assert vectors.tables_for(10**9, 0.95)[1] < 60 and vectors.tables_for(10, 0.95) == (0, 1)


def test_vectors_with_shared_ids_and_lengths(spark):
    e = [1.0, 0.0, 0.0]
    rows = [(1, e), (1, [0.0, 1.0, 0.0]), (2, [0.0, 2.0, 0.1]), (None, [0.99, 0.01, 0.0]), (None, [0.0, 0.0, 1.0]), (7, [1.0, 0.0])]
    got = sorted(map(str, ((r["n_links"], r["component_id"], r["kept"]) for r in vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())))
    assert got == sorted(map(str, [(1, 1, True), (1, 1, True), (1, 1, False), (1, 1, False), (0, None, True), (0, 7, True)]))


def test_spread_join_equals_a_join(spark):
    many = spark.createDataFrame([(1 if i % 3 else None if i % 2 else i, i) for i in range(4000)], "k long, v long")
    one = spark.createDataFrame([(1, "a"), (1, "b"), (3, "c"), (None, "d")], "k long, w string")
    for how in ("inner", "left"):
        got = common.spread_join(many, one, ["k"], ["v"], how)
        assert sorted(map(str, got.select("k", "v", "w").collect())) == sorted(map(str, many.join(one, "k", how).select("k", "v", "w").collect()))


def test_scratch_goes_with_its_scope(spark):
    import os

    df = spark.range(5)
    there = lambda d: os.path.exists(d._scratch.toUri().getPath())
    with common.scratch_scope() as keep:
        a, b = common.materialize(df, "a"), common.materialize(df, "b")
        with common.scratch_scope() as inner:
            c, d = common.materialize(df, "c"), common.materialize(df, "d")
            inner(d)
        assert there(a) and there(d) and not there(c)
        keep(b)
    assert there(b) and not there(a) and not there(d) and b.count() == 5
    common.discard(b, None)
    assert not there(b)


def test_scratch_needs_a_shared_folder_on_a_cluster():
    class Context:
        master, applicationId = "spark://host:7077", "app"
        getConf = lambda self: {}

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.scratch_root(Session())


def test_urls_use_every_link_of_a_page(spark):
    both = '<link rel="canonical" href="http://stub.org/p"><meta http-equiv="refresh" content="0; url=http://b.net/fr/1">'
    two = '<link rel="canonical" href="http://other.org/c"><link href="http://b.net/es/1" rel="canonical">'
    rows = [(1, "http://stub.org/p", both), (2, "http://alias.org/q", '<link rel="canonical" href="http://stub.org/p">'), (3, "http://twice.org/r", two), (4, "http://other.org/c", ""), (5, "http://free.org/s", "")]
    got = {r["page_id"]: r["verdict"] for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    columns, want = duck(urls.op2_sql(), {"pages": pd.DataFrame(rows, columns=["page_id", "url", "html"])})
    assert {r[columns.index("page_id")]: r[columns.index("verdict")] for r in want} == got
    assert got == {1: "block", 2: "block", 3: "block", 4: "block", 5: "allow"}


def test_only_edges_make_aliases(spark):
    """Another scheme, host prefix, ending or parameter is another url; upper-case hosts, fragments and no path are not."""
    blocked = '<link rel="canonical" href="http://b.net/fr/1">'
    rows = [(1, "http://a.org/x", blocked), (2, "https://a.org/x", ""), (3, "http://www.a.org/x", ""), (4, "http://a.org/x.html", ""), (5, "http://a.org/x?ref=1", ""), (6, "HTTP://A.org/x#part", ""), (7, "http://c.org", blocked), (8, "http://c.org/", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r["page_id"] for r in urls.judge(df).collect() if r["verdict"] == "block"} == {1, 6, 7, 8}
    assert {r["page_id"] for r in urls.judge(df, loose=True).collect() if r["verdict"] == "block"} == {1, 2, 3, 4, 5, 6, 7, 8}


def test_a_large_group_of_aliases(spark):
    """A hub that a third of all pages name, long chains, and pages that nothing names."""
    rows = [(i, f"http://p{i}.org/a", '<link rel=canonical href="http://hub.org/h">' if i < 3000 else f'<link rel=canonical href="http://p{i + 1}.org/a">' if i < 3040 else "") for i in range(5000)] + [(9000, "http://hub.org/h", '<meta http-equiv=refresh content="0;url=http://b.net/es/1">')]
    got = {r["page_id"]: r["verdict"] for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [i for i in got if got[i] == "block"] and {i for i in got if got[i] == "block"} == {*range(3000), 9000}
