from pyspark.sql import functions as F

import corpus_pipeline as cp
from silverquill.llm import common, lines, mixing, near, packing, quality

from ..oracle import DATA


def test_stages_take_effect(spark):
    assert [n for n, _ in cp.STAGES] == ["quality classifier", "line dedup", "near-dedup", "mixing", "best-fit packing"]
    docs = common.table(spark, DATA, "documents")
    labels = common.table(spark, DATA, "labels")
    columns = docs.columns
    ids = lambda df: sorted(r[0] for r in df.select("doc_id").collect())

    good = common.materialize(cp.quality(spark, docs, DATA), "t")
    assert good.columns == columns and ids(good) == ids(quality.classify(docs, labels).where("predicted = 1"))
    clean = docs.join(labels.where("quality = 1"), "doc_id", "left_semi")
    assert clean.join(good, "doc_id", "left_semi").count() >= 0.97 * clean.count()

    cut = common.materialize(cp.line_dedup(spark, good, DATA), "t")
    want = {r["doc_id"]: r["kept_text"] for r in lines.dedup(good).collect()}
    got = {r["doc_id"]: r for r in cut.collect()}
    assert cut.columns == columns and all(got[i]["text"] == t and got[i]["n_chars"] == len(t) for i, t in want.items() if i in got)
    assert all(not want[i].strip() for i in want if i not in got)

    alone = common.materialize(cp.near_dedup(spark, cut, DATA), "t")
    classes = near.near_duplicates(cut)
    assert ids(alone) == sorted(r[0] for r in classes.select("class_id").distinct().collect()) and alone.columns == columns

    mixed = common.materialize(cp.mixing(spark, alone, DATA), "t")
    assert mixed.columns == columns and mixed.join(alone, columns, "left_anti").count() == 0

    packed = cp.packing(spark, mixed, DATA)
    assert packed.agg(F.sum("length")).first()[0] == packing.token_pieces(mixed).agg(F.sum("length")).first()[0]
    assert cp.run(spark, DATA).count() == packed.count()


def test_near_dedup_keeps_one_of_repeated_rows(spark):
    text = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(1, text, "en", "s", 1), (1, text, "en", "s", 1), (2, text, "en", "s", 1), (3, "", "en", "s", 0), (4, None, None, None, None), (1, "another text of some words that differs", "en", "s", 1)], common.table(spark, DATA, "documents").schema)
    assert sorted((r["doc_id"], r["text"]) for r in cp.near_dedup(spark, docs, DATA).collect()) == [(1, "another text of some words that differs"), (1, text), (3, "")]


def test_empty_tables(spark):
    docs = common.table(spark, DATA, "documents").limit(0)
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, DATA)
        assert docs.count() == 0


def test_line_dedup_removes_repeated_short_lines(spark):
    menu = "Home\nNews\nShop\n"
    docs = spark.createDataFrame([(1, menu + "First text"), (2, menu + "Other text"), (3, "Alone\nhere\nnow")], "doc_id long, text string")
    assert sorted((r["doc_id"], r["text"]) for r in cp.line_dedup(spark, docs, DATA).collect()) == [(1, menu + "First text"), (2, "Other text"), (3, "Alone\nhere\nnow")]


def test_stages_on_odd_rows(spark):
    """Null ids and texts, one id with different texts, ties, a very long text, columns that clash with the stages' own."""
    odd = ["row", "own", "id", "hash", "times", "copy", "size", "taken", "text_hash", "_id", "_own", "_b", "number", "one", "cut", "lines"]
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [(None, "A null id stands here, with some more words in it.", "s"), (None, "Another null id, and other words than the first one.", "s"), (1, None, "s"), (2, "", None), (3, long, "t"), (4, "One id and a first text of a few words only.", "t"), (4, "One id and quite another text, longer than the first.", "t"), (5, "The same text twice in two rows of one id.", "t"), (5, "The same text twice in two rows of one id.", "t")]
    docs = spark.createDataFrame([(i, t, "en", s, len(t or ""), *range(len(odd))) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` int" for c in odd))
    for name, stage in cp.STAGES[:-1]:
        got = stage(spark, docs, DATA)
        assert got.columns == docs.columns, name
        kept = {(r["doc_id"], r["text"]) for r in got.collect()}
        assert kept <= {(i, t) for i, t, _ in rows}, name
        if name == "near-dedup":
            assert got.count() == len(kept) and kept == {(i, t) for i, t, _ in rows} - {(2, "")}
        if name == "line dedup":
            assert got.count() == len(rows)
    packed = cp.packing(spark, docs, DATA).collect()
    assert sum(r["length"] for r in packed) > 60_000 and sorted({str(r["doc_id"]) for r in packed}) == ["1", "2", "3", "4", "5", "None"]


def test_quality_tells_texts_of_one_id_apart(spark):
    labels = common.table(spark, DATA, "labels")
    judged = quality.classify(common.table(spark, DATA, "documents"), labels).join(common.table(spark, DATA, "documents").select("doc_id", "text"), "doc_id")
    good, bad = judged.orderBy(F.desc("score")).first()["text"], judged.orderBy("score").first()["text"]
    docs = common.table(spark, DATA, "documents").select("doc_id", "text").unionByName(spark.createDataFrame([(10**9, good), (10**9, bad)], "doc_id long, text string"))
    assert [r["text"] for r in cp.quality(spark, docs, DATA).where("doc_id = 1000000000").collect()] == [good]


def test_mixing_takes_a_document_as_often_as_the_mix(spark):
    """By brute force from the operator's answer: whole times, and one more by the draw of the rest."""
    docs = common.table(spark, DATA, "documents")
    times = {r["doc_id"]: r["count"] for r in cp.mixing(spark, docs, DATA).groupBy("doc_id").count().collect()}
    rows = mixing.mix(docs).collect()
    assert all(times.get(r["doc_id"], 0) in ({r["taken"] // r["size"], -(-r["taken"] // r["size"])} if r["size"] else {1}) for r in rows)
    words = {r["doc_id"]: r["size"] for r in rows}
    assert abs(sum(times.get(i, 0) * n for i, n in words.items()) / sum(words.values()) - 1) < 0.1
