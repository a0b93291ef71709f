"""Main text of pages by wrapper induction over the pages of each host.

Every page is parsed into a tree of blocks (``dom``). The trees of a host's pages with one layout are aligned by simple tree
matching and merged into a template: within a task first, then among salted tasks, then once for the host, so that a host with any
share of the pages is merged by many tasks, each of which holds one template at a time. Nodes that are constant in the template go, the
varying slots of the part that holds most of the varying text are the article. Blocks whose element, ARIA role or class names
a menu, header, footer, sidebar, notice, advert, form or reader comments go too.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import dom
from .common import hot_keys, materialize, pieces_of, scratch_scope, spread_join, table, tidied
from .urls import host_of

LAYOUTS = 16
"""Layouts that a host's pages are told apart by: a host has at most so many templates."""
SALTS = 32
SENT_WHOLE = 8 << 20
"""Templates of up to so many bytes (measured) are sent whole to the tasks; more are joined by host."""
HELD = 1000
"""Templates that a task holds while it reads pages; then they go on, and are merged later."""


def _templates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host_key, html) to (host_key, layout, template)."""
    held: dict[tuple[str, int], dom.Template] = {}

    def out() -> pa.RecordBatch:
        names = [pa.array([k[0] for k in held], pa.string()), pa.array([k[1] for k in held], pa.int32()), pa.array([t.text() for t in held.values()], pa.string())]
        held.clear()
        return pa.RecordBatch.from_arrays(names, ["host_key", "layout", "template"])

    for b in batches:
        for host, html in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            page = dom.parse(html.as_py() or "")
            key, own = (host, dom.layout_of(page, LAYOUTS)), dom.Template.of(page, dom.shape(page))
            held[key] = held[key].plus(own) if key in held else own
            if len(held) >= HELD:
                yield out()
    if held:
        yield out()


def _merge_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbouring rows of one (host_key, layout) become one; one template is held at a time."""
    now, sum_ = None, None
    for b in batches:
        found = []
        for host, layout, text in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
            own = dom.Template.read(text)
            if (host, layout) == now:
                sum_ = sum_.plus(own)
                continue
            if now is not None:
                found.append((*now, sum_.text()))
            now, sum_ = (host, layout), own
        if found:
            yield _rows(found)
    if now is not None:
        yield _rows([(*now, sum_.text())])


def _rows(found: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], kind) for k, kind in enumerate((pa.string(), pa.int32(), pa.string()))], ["host_key", "layout", "template"])


def templates(pages: DataFrame) -> DataFrame:
    """(host_key, layout, template) of ``pages`` (host_key, html): one row per host and layout."""
    kinds = "host_key string, layout int, template string"
    n = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    each = pages.select("host_key", "html").mapInArrow(tidied(_templates), kinds).withColumns({"_task": F.spark_partition_id(), "_part": F.monotonically_increasing_id()})
    each = each.withColumn("_salt", F.pmod("_task", F.lit(SALTS)))
    some = each.repartition(n, "host_key", "layout", "_salt").sortWithinPartitions("host_key", "layout", "_salt", "_part").select("host_key", "layout", "template").mapInArrow(_merge_runs, kinds)
    some = some.withColumn("_part", F.spark_partition_id())
    return some.repartition(n, "host_key", "layout").sortWithinPartitions("host_key", "layout", "_part", "template").select("host_key", "layout", "template").mapInArrow(_merge_runs, kinds)


def _reader(shared, kinds: list[str]):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[str, int], dom.Template] = {}

        def template(host: str, layout: int, given) -> dom.Template | None:
            if (host, layout) not in known:
                if len(known) >= HELD:
                    known.clear()
                text = shared.value.get(host, {}).get(layout) if shared is not None else next((t["template"] for t in given or () if t["layout"] == layout), None)
                known[host, layout] = dom.Template.read(text) if text else None
            return known[host, layout]

        for b in (p for whole in batches for p in pieces_of(whole)):
            texts = []
            for k, html in enumerate(b.column(3)):
                page = dom.parse(html.as_py() or "")
                texts.append(dom.extract(page, dom.shape(page), template(b.column(2)[k].as_py(), dom.layout_of(page, LAYOUTS), None if shared is not None else b.column(4)[k].as_py())))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], kinds)

    return tidied(read)


def main_texts(pages: DataFrame, sent_whole: int = SENT_WHOLE) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages`` (page_id, url, html).

    A null or empty page has an empty text; null urls and urls without a host are one host; repeated rows are answered each; an empty
    table gives an empty one; other columns are left alone. A text counts as constant once ``dom.ENOUGH`` distinct pages of the host and layout all have
    it. A page whose article is constant as a whole keeps it. Blocks nested more than ``dom.DEEPEST`` deep are siblings.
    """
    spark = pages.sparkSession
    keyed = pages.select("page_id", "url", F.md5(host_of(F.col("url")).cast("binary")).alias("host_key"), "html")
    kind = pages.schema["page_id"].dataType.simpleString()
    schema, names = f"page_id {kind}, url string, text string, n_chars long", ["page_id", "url", "text", "n_chars"]
    with scratch_scope() as keep:
        found = materialize(templates(keyed), "templates")
        size = found.agg(F.sum(F.octet_length("template") + F.lit(64))).first()[0] or 0
        if size <= sent_whole:
            by_host: dict[str, dict[int, str]] = {}
            for r in found.collect():
                by_host.setdefault(r.host_key, {})[r.layout] = r.template
            return keyed.mapInArrow(_reader(spark.sparkContext.broadcast(by_host), names), schema)
        by_host = materialize(found.groupBy("host_key").agg(F.collect_list(F.struct("layout", "template")).alias("templates")), "hosts")
        sizes = keyed.groupBy("host_key").agg(F.count("*").alias("_rows"))
        met = spread_join(keyed, by_host, ["host_key"], ["page_id", "url"], "left", hot_keys(sizes, ["host_key"]))
        out = materialize(met.select("page_id", "url", "host_key", "html", "templates").mapInArrow(_reader(None, names), schema), "main-texts")
        keep(out)
        return out


def op12_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(table(spark, sf_dir, "pages"))
