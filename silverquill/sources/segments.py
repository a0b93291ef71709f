"""A text index of immutable segments: upserts write what they bring, searches read what is live, tiers of segments are merged.

A segment is the postings and lengths of the documents of one upsert, and the keys that it took over (or deleted). A posting is live unless
a later segment took its key. The segments and their order are a state in a commit log; a merge of neighbouring segments rewrites
their live postings only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.udf import counted_tokens
from ..operators.text import bm25, each_posting, parse_query, sorted_postings, summed_lengths
from .commits import Log

FAN = 4
"""So many neighbours of one tier become one segment; a tier holds segments of up to FAN times the documents of the tier below."""


class SegmentedIndex:
    """Postings of (key, text) under ``folder``, which all executors share."""

    def __init__(self, spark: SparkSession, folder: str, key: str, key_type: str = "long", fan: int = FAN) -> None:
        self.spark, self.folder, self.key, self.fan = spark, folder.rstrip("/"), key, fan
        self.log = Log(spark, self.folder)
        self.kinds = {"postings": f"token string, {key} {key_type}, tf int", "lengths": f"{key} {key_type}, token_count int", "gone": f"{key} {key_type}"}

    def segments(self) -> list[dict]:
        """The live segments in order, each with its number (``id``) and documents (``docs``)."""
        return self.log.last()[1].get("segments", [])

    def _number(self) -> int:
        """A number that no other writer has: numbers are commits of their own."""
        return self.log.commit(lambda s: {**s, "next": s.get("next", 0) + 1})["next"]

    def _write(self, number: int, parts: dict[str, DataFrame]) -> int:
        """Write a segment's tables; returns its documents."""
        sorted_postings(parts["postings"], self.key).select("token", self.key, "tf").write.parquet(f"{self.folder}/postings/segment={number}")
        for name in ("lengths", "gone"):
            parts[name].write.parquet(f"{self.folder}/{name}/segment={number}")
        return self.spark.read.schema(self.kinds["lengths"]).parquet(f"{self.folder}/lengths/segment={number}").count()

    def upsert(self, docs: DataFrame, text: str) -> None:
        """Index ``docs`` (key, text; one row per key) anew. Blank and null texts are left out, so a document keeps its old postings; a text without tokens
        takes the old ones away. What is written grows with ``docs`` only."""
        fresh = docs.where(F.length(F.trim(F.coalesce(text, F.lit("")))) > 0)
        number = self._number()
        counted_tokens(fresh, self.key, text).write.parquet(f"{self.folder}/counted/segment={number}")  # texts are cut once
        counted = self.spark.read.parquet(f"{self.folder}/counted/segment={number}")
        self._add({"postings": each_posting(counted, self.key), "lengths": summed_lengths(counted, self.key), "gone": fresh.select(self.key)}, number)
        self.log.drop(f"counted/segment={number}")

    def delete(self, keys: DataFrame) -> None:
        none = self.spark.createDataFrame([], self.kinds["postings"])
        self._add({"postings": none, "lengths": none.select(self.key, F.lit(0).alias("token_count")), "gone": keys.select(self.key).distinct()}, self._number())

    def _add(self, parts: dict[str, DataFrame], number: int) -> None:
        docs = self._write(number, parts)
        self.log.commit(lambda s: {**s, "segments": [*s.get("segments", []), {"id": number, "docs": docs}]})

    def _table(self, name: str, segments: list[dict]) -> DataFrame:
        """A table of the segments, with ``place``, the segment's place in their order. One scan, whatever their number."""
        if not segments:
            return self.spark.createDataFrame([], self.kinds[name]).withColumn("place", F.lit(0))
        places = F.create_map(*(F.lit(x) for i, s in enumerate(segments) for x in (s["id"], i)))
        read = self.spark.read.schema(self.kinds[name] + ", segment int").option("basePath", f"{self.folder}/{name}").parquet(*(f"{self.folder}/{name}/segment={s['id']}" for s in segments))
        return read.withColumn("place", F.element_at(places, F.col("segment"))).drop("segment")

    def _live(self, name: str, segments: list[dict], wanted: Column | None = None) -> DataFrame:
        taken = self._table("gone", segments).where("place > 0").groupBy(F.col(self.key).alias("_key")).agg(F.max("place").alias("_taken"))
        rows = self._table(name, segments)
        rows = rows if wanted is None else rows.where(wanted)
        return rows.join(taken, F.col(self.key).eqNullSafe(F.col("_key")), "left").where("_taken is null or place >= _taken").drop("_key", "_taken", "place")

    def search(self, query: str, limit: int | None = 100, prefixes: bool = False) -> DataFrame:
        """(key, score) as ``operators.text.search`` answers over the current documents."""
        atoms, segments = parse_query(query, prefixes), self.segments()
        wanted = F.lit(False)
        for a in atoms:
            wanted = wanted | (F.col("token").startswith(a.text) if a.prefix else F.col("token") == a.text)
        return bm25(self._live("postings", segments, wanted), self._live("lengths", segments), self.key, atoms, limit)

    def run_to_merge(self, segments: list[dict]) -> tuple[int, int] | None:
        """(start, end) of the neighbours to merge next: the shortest end of the list with ``fan`` segments that all belong to one tier or
        lower ones, none of them much larger than the others together (so a document is rewritten a few times only); deletes count as the lowest tier."""
        size = self.fan
        while segments and size <= self.fan * max(self.fan, *(s["docs"] for s in segments)):
            start = len(segments)
            while start and segments[start - 1]["docs"] < size:
                start -= 1
            docs = [s["docs"] for s in segments[start:]]
            if len(docs) >= self.fan and max(docs) <= (self.fan - 1) * (sum(docs) - max(docs)) + self.fan:
                return start, len(segments)
            size *= self.fan
        return None

    def merge(self) -> bool:
        """Merge one run of segments, if there is one. A segment that was added meanwhile stays behind it; if another merge came first, nothing changes."""
        segments = self.segments()
        run = self.run_to_merge(segments)
        if run is None:
            return False
        some, ids = segments[run[0] : run[1]], {s["id"] for s in segments[run[0] : run[1]]}
        number = self._number()
        gone = self._table("gone", some).select(self.key).distinct()
        docs = self._write(number, {"postings": self._live("postings", some).select("token", self.key, "tf"), "lengths": self._live("lengths", some).select(self.key, "token_count"), "gone": gone if run[0] else gone.limit(0)})

        def swap(state: dict) -> dict | None:
            now = state["segments"]
            at = next((i for i, s in enumerate(now) if s["id"] == some[0]["id"]), None)
            if at is None or [s["id"] for s in now[at : at + len(some)]] != [s["id"] for s in some]:
                return None
            return {**state, "segments": [*now[:at], {"id": number, "docs": docs}, *now[at + len(some) :]], "old": [*state.get("old", []), *sorted(ids)]}

        self.log.commit(swap)
        return True

    def vacuum(self) -> None:
        """Delete segments that merges replaced, once no search reads them."""
        old = self.log.last()[1].get("old", [])
        self.log.drop(*(f"{name}/segment={n}" for n in old for name in self.kinds))
        self.log.commit(lambda s: {**s, "old": [n for n in s.get("old", []) if n not in old]} if old else None)
        self.log.tidy()
