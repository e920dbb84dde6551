"""An index in immutable segments: batches are appended, replaced documents are marked, and readers merge.

A batch of documents becomes a segment of level 0: folders of postings, title postings, lengths
and documents, and the ids of older documents that it replaces or deletes (its tombstones). A row
counts if no later segment has a tombstone for its document. The commit log names the segments of
a state, and for each how many documents and tokens it added and took away, so the statistics of
the corpus are sums of the log and never scan a table.

FANOUT segments of a level are merged into one of the next, so a document is rewritten about
log(n) times, and a search reads that many segments. Merging drops dead rows, and tombstones
once no older segment is left.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestone.operators import index as ix
from lodestone.sources.commit_log import CommitLog, Taken
from lodestone.sources.shared import removed, stored

FANOUT = 4
KINDS = {"postings": "term string, doc_id long, tf long", "titles": "term string, doc_id long, tf long", "lengths": "doc_id long, dl long", "documents": "doc_id long, text string", "tombstones": "doc_id long"}


class SegmentedIndex:
    """The segments below root. A reader takes the state of the last commit, or of one it names, and keeps it."""

    def __init__(self, spark: SparkSession, root: str, version: int | None = None):
        self.spark, self.root = spark, root.rstrip("/")
        self.log = CommitLog(spark, self.root)
        self.state = self.log.state(version) or {"version": 0, "tables": {}, "batches": [], "segments": [], "next": 1}

    # ---- reading

    def _union(self, kind: str, segments: list[dict]) -> DataFrame:
        parts = [
            self.spark.read.schema(KINDS[kind]).parquet(f"{self.root}/{s['folder']}/{s.get('tombstones') if kind == 'tombstones' else kind}").withColumn("seq", F.lit(s["seq"]).cast("long"))
            for s in segments
            if kind in s["has"]
        ]
        # files alone, whose size is known: with a frame of unknown size, few tombstones would have all postings shuffled
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], KINDS[kind] + ", seq long")

    def _live(self, kind: str, segments: list[dict] | None = None) -> DataFrame:
        """Rows of some segments (all by default) that no later one of them has a tombstone for."""
        segments = self.state["segments"] if segments is None else segments
        rows = self._union(kind, segments)
        if not any("tombstones" in s["has"] for s in segments):
            return rows.drop("seq")
        last = self._union("tombstones", segments).groupBy(F.col("doc_id").alias("_dead")).agg(F.max("seq").alias("_until"))
        return rows.join(last, (F.col("doc_id") == F.col("_dead")) & (F.col("_until") > F.col("seq")), "left_anti").drop("seq")

    def documents(self) -> DataFrame:
        return self._live("documents")

    def postings(self) -> DataFrame:
        return self._live("postings")

    def titles(self) -> DataFrame:
        return self._live("titles")

    def lengths(self) -> DataFrame:
        return self._live("lengths")

    def stats(self) -> DataFrame:
        """One row as corpus_stats gives it, from the sums in the log."""
        n = sum(s["docs"] - s["dead_docs"] for s in self.state["segments"])
        tokens = sum(s["tokens"] - s["dead_tokens"] for s in self.state["segments"])
        return self.spark.range(1).select(F.lit(n).cast("long").alias("total_docs"), F.lit(tokens / n if n else 0.0).alias("avg_doc_length"))

    def index(self, **more: object):  # noqa: ANN201
        """What the searches of plans.search read."""
        from lodestone.plans.search import Index

        return Index(self.documents(), self.postings(), self.titles(), self.lengths(), self.stats(), ix.doc_freq(self.postings()), **more)

    # ---- writing

    def _write(self, folder: str, tables: dict[str, DataFrame], *, merged: bool = False) -> None:
        """Postings come in runs in order of term, but for merged ones."""
        for kind, df in tables.items():
            if kind in ("postings", "titles"):
                df = ix.in_runs(df) if merged else df
            df.write.parquet(f"{self.root}/{folder}/{kind}")

    def add(self, docs: DataFrame, *, batch_id: str = "") -> bool:
        """Adds docs (doc_id, text), which replace documents of the same ids; False if the batch was added before.

        Of rows of a batch that share a doc_id the greatest text holds; rows without one are left out.
        """
        if batch_id and batch_id in (self.log.state() or {"batches": []})["batches"]:
            return False
        folder = f"segments/{uuid.uuid4().hex}"
        once = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
        if not ix.unique_ids(once):
            once = once.groupBy("doc_id").agg(F.max("text").alias("text"))
        fresh = stored(once, f"{self.root}/{folder}/documents")
        self._write(folder, {"postings": ix.runs_of(ix.with_tokens(fresh)), "titles": ix.runs_of(ix.title_tokens(fresh))})
        # words are counted already, and a document's are all in one task
        posted = self.spark.read.schema(KINDS["postings"]).parquet(f"{self.root}/{folder}/postings")
        self._write(folder, {"lengths": posted.groupBy("doc_id").agg(F.sum("tf").alias("dl"))})
        sums = self.spark.read.parquet(f"{self.root}/{folder}/lengths").agg(F.count(F.lit(1)), F.coalesce(F.sum("dl"), F.lit(0))).first()
        entry = {"folder": folder, "level": 0, "has": ["postings", "titles", "lengths", "documents"], "docs": sums[0], "tokens": sums[1]}
        return self._commit(entry, fresh.select("doc_id"), batch_id)

    def delete(self, ids: DataFrame, *, batch_id: str = "") -> bool:
        """Deletes documents; unknown ids change nothing."""
        entry = {"folder": f"segments/{uuid.uuid4().hex}", "level": 0, "has": [], "docs": 0, "tokens": 0}
        return self._commit(entry, ids.select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), batch_id)

    def _commit(self, entry: dict, ids: DataFrame, batch_id: str) -> bool:
        """Appends a segment with tombstones for those ids that live in older ones; again if others have committed meanwhile."""
        while True:
            base = SegmentedIndex(self.spark, self.root)
            tombstones = f"tombstones-{uuid.uuid4().hex}"
            replaced = stored(ids.join(base.documents().select("doc_id"), "doc_id", "left_semi"), f"{self.root}/{entry['folder']}/{tombstones}")
            dead = base.lengths().join(replaced, "doc_id", "left_semi").agg(F.count(F.lit(1)), F.coalesce(F.sum("dl"), F.lit(0))).first()
            some = not replaced.isEmpty()

            def change(state: dict, base=base, tombstones=tombstones, dead=dead, some=some) -> dict:  # noqa: ANN001
                if batch_id and batch_id in state["batches"]:
                    raise Taken(batch_id)
                if state["version"] != base.state["version"]:
                    raise Moved
                made = {**entry, "seq": state.get("next", 1), "has": [*entry["has"], *(["tombstones"] if some else [])], "dead_docs": dead[0], "dead_tokens": dead[1]}
                if some:
                    made["tombstones"] = tombstones
                return {"tables": {}, "batches": [*state["batches"], *([batch_id] if batch_id else [])], "segments": [*state.get("segments", []), made], "next": made["seq"] + 1}

            try:
                self.log.commit(change)
            except Moved:
                continue
            except Taken:
                removed(self.spark, f"{self.root}/{entry['folder']}")
                return False
            self.state = self.log.state()
            return True

    # ---- merging

    def plan(self, fanout: int = FANOUT) -> list[dict]:
        """The oldest `fanout` segments of the lowest level that has so many; none if no level has."""
        for level in sorted({s["level"] for s in self.state["segments"]}):
            own = [s for s in self.state["segments"] if s["level"] == level]
            if len(own) >= fanout:
                return own[:fanout]
        return []

    def compact(self, fanout: int = FANOUT) -> int:
        """Merges as long as a level is full; how many merges there were. Segments added meanwhile stay as they are.

        Folders of merged segments stay for readers of older states, until vacuum().
        """
        merges = 0
        while True:
            self.state = self.log.state() or self.state
            chosen = self.plan(fanout)
            if not chosen:
                return merges
            folder = f"segments/{uuid.uuid4().hex}"
            first = chosen[0]["seq"] == min(s["seq"] for s in self.state["segments"])
            self._write(folder, {k: self._live(k, chosen) for k in ("postings", "titles", "lengths", "documents")}, merged=True)
            has = ["postings", "titles", "lengths", "documents"]
            made = {"folder": folder, "level": chosen[0]["level"] + 1, "seq": chosen[-1]["seq"], **{k: sum(s[k] for s in chosen) for k in ("docs", "tokens", "dead_docs", "dead_tokens")}}
            if not first and any("tombstones" in s["has"] for s in chosen):
                made["tombstones"] = "tombstones"
                has.append("tombstones")
                self._union("tombstones", chosen).select("doc_id").distinct().write.parquet(f"{self.root}/{folder}/tombstones")
            gone = {s["folder"] for s in chosen}

            def change(state: dict, made=made, has=has, gone=gone) -> dict:  # noqa: ANN001
                if not gone <= {s["folder"] for s in state["segments"]}:
                    raise Taken("another has merged these segments")
                left = [s for s in state["segments"] if s["folder"] not in gone]
                return {**state, "segments": sorted([*left, {**made, "has": has}], key=lambda s: s["seq"])}

            try:
                self.log.commit(change)
                merges += 1
            except Taken:
                removed(self.spark, f"{self.root}/{folder}")

    def vacuum(self, *, keep: int, older_than: float, now: float) -> list[str]:
        """Removes folders that none of the last `keep` commits names."""
        return self.log.vacuum("segments", keep=keep, older_than=older_than, now=now)


class Moved(Exception):
    """Another commit came between reading a state and changing it."""


def ingest_segments(spark: SparkSession, source: str, root: str, checkpoint: str, schema: str = "doc_id long, text string") -> StreamingQuery:
    """Adds what is new in a folder of Parquet files as segments and merges full levels; a batch that is run again is added once."""

    def write(batch: DataFrame, batch_id: int) -> None:
        index = SegmentedIndex(spark, root)
        index.add(batch, batch_id=f"{checkpoint}#{batch_id}")
        index.compact()

    return spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
