"""Incremental ingestion: a folder of section files as a stream, whose changes go into the index batch by batch.

State is kept for each file: where its sections stand, by order number, and how many chunks each has.  So the sections
of a file may come in several deliveries, in any order, and have the ids that one delivery would give them: those that a
new one moves on are renamed in the index, and chunks that a section no longer has are deleted.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from loomcorpus.functions.text import token_count
from loomcorpus.operators.chunk import chunk_id, chunk_rows, cut_sections
from loomcorpus.operators.index import upsert
from loomcorpus.providers import HashEmbedder, embedded
from loomcorpus.sources import snapshots

#: delivery: a number that grows when a file is delivered anew, as a whole; null where sections are only added or changed.
SECTION = "doc_ord long, text string, source_type string, source_name string, original_path string, section_hierarchy array<string>"
STREAMED = f"{SECTION}, delivery long"
#: put: a section as it came; place: where a put section stands; move: a section that stands elsewhere now (was); gone: chunks that were.
CHANGE = "kind string, original_path string, section_path string, doc_ord long, seq long, occurrence int, was int, n int, slug string, source_name string, source_type string, chunks array<string>"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Places(StatefulProcessor):
    """The sections of one file: a row for each section that comes, and then what changes by them.

    Texts pass through; only order numbers, headings and numbers of chunks are kept.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.delivery = handle.getValueState("delivery", "number long, seq long")
        self.sections = handle.getMapState("sections", "doc_ord long", "fields string")
        self.headings = handle.getMapState("headings", "section_path string", "orders string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        path = key[0]
        number, seq = self.delivery.get() if self.delivery.exists() else (None, 0)
        came: dict[int, tuple] = {}
        for r in rows:
            if r.delivery is not None and number is not None and r.delivery < number:
                continue  # an older delivery that comes late
            if r.delivery is not None and (number is None or r.delivery > number):
                number, came = r.delivery, {}
            seq += 1
            came[r.doc_ord] = (r.section_path, r.source_name, r.slug, len(r.chunks))
            yield self.change("put", path, r.section_path, doc_ord=r.doc_ord, seq=seq, slug=r.slug, source_name=r.source_name, source_type=r.source_type, chunks=r.chunks)
        if not came:
            return
        had = self.delivery.get()[0] if self.delivery.exists() else None
        self.delivery.update((number, seq))
        dropped = [k[0] for k in self.sections.keys() if k[0] not in came] if number is not None and had is not None and number > had else []
        old = {o: self.section(o) for o in [*came, *dropped]}
        touched = {s[0] or "" for s in [*came.values(), *old.values()] if s}
        before = {h: self.orders(h) for h in touched}
        after = {h: set(o) for h, o in before.items()}
        for o, s in old.items():
            if s:
                after[s[0] or ""].discard(o)
        for o, s in came.items():
            after[s[0] or ""].add(o)
        for h in touched:
            was, now = ({o: i for i, o in enumerate(sorted(x))} for x in (before[h], after[h]))
            for o, i in was.items():
                section = old.get(o) or self.section(o)
                if o in old:
                    yield self.change("gone", path, section[0], doc_ord=o, occurrence=i, n=section[3], slug=section[2], source_name=section[1])
                elif now[o] != i:
                    yield self.change("move", path, section[0], doc_ord=o, occurrence=now[o], was=i, n=section[3], slug=section[2], source_name=section[1])
            for o, s in came.items():
                if (s[0] or "") == h:
                    yield self.change("place", path, s[0], doc_ord=o, occurrence=now[o])
            self.keep(h, after[h])
        for o in dropped:
            self.sections.removeKey((o,))
        for o, s in came.items():
            self.sections.updateValue((o,), (json.dumps(s),))

    def section(self, order: int) -> list | None:
        return json.loads(self.sections.getValue((order,))[0]) if self.sections.containsKey((order,)) else None

    def orders(self, heading: str) -> list[int]:
        return json.loads(self.headings.getValue((heading,))[0]) if self.headings.containsKey((heading,)) else []

    def keep(self, heading: str, orders: set[int]) -> None:
        if orders:
            self.headings.updateValue((heading,), (json.dumps(sorted(orders)),))
        elif self.headings.containsKey((heading,)):
            self.headings.removeKey((heading,))

    @staticmethod
    def change(kind: str, path: str, section: str | None, **more) -> Row:
        fields = dict.fromkeys(c.split()[0] for c in CHANGE.split(", "))
        return Row(**fields | {"kind": kind, "original_path": path, "section_path": section} | more)

    def close(self) -> None:
        pass


def changes(sections: DataFrame, most: int = 1500, overlap: int = 100) -> DataFrame:
    """The changes (CHANGE) that a stream of sections (STREAMED) makes, a key of state for each file."""
    cut = cut_sections(sections.withColumn("original_path", F.coalesce("original_path", F.lit(""))), most, overlap)
    rows = cut.select("original_path", "section_path", "doc_ord", "delivery", "slug", "source_name", "source_type", F.col("chunks.text").alias("chunks"))
    return rows.groupBy("original_path").transformWithState(Places(), CHANGE, "Update", "None")


def _ids(rows: DataFrame, occurrence: str) -> Column:
    return chunk_id(F.col("source_name"), F.col("slug"), F.col("original_path"), F.col("section_path"), F.col(occurrence), F.col("i"))


def applied(changed: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of changes: the new chunks, the ids that go, and the ids that move (chunk_id, new_id)."""
    at = ["original_path", "doc_ord"]
    last = Window.partitionBy(*at).orderBy(F.desc("seq"))
    came = changed.filter("kind = 'put'").withColumn("__n", F.row_number().over(last)).filter("__n = 1").drop("occurrence", "__n")
    came = came.withColumn("chunks", F.transform("chunks", lambda c: F.struct(c.alias("text"), token_count(c).alias("tokens"))))
    new = chunk_rows(came.join(changed.filter("kind = 'place'").select(*at, "occurrence"), at))
    each = changed.filter("n > 0").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    gone = each.filter("kind = 'gone'").select(_ids(each, "occurrence").alias("chunk_id"))
    moved = each.filter("kind = 'move'").select(_ids(each, "was").alias("chunk_id"), _ids(each, "occurrence").alias("new_id"))
    return new, gone, moved


def ingest_stream(spark: SparkSession, folder: str, index: str, checkpoint: str, embedder: Callable = HashEmbedder(), name: str = "sections", most_rows: int = 50_000, **options) -> StreamingQuery:
    """Process what is there and stop; run again, it takes up new files only.

    A batch is one snapshot of the index, which notes the batch's number under `name`: a batch that is run again after a
    crash changes nothing.  The state lives in RocksDB, which is set for this query's session alone.
    """
    session = spark.newSession()
    session.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)

    def batch(df: DataFrame, number: int) -> None:
        stage = f"{index}/{snapshots.new_folder()}"
        try:
            df.write.parquet(stage)
            changed = df.sparkSession.read.schema(CHANGE).parquet(stage)
            new, gone, moved = applied(changed)
            upsert(df.sparkSession, embedded(new, embedder), index, most_rows, gone, moved, (name, number))
        finally:
            snapshots.remove(df.sparkSession, index, stage.rpartition("/")[2])

    rows = session.readStream.schema(STREAMED).parquet(folder)
    return changes(rows, **options).writeStream.foreachBatch(batch).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
