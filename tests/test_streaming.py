"""Sections delivered in parts, anew, late and out of order, against one batch of what they amount to."""

import random
import shutil

import pytest

from loomcorpus.operators import index
from loomcorpus.operators.chunk import chunk_documents
from loomcorpus.sources import snapshots
from loomcorpus.streaming.ingest import SECTION, STREAMED, ingest_stream


class Stream:
    def __init__(self, spark, at):
        self.spark, self.at, self.n = spark, at, 0

    def deliver(self, rows, run=True):
        self.spark.createDataFrame(rows, STREAMED).coalesce(1).write.parquet(str(self.at / f"in/{self.n}"))
        self.n += 1
        if run:
            self.run()

    def run(self):
        ingest_stream(self.spark, str(self.at / "in/*"), str(self.at / "index"), str(self.at / "ck"), most=6, overlap=0, most_rows=40).awaitTermination()

    def held(self):
        return {r["chunk_id"]: (r["text"], r["total_chunks_in_section"]) for r in index.read(self.spark, str(self.at / "index")).collect()}


def row(order, text, heading="h", path="p", delivery=None, source="n"):
    return (order, text, "docs", source, path, [heading], delivery)


def batch(spark, rows):
    """The chunks of the sections if they came at once."""
    return {r["chunk_id"]: (r["text"], r["total_chunks_in_section"]) for r in chunk_documents(spark.createDataFrame([r[:6] for r in rows], SECTION), 6, 0).collect()}


def test_two_deliveries_give_the_ids_of_one_batch(spark, tmp_path):
    s = Stream(spark, tmp_path)
    s.deliver([row(1, "first text")])
    s.deliver([row(2, "second text"), row(9, "other", path="q")])
    want = [row(1, "first text"), row(2, "second text"), row(9, "other", path="q")]
    assert s.held() == batch(spark, want) and len(s.held()) == 3
    s.deliver([row(0, "a section before them. Of two chunks. " * 3)])  # the others move on
    want.append(row(0, "a section before them. Of two chunks. " * 3))
    assert s.held() == batch(spark, want)


def test_shortened_moved_and_dropped_sections_leave_no_chunk(spark, tmp_path):
    s = Stream(spark, tmp_path)
    long = "One two three four. " * 4
    s.deliver([row(1, long, delivery=1), row(2, long, "g", delivery=1), row(3, "end", delivery=1)])
    assert len(s.held()) == 9
    s.deliver([row(1, "short")])
    assert s.held() == batch(spark, [row(1, "short"), row(2, long, "g"), row(3, "end")])
    s.deliver([row(2, "now here", "h")])
    assert s.held() == batch(spark, [row(1, "short"), row(2, "now here"), row(3, "end")])
    s.deliver([row(3, "end of the second", delivery=2)])
    assert s.held() == batch(spark, [row(3, "end of the second")])
    s.deliver([row(1, "late", delivery=1)])
    assert s.held() == batch(spark, [row(3, "end of the second")])


def test_restart_changes_nothing(spark, tmp_path):
    s = Stream(spark, tmp_path)
    s.deliver([row(1, "first"), row(2, "second")])
    before, number = s.held(), snapshots.newest(spark, str(tmp_path / "index")).number
    s.run()
    assert s.held() == before
    for p in (tmp_path / "ck/commits").iterdir():  # as if the driver had died before it noted the last batch
        p.unlink()
    s.run()
    assert s.held() == before and snapshots.newest(spark, str(tmp_path / "index")).number == number
    s.deliver([row(0, "zero")])
    assert s.held() == batch(spark, [row(0, "zero"), row(1, "first"), row(2, "second")])


def test_failed_batch_is_made_good(spark, tmp_path, monkeypatch):
    s = Stream(spark, tmp_path)
    s.deliver([row(1, "first")])
    with monkeypatch.context() as m:
        m.setattr(snapshots, "commit", lambda *a: 1 / 0)
        with pytest.raises(Exception):  # noqa: B017
            s.deliver([row(0, "zero"), row(2, "second")])
    assert s.held() == batch(spark, [row(1, "first")])
    s.run()
    assert s.held() == batch(spark, [row(0, "zero"), row(1, "first"), row(2, "second")])


def test_random_deliveries(spark, tmp_path):
    rng = random.Random(4)
    s, now = Stream(spark, tmp_path), {}
    for step in range(3):
        rows = {}
        for _ in range(8):
            path, order = rng.choice("pqr"), rng.randrange(6)
            rows[path, order] = row(order, " ".join(f"w{rng.randrange(99)}." for _ in range(rng.randrange(1, 15))), rng.choice("gh"), path)
        now |= rows
        s.deliver(list(rows.values()))
        assert s.held() == batch(spark, list(now.values())), step
    shutil.rmtree(tmp_path / "in")
