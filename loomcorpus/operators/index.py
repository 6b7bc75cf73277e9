"""The chunk index: a Parquet table keyed by chunk_id, in hash buckets that split as they fill.

A bucket holds the ids whose hash begins with its bits.  The directory of buckets is part of the table's snapshot
(see sources.snapshots): an upsert reads the buckets that it touches, writes them anew beside the others, each in a
file of its own, and puts the new directory in place.  A bucket of more than `most_rows` is split, alone, into as
many bits more as it needs.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from math import ceil, log2

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loomcorpus.sources import snapshots

META = ["chunk_id", "source_type", "source_name", "section_path", "original_path", "chunk_index", "total_chunks_in_section", "token_count"]


def missing(new: DataFrame, index: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Rows whose key the index doesn't hold; only the key column of the index is read."""
    return new.join(index.select(key), key, "left_anti")


def changed(new: DataFrame, index: DataFrame) -> DataFrame:
    """Rows that are new or whose text differs: the id alone ignores the text."""
    return new.withColumn("content_hash", F.md5("text")).join(index.select("chunk_id", "content_hash"), ["chunk_id", "content_hash"], "left_anti")


def latest(rows: DataFrame, key: str = "chunk_id") -> DataFrame:
    """One row for each key: of repeated keys the last in the order of the frame."""
    w = Window.partitionBy(key).orderBy(F.desc("__at"))
    return rows.withColumn("__at", F.monotonically_increasing_id()).withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__at", "__n")


def upserted(index: DataFrame, new: DataFrame, key: str = "chunk_id") -> DataFrame:
    """The index with the new rows in place of those with their keys; of keys that new repeats the last row counts."""
    return index.join(new.select(key), key, "left_anti").unionByName(latest(new, key))


def pruned(index: DataFrame, current: DataFrame, key: str = "chunk_id") -> DataFrame:
    """The index without rows that the corpus no longer has."""
    return index.join(current.select(key), key, "left_semi")


Leaf = tuple[int, int]  # bits and their value


def _name(leaf: Leaf) -> str:
    return f"b{leaf[1]:0{leaf[0]}b}" if leaf[0] else "b"


def _leaf(name: str) -> Leaf:
    return len(name) - 1, int(name[1:] or "0", 2)


def _first_bits(depth: int, key: str) -> Column:
    return F.shiftrightunsigned(F.xxhash64(key), 64 - depth) if depth else F.lit(0).cast("long")


def _located(rows: DataFrame, leaves: Iterable[Leaf], key: str = "chunk_id") -> DataFrame:
    """Rows with the number, among the sorted leaves, of the bucket that they fall into."""
    own = sorted(leaves)
    numbered = rows.sparkSession.createDataFrame([(d, v, i) for i, (d, v) in enumerate(own)], "__depth int, __value long, __bucket int")
    depths = F.explode(F.array(*(F.struct(F.lit(d).alias("d"), _first_bits(d, key).alias("v")) for d in sorted({d for d, _ in own}))))
    tried = rows.withColumn("__t", depths).withColumns({"__depth": F.col("__t.d"), "__value": F.col("__t.v")}).drop("__t")
    return tried.join(numbered, ["__depth", "__value"]).drop("__depth", "__value")


def _split(keys: DataFrame, leaves: set[Leaf], most_rows: int) -> set[Leaf]:
    """The leaves, each cut by as many bits more as it takes for no bucket of the keys (distinct) to pass most_rows."""
    out, open_leaves = set(), set(leaves)
    while open_leaves:
        own = sorted(open_leaves)
        counts = {own[r["__bucket"]]: r["n"] for r in _located(keys, own).groupBy("__bucket").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each touched bucket
        full = {leaf: max(1, ceil(log2(n / most_rows))) for leaf, n in counts.items() if n > most_rows and leaf[0] < 64}
        out |= open_leaves - full.keys()
        open_leaves = {(d + more, v << more | k) for (d, v), more in full.items() for k in range(1 << more)}
    return out


def directory(snapshot: snapshots.Snapshot) -> dict[str, str | None]:
    """The data path of each bucket; None for one without rows."""
    return snapshot.notes.get("buckets", {})


def read(spark: SparkSession, path: str, buckets: Iterable[str] | None = None) -> DataFrame:
    """The index as its newest snapshot has it; or some of its buckets."""
    here = snapshots.newest(spark, path)
    return _rows(spark, path, here, directory(here) if buckets is None else buckets)


def _rows(spark: SparkSession, path: str, here: snapshots.Snapshot, buckets: Iterable[str]) -> DataFrame:
    kind = StructType.fromJson(json.loads(here.notes["schema"]))
    places = [f"{path}/{p}" for b in buckets if (p := directory(here)[b])]
    return spark.read.schema(kind).parquet(*places) if places else spark.createDataFrame([], kind)


def upsert(spark: SparkSession, new: DataFrame, path: str, most_rows: int = 50_000, gone: DataFrame | None = None, moved: DataFrame | None = None, batch: tuple[str, int] | None = None) -> bool:
    """Create the table if there is none, else upsert by chunk_id; of ids that new repeats the last row counts.

    gone: ids (chunk_id) to delete unless new has them.  moved: rows (chunk_id, new_id) whose id changes.  All of it is one
    snapshot, and a writer that meets another's gets Conflict.  batch: a stream's name and the number of its batch; one that
    the table has already is passed over (False).
    New rows are written first, so what made them is asked once.  Only buckets that ids fall into are read; each is
    written by a task of its own.
    """
    base = snapshots.newest(spark, path)
    applied = base.notes.get("applied", {})
    if batch and applied.get(batch[0], -1) >= batch[1]:
        return False
    stage, final = snapshots.new_folder(), snapshots.new_folder()
    none = spark.createDataFrame([], "chunk_id string")
    gone = none if gone is None else gone.select("chunk_id")
    moved = spark.createDataFrame([], "chunk_id string, new_id string") if moved is None else moved.select("chunk_id", "new_id")
    try:
        for name, rows in (("new", latest(new)), ("gone", gone.distinct()), ("moved", moved.dropDuplicates(["new_id"]))):
            rows.write.parquet(f"{path}/{stage}/{name}")
        fresh, gone, moved = (spark.read.parquet(f"{path}/{stage}/{name}") for name in ("new", "gone", "moved"))
        leaves = {_leaf(b) for b in directory(base)} or {(0, 0)}
        asked = fresh.select("chunk_id").union(gone).union(moved.select("chunk_id")).union(moved.select("new_id"))
        own = sorted(leaves)
        touched = {own[r["__bucket"]] for r in _located(asked, own).select("__bucket").distinct().collect()}  # buckets at most
        result = fresh
        if directory(base):
            old = _rows(spark, path, base, [_name(x) for x in touched])
            away = old.join(moved, "chunk_id").withColumn("chunk_id", F.col("new_id")).drop("new_id")
            result = old.join(asked.distinct(), "chunk_id", "left_anti").unionByName(away.join(fresh.select("chunk_id"), "chunk_id", "left_anti")).unionByName(fresh, allowMissingColumns=True)
        result.select("chunk_id").write.parquet(f"{path}/{stage}/ids")
        after = sorted(_split(spark.read.parquet(f"{path}/{stage}/ids"), touched, most_rows))
        kind = result.schema
        if after:
            _located(result, after).repartitionById(len(after), F.col("__bucket")).withColumnRenamed("__bucket", "bucket").write.partitionBy("bucket").parquet(f"{path}/{final}")
        written = set(snapshots.folders(spark, f"{path}/{final}"))
        mine = {_name(x): f"{final}/bucket={i}" if f"bucket={i}" in written else None for i, x in enumerate(after)}
        buckets = {b: p for b, p in directory(base).items() if _leaf(b) not in touched} | mine
        notes = {"schema": json.dumps(kind.jsonValue()), "buckets": buckets, "applied": applied | ({batch[0]: batch[1]} if batch else {})}
        snapshots.commit(spark, path, base, {p: {} for p in buckets.values() if p}, notes)
        return True
    except BaseException:
        snapshots.remove(spark, path, final)
        raise
    finally:
        snapshots.remove(spark, path, stage)


def metadata(index: DataFrame) -> DataFrame:
    return index.select(*(c for c in META if c in index.columns))


def remaining(questions: DataFrame, results: DataFrame, retry_errors: bool = False) -> DataFrame:
    """Questions without a result; a result with an error counts as done unless retry_errors."""
    done = results.filter("error IS NULL") if retry_errors else results
    return questions.join(done.select("id"), "id", "left_anti")
