"""Helpers shared by the training-data operators: tables, shared folder, Arrow batches."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of bytes other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = " \t\n\x0b\x0c\r"
#: Rows and bytes of an Arrow batch that are worked on at once: texts can be long.
BATCH_ROWS, BATCH_BYTES = 512, 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named input table of a folder of Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@cache
def _local_dir() -> str:
    return tempfile.mkdtemp(prefix="loomcorpus-")


def shared_dir(spark: SparkSession) -> str:
    """A new path in the folder that driver and executors share: the session's spark.checkpoint.dir.

    Where the session names none, a temporary folder serves a driver that runs all tasks itself; a cluster must name one.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = _local_dir()
    return f"{base.rstrip('/')}/loomcorpus/{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete written tables that nothing will read again: what was made of them must be written itself."""
    for t in tables:
        if path := getattr(t, "written_path", None):
            where = t.sparkSession._jvm.org.apache.hadoop.fs.Path(path).getParent()
            where.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def row_key(id_col: str, text_col: str):
    """Names a row by its id and 64 bits of its text; rows equal in both are one document."""
    return F.struct(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("text"))


#: A join is dealt as if it had this many partitions at least; a session with more gives its own number.
PARTS = 256


def dealt_join(rows: DataFrame, counted: DataFrame, keys: list[str], hot_keys: list[str], by: str, count: str = "copies", how: str = "inner") -> DataFrame:
    """rows joined with counted on keys; counted holds how often each key occurs in rows, and is a written table.

    A key (by hot_keys, some of the keys) with more rows than a partition has on average is dealt by the column `by`
    into as many parts as it would fill, and counted's row is repeated for each part, so that no task gets more of a
    key than its share.  There are fewer such keys than partitions, and fewer than twice as many parts, whatever the input.
    """
    wide = max(PARTS, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    share = (counted.agg(F.sum(count)).first()[0] or 0) / wide
    hot = F.broadcast(counted.groupBy(*hot_keys).agg(F.sum(count).alias("__n")).filter(F.col("__n") > share).select(*hot_keys, F.ceil(F.col("__n") / max(share, 1.0)).cast("int").alias("__parts")))
    part = F.coalesce(F.pmod(F.xxhash64(by), F.col("__parts")), F.lit(0)).cast("int")
    left = rows.join(hot, hot_keys, "left").withColumn("__part", part).drop("__parts")
    right = counted.join(hot, hot_keys, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1))).drop("__parts")
    return left.join(right, [*keys, "__part"], how).drop("__part")


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with at most BATCH_ROWS rows and BATCH_BYTES bytes each; a longer row is a part of its own."""
    n = batch.num_rows
    if n == 1 or n and n <= BATCH_ROWS and batch.nbytes <= BATCH_BYTES:
        yield batch
    elif n:
        yield from slices(batch.slice(0, n // 2))
        yield from slices(batch.slice(n // 2))


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """Apply a function to each Arrow batch, part by part.  The session's batch size is left alone: Spark bounds a batch by bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield fn(part)

    return df.mapInArrow(run, schema)


def encode(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")
