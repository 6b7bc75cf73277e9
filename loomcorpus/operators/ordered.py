"""Running sums and greedy batches in an order within keys, where one key may hold most rows.

Rows are dealt into ranges of (keys, order) and written; a range's part of a key is worked on by itself, and what the
parts before it come to is added from one small row for each range and key.  Keys of a usual size take the plain way, a
window or fold for each key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import IntegerType, StructField, StructType

from loomcorpus.sources.shared import stored


def crowded(rows: DataFrame, keys: list[str], times: float = 2.0) -> bool:
    """Whether a key has more rows than `times` an even share of the session's shuffle partitions."""
    n = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("most"), F.sum("n").alias("all")).first()
    return (n["most"] or 0) > times * (n["all"] or 0) / int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def ranged(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows with __part, the number of the range of (keys, order) that they fall into; a written table."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stored(rows.repartitionByRange(n, *keys, *order).withColumn("__part", F.spark_partition_id()), "ranges")


def _same(keys: list[str]) -> Column:
    """An equality of left and right keys under which nulls are one key."""
    return F.expr(" AND ".join(f"l.`{k}` <=> r.`{k}`" for k in keys))


def running(rows: DataFrame, keys: list[str], order: list[str], **sums: Column) -> DataFrame:
    """Rows with sums over the rows of their keys up to and with themselves; of rows equal in order any may be first."""
    if not crowded(rows, keys):
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return rows.withColumns({n: F.sum(c).over(w) for n, c in sums.items()})
    own = ["__part", *keys]
    cut = ranged(rows.withColumns({f"__{n}": c for n, c in sums.items()}), keys, order)
    parts = cut.groupBy(*own).agg(*(F.sum(f"__{n}").alias(f"__{n}") for n in sums))  # a row for each range and key in it
    earlier = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = parts.select(*own, *(F.coalesce(F.sum(f"__{n}").over(earlier), F.lit(0)).alias(f"__before_{n}") for n in sums))
    w = Window.partitionBy(*own).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    within = cut.withColumns({f"__{n}": F.sum(f"__{n}").over(w) for n in sums})
    out = within.alias("l").join(before.alias("r"), _same(own), "left")
    return out.select(*(F.col(f"l.`{c}`") for c in rows.columns), *((F.col(f"l.__{n}") + F.col(f"r.__before_{n}")).alias(n) for n in sums))


def _starts(n: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a part's tokens: sums up to each row, the next batch's first row after one that starts at each row (or the end), and from there the number of batches that start and what is open at the end."""
    upto = np.cumsum(n)
    before = upto - n
    size = len(n)
    some = np.append(np.flatnonzero(n > 0), size)
    first = some[np.searchsorted(some, np.arange(size))]  # an open batch without tokens takes any row
    after = np.minimum(np.maximum(np.searchsorted(upto, most + before, side="right"), first + 1), size)
    started, left = np.zeros(size + 1, np.int64), np.zeros(size + 1, np.int64)
    for i in range(size - 1, -1, -1):
        j = after[i]
        started[i] = 1 + (started[j] if j < size else 0)
        left[i] = left[j] if j < size else upto[-1] - before[i]
    return upto, after, started, left


def _parts(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[tuple, np.ndarray]]:
    """Tokens, the last column, of each run of rows that are equal in the first `width` columns."""
    here, held = None, []
    for batch in batches:
        names = list(zip(*(batch.column(i).to_pylist() for i in range(width)), strict=True))
        tokens = batch.column(width).fill_null(0).to_numpy()
        at = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1]), len(names)]
        for a, b in zip(at, at[1:], strict=False):
            if a < b:
                if names[a] != here and held:
                    yield here, np.concatenate(held)
                    held = []
                here = names[a]
                held.append(tokens[a:b])
    if held:
        yield here, np.concatenate(held)


def batches_of(rows: DataFrame, key: str, order: str, tokens: str, most: int) -> DataFrame:
    """Rows with batch: greedy batches of at most `most` tokens, in order within each key; ranges of a crowded key are batched side by side.

    What a range does to the batch that is open before it depends on how much is in that batch, and only through the row at
    which it is full: one of the range's first rows of `most` tokens.  So a range is summed up by these, the ranges of a key are
    chained over their summaries, and then each range is batched from the state that the chain found for it.
    """
    cut = ranged(rows, [key], [order])
    name, kind = rows.schema[key].dataType.simpleString(), StructType([*rows.schema.fields, StructField("batch", IntegerType())])

    batch_kind = to_arrow_type(rows.schema[key].dataType)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (part, k), n in _parts(batches, 2):
            upto, after, started, left = _starts(n, most)
            size = len(n)
            heads = int(np.searchsorted(upto, most, side="right"))  # rows that an open batch can take
            last = min(heads + 1, size)
            fresh = after[0]
            zero = (0, int(upto[-1])) if fresh == size else (int(started[fresh]), int(left[fresh]))
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "key": pa.array([k], batch_kind), **{c: pa.array([v.tolist()], pa.list_(pa.int64())) for c, v in (("upto", upto[:last]), ("started", started[:last]), ("open", left[:last]))}, "total": [int(upto[-1])], "zero_started": [zero[0]], "zero_open": [zero[1]]})

    sorted_cut = cut.select("__part", F.col(key).alias("key"), F.col(tokens).cast("long").alias("n"), F.col(order).alias("o")).repartition("__part", "key").sortWithinPartitions("__part", "key", "o")
    parts = sorted_cut.select("__part", "key", "n").mapInArrow(summed, f"part int, key {name}, upto array<long>, started array<long>, open array<long>, total long, zero_started long, zero_open long")

    def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, number, held = object(), 0, 0
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["key"] != here:
                    here, number, held = r["key"], 0, 0
                out.append((r["part"], r["key"], number, held))
                if not held:
                    number, held = number + r["zero_started"], r["zero_open"]
                else:
                    at = int(np.searchsorted(r["upto"], most - held, side="right"))
                    if at < len(r["upto"]):
                        number, held = number + r["started"][at], r["open"][at]
                    else:
                        held += r["total"]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int32(), batch_kind, pa.int64(), pa.int64()))], names=["part", "key", "number", "held"])

    states = parts.repartition("key").sortWithinPartitions("key", "part").mapInArrow(chained, f"part int, key {name}, number long, held long")  # a row for each range and key in it
    met = cut.alias("l").join(states.alias("r"), F.expr(f"l.__part = r.part AND l.`{key}` <=> r.key"))
    met = met.select(*(F.col(f"l.`{c}`") for c in rows.columns), "l.__part", "r.number", "r.held").repartition("__part", key).sortWithinPartitions("__part", key, order)
    width = len(rows.columns)
    at = [rows.columns.index(c) for c in (key, tokens)]

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, number, total = None, 0, 0
        for batch in batches:
            out = []
            for part, k, n, base, held in zip(batch.column(width).to_pylist(), batch.column(at[0]).to_pylist(), batch.column(at[1]).to_pylist(), batch.column(width + 1).to_pylist(), batch.column(width + 2).to_pylist(), strict=True):
                if (part, k) != here:
                    here, number, total = (part, k), base, held
                if total and total + (n or 0) > most:
                    number, total = number + 1, 0
                total += n or 0
                out.append(number)
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array(out, pa.int32())], names=kind.names)

    return met.mapInArrow(numbered, kind)
