"""Approximate nearest neighbours by collision-counting hashing.

Every vector is projected on `lines` random lines.  Each projection of a block of vectors is a sorted
array; a query opens a window around its own projection in every array and widens all of them, again and
again (virtual rehashing: no other tables are built).  A round counts only the places that its windows newly
cover.  Vectors inside at least `threshold` of the windows are verified by their true distance.  A query is
done with a block when its windows are so wide that a vector as near as its k-th best, in this block or the
ones before, would have been counted often enough, by `margin` standard deviations.

Every row is indexed, in blocks of a bounded size, and so are the queries; both are written tables.  Blocks
are dealt into shares of a few each, every share meets every block of queries of its vector length, and a
task keeps k results for each query of the block at hand.  The plan has one size whatever the input.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components take no part; a query
meets the vectors of its own length only; a candidate with the query's own id is the query; ties go to the
smaller id; fewer than k candidates give all; equal rows are candidates each; no queries give no rows; other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import erf, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomcorpus.llm.common import written


@dataclass(frozen=True)
class Params:
    k: int = 10
    lines: int = 128
    threshold: float = 0.85  # share of the windows
    start: float = 0.5  # half of the first window, in standard deviations of a block's projections
    widen: float = 1.5
    margin: float = 1.5
    block_rows: int = 4096
    block_bytes: int = 4 << 20  # of vectors: long ones make blocks of fewer rows
    share_blocks: int = 32  # blocks of rows that a share has at most, on average
    seed: int = 11

    def rows_of(self, dim: int) -> int:
        return max(1, min(self.block_rows, self.block_bytes // (8 * dim)))

    def reach(self) -> float:
        """Half of a window, in distances, at which a vector lies in `threshold` of the windows with near certainty."""
        low, high = 0.0, 20.0
        for _ in range(60):
            mid = (low + high) / 2
            share = erf(mid / sqrt(2))
            fine = share - self.margin * sqrt(share * (1 - share) / self.lines) >= self.threshold
            low, high = (low, mid) if fine else (mid, high)
        return high


def projections(dim: int, p: Params) -> np.ndarray:
    return np.random.default_rng(p.seed).standard_normal((dim, p.lines))


class Block:
    """The sorted projections of one block of vectors, line after line in one array: the values, and whose they are.

    Values are moved up by `width` from line to line, so that one search finds places on all lines.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, lines: np.ndarray) -> None:
        self.ids, self.vectors = ids, vectors
        values = np.ascontiguousarray((vectors @ lines).T)
        order = np.argsort(values, axis=1, kind="stable")
        self.spread = float(values.std()) or 1.0
        self.low, self.high = float(values.min()), float(values.max())
        self.width = self.high - self.low + 1.0
        self.shift = np.arange(len(values)) * self.width - self.low
        self.values = (np.take_along_axis(values, order, axis=1) + self.shift[:, None]).ravel()
        self.order = order.ravel()

    def places(self, at: np.ndarray, side: str) -> np.ndarray:
        """Of each line, the place of a value in the whole array."""
        return np.searchsorted(self.values, np.clip(at, self.low - 0.25, self.high + 0.25) + self.shift, side=side)

    def search(self, query_id: int, query: np.ndarray, at: np.ndarray, best: tuple[np.ndarray, np.ndarray], p: Params, reach: float) -> tuple[tuple[np.ndarray, np.ndarray], int]:
        """The k nearest (distances, ids) of those known and those found here; and how many vectors were verified."""
        n, least, verified = len(self.ids), p.threshold * p.lines, 0
        counts, open_ = np.zeros(n, dtype=np.int64), self.ids != query_id
        low = high = self.places(at, "left")
        half = reach * best[0][-1] if len(best[0]) == p.k else p.start * self.spread
        while True:
            a, d = self.places(at - half, "left"), self.places(at + half, "right")
            new = [self.order[x:y] for x, y in zip(np.append(a, high).tolist(), np.append(low, d).tolist(), strict=True) if x < y]
            low, high = a, d
            if new:
                counts += np.bincount(np.concatenate(new), minlength=n)
                found = np.flatnonzero((counts >= least) & open_)
                if len(found):
                    open_[found] = False
                    verified += len(found)
                    d = np.sqrt(((self.vectors[found] - query) ** 2).sum(axis=1))
                    best = nearest(np.append(best[0], d), np.append(best[1], self.ids[found]), p.k)
            full = len(best[0]) == p.k
            if (full and half >= reach * best[0][-1]) or not open_.any():
                return best, verified
            half = min(half * p.widen, reach * best[0][-1]) if full else half * p.widen


def nearest(d: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    keep = np.lexsort((ids, d))[:k]
    return d[keep], ids[keep]


def sound(id_col: str, vec_col: str):
    """Whether a row takes part."""
    x = F.col(vec_col)
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return F.col(id_col).isNotNull() & x.isNotNull() & fine & F.exists(x, lambda v: v != 0)


BLOCKS = "dim int, ids binary, vectors binary"


def blocks(rows: DataFrame, p: Params) -> DataFrame:
    """Of rows (id, v): blocks of vectors of one length, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def packed(dim: int) -> pa.RecordBatch:
            parts = held.pop(dim)
            ids, vectors = (np.concatenate([x[j] for x in parts]) for j in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([ids.tobytes()], pa.binary()), pa.array([vectors.tobytes()], pa.binary())], names=["dim", "ids", "vectors"])

        for batch in batches:
            ids, lists = batch.column(0).to_numpy(), batch.column(1)
            sizes, flat, starts = lists.value_lengths().to_numpy(), lists.flatten().to_numpy(), np.zeros(1, dtype=np.int64)
            starts = np.append(starts, np.cumsum(sizes))
            for dim in np.unique(sizes).tolist():
                own, most = np.flatnonzero(sizes == dim), p.rows_of(dim)
                vectors = flat[(starts[own][:, None] + np.arange(dim)).ravel()].reshape(-1, dim)
                at = 0
                while at < len(own):
                    room = most - sum(len(x) for x, _ in held.get(dim, []))
                    held.setdefault(dim, []).append((ids[own[at : at + room]], vectors[at : at + room].copy()))
                    at += room
                    if at <= len(own):
                        yield packed(dim)
        for dim in list(held):
            yield packed(dim)

    return rows.mapInArrow(run, BLOCKS)


def search(rows: DataFrame, queries: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", params: Params = Params()) -> DataFrame:
    """(query_id, rank, vec_id, score): the nearest rows found for each query, by Euclidean distance."""
    p, spark = params, rows.sparkSession
    cols = F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")
    base = written(blocks(rows.filter(sound(id_col, vec_col)).select(*cols), p), "row_blocks")
    asked = written(blocks(queries.filter(sound(id_col, vec_col)).select(*cols), p), "query_blocks")
    n = base.count()
    shares = max(1, min(n, max(-(-n // p.share_blocks), 4 * spark.sparkContext.defaultParallelism)))
    dealt = base.withColumn("share", F.pmod(F.xxhash64("ids"), F.lit(shares)))
    every = asked.select("dim", F.col("ids").alias("query_ids"), F.col("vectors").alias("queries"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shares - 1).cast("long"))).alias("share"))
    # The left side streams: a task meets all blocks of its share with one block of queries, then with the next.
    met = every.repartition(shares, "share", "dim").join(dealt.repartition(shares, "share", "dim").hint("merge"), ["share", "dim"])
    found = met.select("dim", "query_ids", "queries", "ids", "vectors").mapInArrow(_searcher(p), "query_id long, score double, vec_id long, verified long")
    w = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= p.k).select("query_id", "rank", "vec_id", "score")


def _searcher(p: Params):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reach, group, best, known, verified = p.reach(), None, [], np.empty(0, dtype=np.int64), 0

        def results() -> Iterator[pa.RecordBatch]:
            for a in range(0, len(best), 1024):
                some = best[a : a + 1024]
                size = [len(d) for d, _ in some]
                if sum(size):
                    cols = np.repeat(known[a : a + 1024], size), np.concatenate([d for d, _ in some]), np.concatenate([i for _, i in some])
                    yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in cols), pa.array([verified] * sum(size), pa.int64())], names=["query_id", "score", "vec_id", "verified"])

        for batch in batches:
            for dim, query_ids, queries, ids, vectors in zip(*batch.columns, strict=True):
                if (mine := (dim.as_py(), query_ids.as_buffer().to_pybytes())) != group:
                    yield from results()
                    group, known, verified = mine, np.frombuffer(mine[1], dtype="<i8"), 0
                    x = np.frombuffer(queries.as_buffer(), dtype="<f8").reshape(-1, mine[0]).copy()
                    lines = projections(mine[0], p)
                    at, best = x @ lines, [(np.empty(0), np.empty(0, dtype=np.int64)) for _ in known]
                block = Block(np.frombuffer(ids.as_buffer(), dtype="<i8"), np.frombuffer(vectors.as_buffer(), dtype="<f8").reshape(-1, mine[0]), lines)
                for i, q in enumerate(known.tolist()):
                    best[i], checked = block.search(q, x[i], at[i], best[i], p, reach)
                    verified += checked
        yield from results()

    return run


def op4_collision_search(rows: DataFrame) -> DataFrame:
    """Queries are the rows whose vec_id is divisible by 100, against all rows."""
    return search(rows, rows.filter("vec_id % 100 = 0"))
