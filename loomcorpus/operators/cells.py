"""Approximate cosine top-k: an inverted file of cells with product-quantised residuals.

Fitting takes a bounded sample of the vectors: its k-means centres are the cells, and codebooks of what is left of a
vector within its cell describe it in a few bytes.  Every row is assigned, whatever the sample had.  The rows lie in
Parquet folders by cell, so a search reads the cells nearest to its queries and no others.  Blocks of rows meet blocks of
queries: in each, the codes choose a query's candidates, whose vectors rank them by their true cosine, and a task keeps the
best k of each query, never a row for a pair.  How many cells and candidates a search takes is measured on the sample, for
the recall that is wanted.

The folders are named by a snapshot (sources.snapshots).  Adding rows assigns them by the same model and reads nothing
of what is there.  Vectors are unit vectors inside; null, empty and zero ones, and those of another length than the
model's, take no part.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from math import isqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import BinaryType, IntegerType, StructField, StructType

from loomcorpus.sources import snapshots


@dataclass(frozen=True)
class Params:
    sample_rows: int = 65_536  # that the model is fitted on, at most, and their bytes:
    sample_bytes: int = 64 << 20
    cells: int | None = None  # by default the root of the number of rows; an eighth of the sample at most
    parts: int = 16  # of a vector, each described by one byte
    rounds: int = 10  # of k-means
    recall: float = 0.98  # of the true neighbours among the sample
    tried: int = 256  # rows of the sample that are searched for, to measure it
    k: int = 10
    asked_rows: int = 2048  # queries of a block
    group_blocks: int = 16  # of queries, that a task has at once
    block_bytes: int = 2 << 20  # of the vectors of a block of rows, and of most arrays that a task makes


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-30)


def _pieces(n: int, width: int, most: int = 4 << 20) -> Iterator[slice]:
    """Runs of n rows, so that an array of them with `width` columns has about `most` numbers."""
    step = max(1, most // max(1, width))
    for a in range(0, n, step):
        yield slice(a, min(n, a + step))


def _means(x: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """k-means; a centre without rows is put on the row that is worst served."""
    c = x[np.unique(np.linspace(0, len(x) - 1, k).astype(int))].copy()
    at, least, own = np.zeros(len(x), np.int64), np.zeros(len(x)), (x * x).sum(axis=1)
    for _ in range(rounds):
        half = (c * c).sum(axis=1) / 2
        for s in _pieces(len(x), len(c), 1 << 18):
            near = x[s] @ c.T
            near -= half
            at[s] = near.argmax(axis=1)
            least[s] = own[s] - 2 * near[np.arange(len(near)), at[s]]
        order = np.argsort(at, kind="stable")
        ends = np.searchsorted(at[order], np.arange(len(c) + 1))
        for i in range(len(c)):
            rows = order[ends[i] : ends[i + 1]]
            c[i] = x[rows].mean(axis=0) if len(rows) else x[least.argmax()]
    return c


@dataclass(frozen=True)
class Model:
    """cells: unit centres; books: for each part its codes' vectors; probes and candidates: what a search takes."""

    cells: np.ndarray
    books: list[np.ndarray]
    probes: int
    candidates: int

    def bounds(self) -> np.ndarray:
        return np.cumsum([0, *(b.shape[1] for b in self.books)])

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cell and the codes of unit vectors."""
        at, codes = np.zeros(len(x), np.int64), np.zeros((len(x), len(self.books)), np.uint8)
        for s in _pieces(len(x), max(len(self.cells), 256)):
            at[s] = (x[s] @ self.cells.T).argmax(axis=1)
            codes[s] = self.codes(x[s] - self.cells[at[s]])
        return at, codes

    def codes(self, rest: np.ndarray) -> np.ndarray:
        to = self.bounds()
        return np.stack([((b * b).sum(axis=1) - 2 * rest[:, a:z] @ b.T).argmin(axis=1) for b, a, z in zip(self.books, to, to[1:], strict=False)], axis=1).astype(np.uint8)

    def near(self, q: np.ndarray) -> np.ndarray:
        """Of each query and cell, whether to look into it: the nearest ones."""
        out = np.full((len(q), len(self.cells)), self.probes >= len(self.cells))
        if not out.all():
            for s in _pieces(len(q), len(self.cells)):
                np.put_along_axis(out[s], np.argsort(-(q[s] @ self.cells.T), axis=1, kind="stable")[:, : self.probes], True, axis=1)
        return out

    def guess(self, q: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """Estimated cosines of queries and rows of a cell."""
        to = self.bounds()
        out = np.repeat((q @ self.cells[cell])[:, None], len(codes), axis=1)
        for j, b in enumerate(self.books):
            out += (q[:, to[j] : to[j + 1]] @ b.T)[:, codes[:, j]]
        return out


def fit(vectors: np.ndarray, rows: int, p: Params = Params()) -> Model:
    """The model of a sample, for so many rows in all."""
    x = _unit(vectors.astype(np.float64))
    cells = _unit(_means(x, max(1, min(p.cells or isqrt(rows), len(x) // 8)), p.rounds))
    at = np.concatenate([(x[s] @ cells.T).argmax(axis=1) for s in _pieces(len(x), len(cells))])
    rest = x - cells[at]
    parts = [s for s in np.array_split(np.arange(x.shape[1]), min(p.parts, x.shape[1])) if len(s)]
    books = [_means(rest[:, s[0] : s[-1] + 1], max(1, min(256, len(x) // 4)), p.rounds) for s in parts]
    model = Model(cells, books, len(cells), len(x))
    at, codes = model.assign(x)
    some = np.linspace(0, len(x) - 1, min(p.tried, len(x))).astype(int)
    order = np.argsort(-(x[some] @ cells.T), axis=1)
    place = np.argsort(order, axis=1)  # of each cell in the order of a query
    rank, below = np.zeros((len(some), min(p.k, len(x))), np.int64), np.zeros((len(some), min(p.k, len(x))), np.int64)
    guessed = np.empty((len(some), len(x)), np.float32)
    for c in range(len(cells)):
        guessed[:, at == c] = model.guess(x[some], c, codes[at == c])
    for s in _pieces(len(some), len(x), 1 << 20):
        best = np.argsort(-(x[some[s]] @ x.T), axis=1, kind="stable")[:, : p.k]
        rank[s] = np.take_along_axis(place[s], at[best], axis=1)
        below[s] = [(g > g[b][:, None]).sum(axis=1) for g, b in zip(guessed[s], best, strict=True)]
    probes = next(n for n in range(1, len(cells) + 1) if (rank < n).mean() >= (1 + p.recall) / 2)
    tries = [n for n in (2**i * p.k for i in range(1, 30)) if n < len(x)] + [len(x)]
    candidates = next(n for n in tries if (below < n).mean() >= (1 + p.recall) / 2)
    return Model(cells, books, probes, candidates)


def _matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of a list column are vectors of this length that have a direction, and these as unit vectors."""
    sizes, flat = column.value_lengths().fill_null(0).to_numpy(), column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.cumsum(sizes) - sizes
    at = np.flatnonzero(sizes == dim)
    v = flat[(starts[at][:, None] + np.arange(dim)).ravel()].reshape(len(at), dim)
    fine = np.isfinite(v).all(axis=1) & (np.abs(v).max(axis=1, initial=0) > 0)
    return at[fine], _unit(v[fine])


def _kind(rows: DataFrame) -> StructType:
    return StructType([*rows.schema.fields, StructField("codes", BinaryType()), StructField("cell", IntegerType())])


def _assigned(rows: DataFrame, model, vec_col: str) -> DataFrame:
    at, kind = rows.columns.index(vec_col), _kind(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            which, x = _matrix(batch.column(at), m.cells.shape[1])
            if len(which):
                cell, codes = m.assign(x)
                own = batch.take(pa.array(which))
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(cell, pa.int32())], names=kind.names)

    return rows.mapInArrow(run, kind)


def _write(rows: DataFrame, model: Model, path: str, vec_col: str) -> str:
    folder = snapshots.new_folder()
    sent = rows.sparkSession.sparkContext.broadcast(model)
    # A cell with many rows is written by several tasks, small ones share one.
    _assigned(rows, sent, vec_col).hint("rebalance", "cell").write.partitionBy("cell").parquet(f"{path}/{folder}")
    return folder


def build(rows: DataFrame, path: str, id_col: str = "chunk_id", vec_col: str = "embedding", params: Params = Params()) -> Model:
    """Fit a model and write all rows, in their own columns, into its cells; what the path had is no longer read."""
    spark, p = rows.sparkSession, params
    has = rows.filter(F.size(vec_col) > 0)
    size = has.agg(F.count(F.lit(1)).alias("n"), F.mode(F.size(vec_col)).alias("dim")).first()
    dim = size["dim"] or 1
    most = max(1, min(p.sample_rows, p.sample_bytes // (4 * dim)))
    of_dim, share = has.filter(F.size(vec_col) == dim), (most + 10 * math.sqrt(most)) / max(1, size["n"])
    if share < 1:  # the hashes that the sample lies below, so that other rows aren't sorted
        of_dim = of_dim.filter(F.xxhash64(id_col) < int((2 * share - 1) * 2**63))
    sample = of_dim.select(vec_col).orderBy(F.xxhash64(id_col)).limit(most).toArrow()  # most rows at most
    _, x = _matrix(sample.column(0).combine_chunks() if sample.num_rows else pa.array([[0.0] * dim], pa.list_(pa.float64())), dim)
    model = fit(x if len(x) else np.ones((1, dim)), size["n"], p)
    base = snapshots.newest(spark, path)
    folder = _write(rows, model, path, vec_col)
    parts = [("cell", i, c.tolist()) for i, c in enumerate(model.cells)] + [("book", j, b.ravel().tolist()) for j, b in enumerate(model.books)]
    where = f"model-{folder[5:]}"
    spark.createDataFrame(parts, "kind string, no int, v array<double>").coalesce(1).write.parquet(f"{path}/{where}")
    notes = {"model": where, "probes": model.probes, "candidates": model.candidates, "codes": len(model.books[0]), "id": id_col, "vector": vec_col, "schema": json.dumps(_kind(rows).jsonValue())}
    snapshots.commit(spark, path, base, {folder: {}}, notes)
    return model


def load(spark: SparkSession, path: str, here: snapshots.Snapshot) -> Model:
    rows = spark.read.parquet(f"{path}/{here.notes['model']}").orderBy("no").collect()  # an eighth of a bounded sample, and its books
    vectors = lambda kind: [np.array(r["v"]) for r in rows if r["kind"] == kind]
    books = [b.reshape(here.notes["codes"], -1) for b in vectors("book")]
    return Model(np.stack(vectors("cell")), books, here.notes["probes"], here.notes["candidates"])


def add(rows: DataFrame, path: str) -> None:
    """Assign new rows by the model that the index has."""
    spark = rows.sparkSession
    base = snapshots.newest(spark, path)
    folder = _write(rows, load(spark, path, base), path, base.notes["vector"])
    try:
        snapshots.commit(spark, path, base, base.entries | {folder: {}})
    except BaseException:
        snapshots.remove(spark, path, folder)
        raise


def read(spark: SparkSession, path: str) -> DataFrame:
    """All rows, with their codes and cell."""
    here = snapshots.newest(spark, path)
    kind = StructType.fromJson(json.loads(here.notes["schema"]))
    return reduce(DataFrame.unionByName, (spark.read.schema(kind).parquet(f"{path}/{name}") for name in here.entries))


def _reached(queries: DataFrame, model) -> dict[int, int]:
    """How many queries (query_id, q) look into each cell; under -1, how many there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        total = np.zeros(len(m.cells) + 1, np.int64)
        for batch in batches:
            _, q = _matrix(batch.column(1), m.cells.shape[1])
            for s in _pieces(len(q), len(m.cells)):
                total[:-1] += m.near(q[s]).sum(axis=0)
            total[-1] += len(q)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.where(some < len(m.cells), some, -1), pa.int32()), pa.array(total[some])], names=["cell", "n"])

    rows = queries.mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()  # a row for each cell
    return {r["cell"]: r["n"] for r in rows}


def _asked(queries: DataFrame, model, kind: str, most: int) -> DataFrame:
    """Blocks (names, q, looks) of queries (query_id, q); looks has a bit for each query and cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            which, q = _matrix(batch.column(1), m.cells.shape[1])
            vectors = _vectors(batch.column(1), which, m.cells.shape[1])
            for a in range(0, len(which), most):
                s = slice(a, a + most)
                names = batch.column(0).take(pa.array(which[s])).to_pylist()
                looks = np.packbits(m.near(q[s]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array([names], pa.list_(batch.column(0).type)), pa.array([vectors[s].tobytes()], pa.binary()), pa.array([looks.tobytes()], pa.binary())], names=["names", "q", "looks"])

    return queries.mapInArrow(run, f"names array<{kind}>, q binary, looks binary")


def _vectors(column: pa.Array, which: np.ndarray, dim: int) -> np.ndarray:
    """The vectors of some rows of a list column, as they are."""
    flat = column.take(pa.array(which)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(which), dim)


def _packed(rows: DataFrame, kind: str, dim: int, block_bytes: int) -> DataFrame:
    """Rows (id, v, codes, cell) as blocks (ids, cells, codes, vectors)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, block_bytes // (8 * dim))
            for a in range(0, batch.num_rows, step):
                own = batch.slice(a, step)
                own = own.take(pa.array(np.argsort(own.column(3).to_numpy(), kind="stable")))  # a cell's rows side by side
                v = _vectors(own.column(1), np.arange(own.num_rows), dim)
                blobs = [own.column(3).to_numpy().astype(np.int32).tobytes(), b"".join(own.column(2).to_pylist()), v.tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([own.column(0).to_pylist()], pa.list_(own.column(0).type)), *(pa.array([b], pa.binary()) for b in blobs)], names=["ids", "cells", "codes", "vectors"])

    return rows.mapInArrow(run, f"ids array<{kind}>, cells binary, codes binary, vectors binary")


class _Best:
    """Of a block of queries, the k best rows that each has met; of equal scores those with smaller ids."""

    def __init__(self, names: pa.Array, q: np.ndarray, looks: np.ndarray, model: Model, k: int, p: Params) -> None:
        self.names, self.q, self.looks, self.model, self.k, self.p = names, q, looks, model, k, p
        self.unit, self.norms = _unit(q), np.sqrt(np.einsum("ij,ij->i", q, q))
        self.low = np.full(len(q), -np.inf)  # what a row must reach
        self.rows = pd.DataFrame({"who": np.zeros(0, np.int64), "score": np.zeros(0), "id": []})

    def _chosen(self, who: np.ndarray, here: np.ndarray, ends: np.ndarray, codes: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, row) of those to be ranked.  Codes choose where few are taken; a product of matrices is faster for more."""
        take, asks = self.model.candidates, self.looks[np.ix_(who, here)]
        if 16 * take < len(unit):
            guess = np.full((len(who), len(unit)), -np.inf)
            for i, c in enumerate(here):
                one = np.flatnonzero(asks[:, i])
                guess[one, ends[i] : ends[i + 1]] = self.model.guess(self.unit[who[one]], c, codes[ends[i] : ends[i + 1]])
            best = np.argpartition(-guess, take - 1, axis=1)[:, :take]
            at, j = np.nonzero(np.take_along_axis(guess, best, axis=1) > -np.inf)
            return who[at], best[at, j]
        score = self.unit[who] @ unit.T
        for i in np.flatnonzero(~asks.all(axis=0)):
            score[~asks[:, i], ends[i] : ends[i + 1]] = -np.inf
        hit = score >= np.maximum(self.low[who], -2.0)[:, None] - 1e-9  # rounding decides nothing
        many = np.flatnonzero(np.count_nonzero(hit, axis=1) > self.k)
        for s in _pieces(len(many), len(unit), self.p.block_bytes >> 3):
            edge = np.partition(score[many[s]], -self.k, axis=1)[:, -self.k]
            hit[many[s]] &= score[many[s]] >= edge[:, None] - 1e-9
        at, j = np.nonzero(hit)
        return who[at], j

    def add(self, ids: pa.Array, here: np.ndarray, ends: np.ndarray, codes: np.ndarray, v: np.ndarray, unit: np.ndarray, norms: np.ndarray) -> None:
        """A block of rows, those of cell here[i] from ends[i] to ends[i + 1]."""
        asking = np.flatnonzero(self.looks[:, here].any(axis=1))
        found = []
        for s in _pieces(len(asking), len(v), self.p.block_bytes):
            who, row = self._chosen(asking[s], here, ends, codes, unit)
            score = np.concatenate([np.zeros(0), *(np.einsum("ij,ij->i", self.q[who[t]], v[row[t]]) / self.norms[who[t]] / norms[row[t]] for t in _pieces(len(who), v.shape[1], self.p.block_bytes))])
            keep = score >= self.low[who]
            own = pd.DataFrame({"who": who[keep], "score": score[keep], "id": ids.take(pa.array(row[keep])).to_numpy(zero_copy_only=False)})
            found.append(self._first(own) if len(own) > 2 * self.k * len(asking[s]) else own)
        found = [f for f in found if len(f)]
        if found:
            self.rows = self._first(pd.concat([*([self.rows] if len(self.rows) else []), *found], ignore_index=True))
            last = self.rows.groupby("who")["score"].agg(["size", "min"])
            full = last[last["size"] == self.k]
            self.low[full.index.to_numpy()] = full["min"].to_numpy()

    def _first(self, rows: pd.DataFrame) -> pd.DataFrame:
        return rows.sort_values(["who", "score", "id"], ascending=[True, False, True]).groupby("who").head(self.k)

    def batch(self, types: tuple[pa.DataType, pa.DataType]) -> pa.RecordBatch:
        who = self.names.take(pa.array(self.rows["who"].to_numpy())).cast(types[0])
        return pa.RecordBatch.from_arrays([who, pa.array(self.rows["score"].to_numpy()), pa.array(self.rows["id"].tolist(), types[1])], names=["query_id", "score", "id"])


def _ranked(met: DataFrame, model, k: int, p: Params, schema: str, types: tuple[pa.DataType, pa.DataType]) -> DataFrame:
    """Of each query the best k of the blocks of rows that its block meets in a task.

    met: in each partition the blocks of queries of a share, followed by its blocks of rows, then another share.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        dim, best, met_rows = m.cells.shape[1], [], False
        for batch in batches:
            for names, q, looks, ids, cells, codes, vectors in zip(*batch.columns, strict=True):
                if q.is_valid:
                    if met_rows:
                        yield from (b.batch(types) for b in best)
                        best, met_rows = [], False
                    asks = np.frombuffer(q.as_buffer().to_pybytes()).reshape(-1, dim)
                    bits = np.unpackbits(np.frombuffer(looks.as_buffer(), np.uint8).reshape(len(asks), -1), axis=1, count=len(m.cells)).astype(bool)
                    best.append(_Best(pa.array(names.as_py(), types[0]), asks, bits, m, k, p))
                    continue
                met_rows = True
                v = np.frombuffer(vectors.as_buffer()).reshape(-1, dim)
                here, at = np.unique(np.frombuffer(cells.as_buffer(), np.int32), return_index=True)
                unit, norms = _unit(v), np.sqrt(np.einsum("ij,ij->i", v, v))
                for b in best:
                    b.add(ids.values, here, np.append(at, len(v)), np.frombuffer(codes.as_buffer(), np.uint8).reshape(len(v), -1), v, unit, norms)
        yield from (b.batch(types) for b in best)

    return met.select("names", "q", "looks", "ids", "cells", "codes", "vectors").mapInArrow(run, schema)


def search(spark: SparkSession, path: str, queries: DataFrame, k: int = 5, where: Column | None = None, probes: int | None = None, candidates: int | None = None, query_id: str = "query_id", params: Params = Params()) -> DataFrame:
    """(query_id, rank, id, score) as retrieve.topk gives them, of the rows that the probed cells have; scores are true cosines.

    where: a condition on the rows' own columns, which the scan pushes down.  queries have the index's vector column.
    candidates are those that a query has in a block of rows, and so at least as many of all rows.
    """
    here, p = snapshots.newest(spark, path), params
    model = load(spark, path, here)
    model = Model(model.cells, model.books, probes or model.probes, max(k, candidates or model.candidates))
    id_col, vec_col = here.notes["id"], here.notes["vector"]
    sent = spark.sparkContext.broadcast(model)
    asks = queries.filter(F.col(query_id).isNotNull()).select(F.col(query_id).alias("query_id"), F.col(vec_col).cast("array<double>").alias("q"))
    reached = _reached(asks, sent)
    parts = -(-reached.pop(-1, 0) // p.asked_rows)
    rows = read(spark, path).filter(F.col("cell").isin(sorted(reached)) & F.col(id_col).isNotNull())
    rows = rows if where is None else rows.filter(where)
    types = tuple(f.schema[c].dataType for f, c in ((asks, "query_id"), (rows, id_col)))
    qkind, kind = (x.simpleString() for x in types)
    own = _packed(rows.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v"), "codes", "cell"), kind, model.cells.shape[1], p.block_bytes)
    blocks = _asked(asks.repartition(max(1, parts)), sent, qkind, p.asked_rows)
    # Each group of blocks of queries is sent to all shares of the index, and each share to all groups: a task has the
    # queries of its group and reads one block of rows after the other.  No row is made for a pair of blocks.
    groups, shares = -(-parts // p.group_blocks) or 1, 2 * spark.sparkContext.defaultParallelism
    place = F.spark_partition_id() + F.monotonically_increasing_id() % (1 << 33)
    every = blocks.select("*", (F.spark_partition_id() % groups).alias("group"), F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"))
    dealt = own.select("*", F.pmod(place, F.lit(shares)).cast("int").alias("share")).select("*", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"))
    met = every.withColumn("kind", F.lit(0)).unionByName(dealt.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    task = (F.col("group") * shares + F.col("share")).cast("int")
    met = met.withColumn("task", task).repartitionById(groups * shares, "task").sortWithinPartitions("task", "kind")
    found = _ranked(met, sent, k, p, f"query_id {qkind}, score double, id {kind}", tuple(to_arrow_type(x) for x in types))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    ranked = found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias(id_col), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score"))).alias("score"))
