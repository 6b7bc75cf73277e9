"""Exact cosine top-k for a set of queries, in blocks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

QUERY_GROUP = 2048  # queries broadcast at once


def source_filter(index: DataFrame, column: str, wanted: Sequence | str | None) -> DataFrame:
    """One value, several, or no filter if there are none; pushed to the scan."""
    values = [wanted] if isinstance(wanted, (str, int)) else list(wanted or [])
    return index.filter(F.col(column).isin(values)) if values else index


def topk(index: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "chunk_id", vec_col: str = "embedding", query_id: str = "query_id", group: int = QUERY_GROUP) -> DataFrame:
    """(query_id, rank, id, score): score is the cosine, clamped to [0, 1]; ties go to the smaller id.

    A query meets the vectors of its own length; queries and rows without a vector take no part.  Up to `group` queries
    are broadcast and the index is read where it lies.  More are cut into blocks as the index is: its blocks are dealt
    into shares, and each share meets every block of queries.  Either way a task keeps k rows for each query at hand,
    so those that meet in the final ranking are k for each task.
    """
    kind, qkind = (f.schema[c].dataType for f, c in ((index, id_col), (queries, query_id)))
    base = index.filter(F.col(vec_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    asked = queries.filter(F.col(vec_col).isNotNull()).select(F.col(query_id).alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    few = asked.limit(group + 1).collect()
    schema, arrow = f"query_id {qkind.simpleString()}, score double, id {kind.simpleString()}", (to_arrow_type(qkind), to_arrow_type(kind))
    if len(few) <= group:
        by_size: dict[int, tuple[list, list]] = {}
        for r in few:
            names, vectors = by_size.setdefault(len(r["v"]), ([], []))
            names.append(r["id"])
            vectors.append(r["v"])
        sent = index.sparkSession.sparkContext.broadcast({n: (names, _unit(np.array(v))) for n, (names, v) in by_size.items()})
        found = base.mapInArrow(_ranker(sent, k, arrow), schema)
    else:
        shares = 4 * index.sparkSession.sparkContext.defaultParallelism
        own = blocks(base, kind.simpleString()).withColumn("share", F.pmod(F.xxhash64("vectors"), F.lit(shares)))
        every = blocks(asked, qkind.simpleString()).select("dim", F.col("ids").alias("names"), F.col("vectors").alias("queries"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shares - 1).cast("long"))).alias("share"))
        # The left side streams: a task ranks all blocks of its share for one block of queries, then for the next.
        met = every.repartition(shares, "share", "dim").join(own.repartition(shares, "share", "dim").hint("merge"), ["share", "dim"])
        found = met.select("dim", "names", "queries", "ids", "vectors").mapInArrow(_block_ranker(k, arrow), schema)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score"))).alias("score"))


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)


def _by_size(batch: pa.RecordBatch) -> Iterator[tuple[list, np.ndarray]]:
    """Ids and vectors of the rows (id, v) of each length."""
    sizes, flat = batch.column(1).value_lengths().to_numpy(), batch.column(1).flatten().to_numpy()
    starts = np.cumsum(sizes) - sizes
    for n in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == n)
        yield batch.column(0).take(pa.array(at)).to_pylist(), flat[(starts[at][:, None] + np.arange(n)).ravel()].reshape(len(at), n)


def blocks(rows: DataFrame, kind: str, block_bytes: int = 2 << 20) -> DataFrame:
    """Of rows (id, v): dim, ids and vectors (as bytes) of blocks of vectors of one length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, v in _by_size(batch):
                step = max(1, block_bytes // (8 * max(1, v.shape[1])))
                for a in range(0, len(ids), step):
                    yield pa.RecordBatch.from_arrays([pa.array([v.shape[1]], pa.int32()), pa.array([ids[a : a + step]], pa.list_(batch.column(0).type)), pa.array([v[a : a + step].tobytes()], pa.binary())], names=["dim", "ids", "vectors"])

    return rows.mapInArrow(run, f"dim int, ids array<{kind}>, vectors binary")


class _Best:
    """The k best (score, id) so far of each query."""

    def __init__(self, names: list, vectors: np.ndarray, k: int) -> None:
        self.names, self.vectors, self.k = names, vectors, k
        self.rows: list[list] = [[] for _ in names]

    def add(self, ids: list, v: np.ndarray) -> None:
        for i, row in enumerate(self.vectors @ _unit(v).T):
            edge = np.partition(row, -self.k)[-self.k] if len(row) > self.k else -np.inf
            self.rows[i] = sorted(self.rows[i] + [(-row[j], ids[j]) for j in np.flatnonzero(row >= edge)])[: self.k]

    def batch(self, types: tuple[pa.DataType, pa.DataType]) -> pa.RecordBatch:
        flat = [(name, -float(s), x) for name, rows in zip(self.names, self.rows, strict=True) for s, x in rows]
        return pa.RecordBatch.from_arrays([pa.array([r[j] for r in flat], t) for j, t in enumerate((types[0], pa.float64(), types[1]))], names=["query_id", "score", "id"])


def _ranker(sent, k: int, types: tuple[pa.DataType, pa.DataType]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {n: _Best(names, vectors, k) for n, (names, vectors) in sent.value.items()}
        for batch in batches:
            for ids, v in _by_size(batch):
                if v.shape[1] in best:
                    best[v.shape[1]].add(ids, v)
        for b in best.values():
            yield b.batch(types)

    return run


def _block_ranker(k: int, types: tuple[pa.DataType, pa.DataType]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, best = None, None
        for batch in batches:
            for dim, names, queries, ids, vectors in zip(*batch.columns, strict=True):
                mine = (dim.as_py(), queries.as_buffer().to_pybytes())
                if mine != group:
                    if best:
                        yield best.batch(types)
                    group, best = mine, _Best(names.as_py(), _unit(np.frombuffer(mine[1]).reshape(-1, mine[0])), k)
                best.add(ids.as_py(), np.frombuffer(vectors.as_buffer()).reshape(-1, mine[0]))
        if best:
            yield best.batch(types)

    return run


def hit_rows(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Hits with text and metadata, empty strings for what is missing."""
    meta = [c for c in ("text", "source_type", "source_name", "section_path", "original_path") if c in chunks.columns]
    return hits.join(chunks.select("chunk_id", *meta), "chunk_id", "left").select("query_id", "rank", "chunk_id", "score", *(F.coalesce(c, F.lit("")).alias(c) for c in meta))


def cited(hits: DataFrame, answers: DataFrame) -> DataFrame:
    """The hits that answers (query_id, citations_used, abstained) cite: numbers beyond the hits name none, and an answer that abstains cites nothing."""
    marks = answers.filter(~F.coalesce("abstained", F.lit(False))).select("query_id", F.explode(F.array_distinct("citations_used")).alias("rank"))
    return hits.join(marks, ["query_id", "rank"])


def context(hits: DataFrame) -> DataFrame:
    """One numbered context per query, in rank order; a query has k hits at most."""
    block = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] Source: "), F.col("source_name"), F.lit(" | Section: "), F.col("section_path"), F.lit("\n"), F.col("text"))
    rows = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", block.alias("block")))).alias("blocks"))
    return rows.select("query_id", F.array_join(F.transform("blocks", lambda b: b["block"]), "\n\n").alias("context"))
