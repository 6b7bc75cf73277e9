"""Hard negatives by a Voronoi-partitioned, distributed nearest-neighbour join.

An inner product becomes a distance: a row x gets one more component, sqrt(M2 - |x|^2), where M2 is the largest
squared norm, and an anchor a gets 0 there; then |a - x|^2 = |a|^2 + M2 - 2 a.x, and the nearest rows are those of
the highest scores.  Pivots cut the space into cells; anchors form groups by their cell.  By the triangle inequality
the distance of a row to a pivot and the radii of the pivot's anchor group bound the row's distance to each of them, so a
row is sent only to groups that it might serve.  There a block of anchors meets blocks of rows with exact integer
scores.

Positives and negatives are two such joins.  Each begins at home, with the rows of an anchor's own cell alone: the
k-th best score found there is one that every result has to reach, and so bounds the second, whole round.  A group
with many anchors is cut into blocks, and the rows sent to it into shares; a task keeps k rows for each anchor (and
positive) of the block at hand.  Bounds decide what travels, never what is found.

Defined cases: rows whose id, label or vector is null, whose vector is empty, or has a null or non-finite component
take no part, nor do those with |x|^2 of 2^55 or more after scaling, of which 100 scores pass a long.  Rows meet rows
of their own vector length.  Ties go to the smaller id.  Anchors that repeat in id, label and vector are one anchor;
a row with an anchor's id is not its candidate, other repeated rows are candidates each.  An anchor with fewer
positives or negatives has all; one without has no rows.  Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomcorpus.llm.common import discard, written


@dataclass(frozen=True)
class Params:
    positives: int = 5
    negatives: int = 10
    low: int = 30  # percent of the positive's score that a negative reaches
    high: int = 90  # percent that it doesn't pass
    scale: int = 256
    most_pivots: int = 1024  # a bounded sample of the rows: the root of the number of anchors, or this many
    pivot_bytes: int = 8 << 20  # of all pivots, which are broadcast
    anchor_rows: int = 256  # of a block of anchors, on average
    share_rows: int = 8192  # that meet a block of anchors in one go, on average, if none is pruned
    block_bytes: int = 1 << 20


#: Of |x|^2, so that 100 times any inner product is a long.
LARGEST = float(1 << 55)


def _clean(batch: pa.RecordBatch, scale: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Of rows (id, label, vector, ...) those that take part and their integer vectors, by vector length."""
    vectors = batch.column(2)
    sizes, flat = vectors.value_lengths().fill_null(0).to_numpy(), vectors.flatten().to_numpy(zero_copy_only=False)
    starts = np.cumsum(sizes) - sizes
    named = np.logical_and(*(batch.column(i).is_valid().to_numpy(zero_copy_only=False) for i in (0, 1)))
    for n in np.unique(sizes[named & (sizes > 0)]).tolist():
        at = np.flatnonzero(named & (sizes == n))
        x = np.floor(flat[(starts[at][:, None] + np.arange(n)).ravel()].reshape(len(at), n) * scale)
        with np.errstate(over="ignore", invalid="ignore"):
            fine = np.isfinite(x).all(axis=1) & ((x * x).sum(axis=1) < LARGEST)
        if fine.any():
            yield batch.take(pa.array(at[fine])), x[fine].astype(np.int64)


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer vectors: in floating point where no partial sum can be rounded."""
    most = max(1, int(np.abs(a).max(initial=0))) * max(1, int(np.abs(b).max(initial=0))) * a.shape[1]
    return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64) if most < 1 << 53 else a @ b.T


class Geometry:
    """Pivots by vector length, and the distances to them in the augmented space."""

    def __init__(self, pivots: list[list[int]], m2: float) -> None:
        self.m2 = max(m2, 1.0)
        by_size: dict[int, list] = {}
        for v in pivots:
            by_size.setdefault(len(v), []).append(v)
        self.pivots = {n: np.array(v, dtype=np.float64) for n, v in by_size.items()}
        #: Far above what rounding takes from a distance.
        self.slack = 1e-5 * self.m2**0.5

    def of(self, n: int) -> np.ndarray:
        """The pivots of a vector length; one at the origin where the sample had none."""
        return self.pivots.get(n, np.zeros((1, n)))

    def rows(self, x: np.ndarray) -> np.ndarray:
        """Distances of rows to the pivots."""
        p, x = self.of(x.shape[1]), x.astype(np.float64)
        last = [np.sqrt(np.maximum(0.0, self.m2 - (v * v).sum(axis=1))) for v in (x, p)]
        return np.sqrt(np.maximum(0.0, 2 * self.m2 - 2 * (x @ p.T + last[0][:, None] * last[1])))

    def anchors(self, a: np.ndarray) -> np.ndarray:
        """Distances of anchors, which have 0 as their last component."""
        p, a = self.of(a.shape[1]), a.astype(np.float64)
        return np.sqrt(np.maximum(0.0, (a * a).sum(axis=1)[:, None] + self.m2 - 2 * a @ p.T))


def _lists(flat: np.ndarray, size: int) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, flat.size + 1, max(1, size)), pa.int32()), pa.array(flat.ravel(), pa.int64()))


def _sized(p: Params):
    """Of each batch: rows that take part, their largest squared norm and length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x in _clean(batch, p.scale):
                x = x.astype(np.float64)
                yield pa.RecordBatch.from_pydict({"n": [rows.num_rows], "m2": [float((x * x).sum(axis=1).max())], "dim": [x.shape[1]]})

    return run


def _vectors(p: Params):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x in _clean(batch, p.scale):
                yield pa.RecordBatch.from_arrays([rows.column(0), _lists(x, x.shape[1])], names=["id", "v"])

    return run


def _grouped(geometry, p: Params):
    """Anchors with their cell, distance d to its pivot, and squared norm."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x in _clean(batch, p.scale):
                far = geometry.value.anchors(x)
                cell, n2 = far.argmin(axis=1), (x.astype(np.float64) ** 2).sum(axis=1)
                cols = [pa.array(np.full(len(x), x.shape[1]), pa.int32()), pa.array(cell, pa.int32()), pa.array(far.min(axis=1)), pa.array(n2), rows.column(0), rows.column(3), rows.column(1), _lists(x, x.shape[1])]
                yield pa.RecordBatch.from_arrays(cols, names=["dim", "cell", "d", "n2", "id", "key", "label", "v"])

    return run


def _sent(geometry, groups: dict[tuple[int, int], tuple], home: bool, shares: int, p: Params):
    """Blocks of rows for each group that they might serve: at home the one of their own cell, else by the bounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = geometry.value
        for batch in batches:
            for rows, x in _clean(batch, p.scale):
                dim, far = x.shape[1], g.rows(x)
                own = far.argmin(axis=1)
                code = next(c for c in ("i2", "i4", "i8") if np.abs(x).max(initial=0) <= np.iinfo(c).max)
                step = max(1, p.block_bytes // (dim * int(code[1])))
                for cell in range(far.shape[1]):
                    if (dim, cell) not in groups:
                        continue
                    near, wide, reach, inner = groups[dim, cell]
                    to = far[:, cell]
                    least, most = np.maximum(np.maximum(to - wide, near - to), 0.0), to + wide
                    at = np.flatnonzero(own == cell if home else (least <= reach + g.slack) & (most >= inner - g.slack))
                    for a in range(0, len(at), step):
                        part = at[a : a + step]
                        packed = x[part].astype(code).tobytes()
                        ids, labels = (pa.array([rows.column(i).take(pa.array(part)).to_pylist()], pa.list_(kind)) for i, kind in ((0, pa.int64()), (1, pa.string())))
                        share = zlib.crc32(packed) % shares
                        yield pa.RecordBatch.from_arrays([*(pa.array([v], pa.int32()) for v in (dim, cell, share)), ids, labels, pa.array([packed], pa.binary()), pa.array([code])], names=["dim", "cell", "share", "rows", "row_labels", "vectors", "code"])

    return run


SENT = "dim int, cell int, share int, rows array<long>, row_labels array<string>, vectors binary, code string"
FOUND = "anchor_id long, anchor_key long, slot int, score long, id long"


class _Best:
    """The k best (score, id) of each slot of a block's anchors; a slot takes scores from low to high of rows whose label is the anchor's or isn't."""

    def __init__(self, ids: list, keys: list, labels: pa.Array, v: np.ndarray, low: list, high: list, same: bool, k: int) -> None:
        self.ids, self.keys, self.v, self.same, self.k = np.array(ids, np.int64), keys, v, same, k
        self.kinds = pc.unique(labels)
        self.codes = pc.index_in(labels, self.kinds).to_numpy()
        self.slots = [list(zip(a, b, strict=True)) for a, b in zip(low, high, strict=True)]
        self.best: list[list[list]] = [[[] for _ in s] for s in self.slots]

    def floor(self, i: int) -> int:
        """The lowest score that could still be taken for an anchor."""
        return min((max(low, -kept[-1][0]) if len(kept) == self.k else low for (low, _), kept in zip(self.slots[i], self.best[i], strict=True)), default=np.iinfo(np.int64).max)

    def add(self, ids: np.ndarray, labels: pa.Array, v: np.ndarray) -> None:
        scores = _product(self.v, v)
        codes = pc.index_in(labels, self.kinds).fill_null(-1).to_numpy()
        for i, row in enumerate(scores):
            wanted = (codes == self.codes[i]) == self.same
            at = np.flatnonzero(wanted & (row >= self.floor(i)) & (ids != self.ids[i]))
            at = at[np.lexsort((ids[at], -row[at]))]
            down = -row[at]
            for slot, (low, high) in enumerate(self.slots[i]):
                a = np.searchsorted(down, -high, side="left")
                b = min(a + self.k, np.searchsorted(down, -low, side="right"))
                if a < b:
                    more = list(zip(down[a:b].tolist(), ids[at[a:b]].tolist(), strict=True))
                    self.best[i][slot] = sorted(self.best[i][slot] + more)[: self.k]

    def batch(self) -> pa.RecordBatch:
        flat = [(int(self.ids[i]), self.keys[i], slot, -s, x) for i, slots in enumerate(self.best) for slot, kept in enumerate(slots) for s, x in kept]
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([r[j] for r in flat], t) for j, t in enumerate(kinds)], names=["anchor_id", "anchor_key", "slot", "score", "id"])


def _met(same: bool, k: int):
    """What the anchors of a block find among the rows that were sent to it; the rows of a block follow one another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, best = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(j)[i] for j, name in enumerate(batch.schema.names)}
                at = tuple(row[c].as_py() for c in ("dim", "cell", "block", "share"))
                if at != here:
                    if best:
                        yield best.batch()
                    v = row["v"].values.to_numpy().reshape(-1, at[0])
                    here, best = at, _Best(row["ids"].as_py(), row["keys"].as_py(), row["labels"].values, v, row["low"].as_py(), row["high"].as_py(), same, k)
                vectors = np.frombuffer(row["vectors"].as_buffer(), "<" + row["code"].as_py()).reshape(-1, at[0]).astype(np.int64)
                best.add(row["rows"].values.to_numpy(), row["row_labels"].values, vectors)
        if best:
            yield best.batch()

    return run


def _joined(base: DataFrame, anchors: DataFrame, geometry, home: bool, same: bool, k: int, shares: int, p: Params) -> DataFrame:
    """The k best rows of each slot of each anchor (id, key, label, v, low, high, dim, cell, d, reach, inner)."""
    radii = anchors.groupBy("dim", "cell").agg(F.min("d").alias("near"), F.max("d").alias("wide"), F.max("reach").alias("reach"), F.min("inner").alias("inner"), F.count(F.lit(1)).alias("n")).collect()  # a row for each pivot
    groups = {(r["dim"], r["cell"]): (r["near"], r["wide"], r["reach"], r["inner"]) for r in radii}
    spark = base.sparkSession
    cuts = spark.createDataFrame([(r["dim"], r["cell"], ceil(r["n"] / p.anchor_rows)) for r in radii], "dim int, cell int, cuts int")
    mine = anchors.join(F.broadcast(cuts), ["dim", "cell"]).withColumn("block", F.pmod(F.xxhash64("id", "key"), F.col("cuts")).cast("int"))
    blocks = mine.groupBy("dim", "cell", "block").agg(F.collect_list(F.struct("id", "key", "label", "v", "low", "high")).alias("a"))  # anchor_rows each, on average
    blocks = blocks.select("dim", "cell", "block", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"), F.col("a.id").alias("ids"), F.col("a.key").alias("keys"), F.col("a.label").alias("labels"), F.flatten("a.v").alias("v"), F.col("a.low").alias("low"), F.col("a.high").alias("high"))
    sent = base.select("id", "label", "vector").mapInArrow(_sent(geometry, groups, home, shares, p), SENT)
    # The left side streams: a block of anchors meets all blocks of its share, then the next one does.
    met = blocks.join(sent.hint("merge"), ["dim", "cell", "share"])
    found = met.select("dim", "cell", "block", "share", "ids", "keys", "labels", "v", "low", "high", "rows", "row_labels", "vectors", "code").mapInArrow(_met(same, k), FOUND)
    w = Window.partitionBy("anchor_id", "anchor_key", "slot").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _reaching(anchors: DataFrame, found: DataFrame, k: int, m2: float) -> DataFrame:
    """Anchors with reach and inner: the distances of the lowest and the highest score that a result can have."""
    kth = found.filter(F.col("rank") == k).select(F.col("anchor_id").alias("id"), F.col("anchor_key").alias("key"), "slot", "score")
    kth = kth.groupBy("id", "key").agg(F.map_from_entries(F.collect_list(F.struct("slot", "score"))).alias("kth"))  # an entry for each slot
    least = F.array_min(F.transform("low", lambda low, slot: F.greatest(low, F.try_element_at("kth", slot))))
    far = lambda score: F.sqrt(F.greatest(F.lit(0.0), F.col("n2") + m2 - 2.0 * score))
    rows = anchors.drop("reach", "inner").join(kth, ["id", "key"], "left")
    return rows.withColumn("kth", F.coalesce("kth", F.expr("cast(map() AS map<int, bigint>)"))).select("*", far(least).alias("reach"), far(F.array_max("high")).alias("inner")).drop("kth")


def _two_rounds(base: DataFrame, anchors: DataFrame, geometry, same: bool, k: int, shares: int, p: Params, name: str) -> DataFrame:
    """The k best rows of each slot: a round at home, then the whole one within what it bounds."""
    home = written(_joined(base, anchors.withColumns({"reach": F.lit(0.0), "inner": F.lit(0.0)}), geometry, True, same, k, shares, p), f"{name}_home")
    bounded = written(_reaching(anchors, home, k, geometry.value.m2), f"{name}_bounds")
    out = written(_joined(base, bounded, geometry, False, same, k, shares, p), name)
    discard(home, bounded)
    return out


def mine(rows: DataFrame, is_anchor: Column, id_col: str = "vec_id", label_col: str = "label", vec_col: str = "embedding", params: Params = Params()) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: of every anchor and each of its positives the hardest negatives.

    Positives are an anchor's best rows of its label, negatives its best rows of others between `low` and `high` percent of a
    positive's score.
    """
    p, spark = params, rows.sparkSession
    named = [F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vec_col).cast("array<double>").alias("vector")]
    base = rows.select(*named)
    asked = rows.filter(is_anchor).select(*named).withColumn("key", F.xxhash64("label", "vector"))
    of = base.mapInArrow(_sized(p), "n long, m2 double, dim long").agg(F.sum("n").alias("n"), F.max("m2").alias("m2"), F.max("dim").alias("dim")).first()
    pivots = max(1, min(p.most_pivots, isqrt(asked.count()), p.pivot_bytes // (8 * (of["dim"] or 1))))
    sample = base.mapInArrow(_vectors(p), "id long, v array<long>").orderBy(F.xxhash64("id"), "id").limit(pivots).collect()
    geometry = spark.sparkContext.broadcast(Geometry([r["v"] for r in sample], of["m2"] or 0.0))
    shares = max(1, ceil((of["n"] or 0) / p.share_rows))
    every = "array(cast({} AS bigint))"
    anchors = asked.mapInArrow(_grouped(geometry, p), "dim int, cell int, d double, n2 double, id long, key long, label string, v array<long>").dropDuplicates(["id", "key"])
    anchors = written(anchors.withColumns({"low": F.expr(every.format(-(1 << 55))), "high": F.expr(every.format(1 << 55))}), "anchors")
    near = _two_rounds(base, anchors, geometry, True, p.positives, shares, p, "positives")
    lists = near.groupBy(F.col("anchor_id").alias("id"), F.col("anchor_key").alias("key")).agg(F.array_sort(F.collect_list(F.struct("rank", "score"))).alias("l"))  # a few positives each
    edge = lambda percent, up: F.transform("l", lambda x: (F.ceil if up else F.floor)((x["score"] * percent).cast("decimal(20,0)") / 100).cast("long"))
    windows = written(anchors.drop("low", "high").join(lists, ["id", "key"]).withColumns({"low": edge(p.low, True), "high": edge(p.high, False)}).drop("l"), "windows")
    far = _two_rounds(base, windows, geometry, False, p.negatives, shares, p, "negatives")
    discard(anchors, windows)
    positive = near.select("anchor_id", "anchor_key", (F.col("rank") - 1).alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = far.withColumnsRenamed({"id": "negative_id", "score": "negative_score"}).join(positive, ["anchor_id", "anchor_key", "slot"])
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op13_hard_negatives(vectors: DataFrame) -> DataFrame:
    """The contract's query: every seventh label is moved on, anchors are the rows whose id is divisible by 100."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(vectors.withColumn("label", label), F.col("vec_id") % 100 == 0)


OP13_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id AS id, a.label = c.label AS same, list_inner_product(a.q, c.q)::BIGINT AS score FROM v a JOIN v c ON c.vec_id <> a.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id))::INT AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10"""
