"""The approximate index: recall against exact search, pruned folders, filters, new rows, odd vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomcorpus.operators import cells, retrieve
from loomcorpus.sources import snapshots

KIND = "chunk_id long, embedding array<float>, label int"


def some(spark, n, seed, clusters=0, dim=16, start=0):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, dim)) * (0.3 if clusters else 1.0)
    if clusters:
        v += np.random.default_rng(1).normal(size=(clusters, dim))[rng.integers(0, clusters, n)]
    return spark.createDataFrame([(start + i, x.astype(np.float32).tolist(), int(i % 4)) for i, x in enumerate(v)], KIND)


def pairs(hits):
    return {(r["query_id"], r["chunk_id"]) for r in hits.collect()}


def recall(got, want):
    return len(pairs(got) & pairs(want)) / len(pairs(want))


@pytest.mark.parametrize("clusters", [0, 12])
def test_recall_pruning_and_new_rows(spark, tmp_path, clusters):
    path, rows = str(tmp_path / "cells"), some(spark, 1200, 2, clusters)
    model = cells.build(rows, path)
    asks = some(spark, 40, 3, clusters).select(F.col("chunk_id").alias("query_id"), "embedding")
    got = cells.search(spark, path, asks, 10)
    want = retrieve.topk(rows, asks, 10)
    assert recall(got, want) >= 0.95
    exact = {(r["query_id"], r["chunk_id"]): r["score"] for r in retrieve.topk(rows, asks, 1200).collect()}
    assert all(abs(exact[r["query_id"], r["chunk_id"]] - r["score"]) < 1e-6 for r in got.collect())
    one = cells.search(spark, path, asks.limit(1), 10)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan and model.candidates < 600
    if clusters:
        assert model.probes <= len(model.cells) / 3
    more = some(spark, 300, 4, clusters, start=5000)
    before = snapshots.newest(spark, path)
    cells.add(more, path)
    after = snapshots.newest(spark, path)
    assert after.entries.keys() > before.entries.keys() and after.notes == before.notes
    assert cells.read(spark, path).count() == 1500
    assert recall(cells.search(spark, path, asks, 10), retrieve.topk(rows.union(more), asks, 10)) >= 0.95


def test_filters_and_odd_vectors(spark, tmp_path):
    path = str(tmp_path / "cells")
    odd = spark.createDataFrame([(9000, None, 1), (9001, [], 1), (9002, [0.0] * 16, 1), (9003, [1.0, 2.0], 1), (9004, [float("nan")] * 16, 1), (9005, [None] * 16, 1)], KIND)
    rows = some(spark, 400, 5)
    cells.build(rows.union(odd), path)
    assert cells.read(spark, path).count() == 400
    asks = some(spark, 10, 6).union(odd).select(F.col("chunk_id").alias("query_id"), "embedding")
    got = cells.search(spark, path, asks, 5, where=F.col("label") == 2, probes=1000, candidates=1000)
    want = retrieve.topk(rows.filter("label = 2"), asks.filter("query_id < 9000"), 5)
    assert [(r["query_id"], r["rank"], r["chunk_id"]) for r in got.orderBy("query_id", "rank").collect()] == [(r["query_id"], r["rank"], r["chunk_id"]) for r in want.orderBy("query_id", "rank").collect()]
    assert cells.search(spark, path, asks.limit(0), 5).collect() == []


def test_empty_and_tiny_tables(spark, tmp_path):
    asks = some(spark, 3, 6).select(F.col("chunk_id").alias("query_id"), "embedding")
    cells.build(some(spark, 0, 1), str(tmp_path / "none"))
    assert cells.search(spark, str(tmp_path / "none"), asks, 5).collect() == []
    cells.build(some(spark, 3, 1), str(tmp_path / "three"))
    assert len(cells.search(spark, str(tmp_path / "three"), asks, 5).collect()) == 9


def test_many_queries_in_blocks(spark, tmp_path):
    """More queries than a block has, equal vectors and codes that choose: no row for a pair is made, the index is read once."""
    path, rows = str(tmp_path / "cells"), some(spark, 900, 7)
    rows = rows.union(rows.filter("chunk_id < 30").selectExpr("chunk_id + 5000", "embedding", "label"))
    cells.build(rows, path)
    asks = some(spark, 90, 8, start=100).union(rows.filter("chunk_id < 10")).select(F.col("chunk_id").alias("query_id"), "embedding").dropDuplicates(["query_id"])
    small = cells.Params(asked_rows=16, block_bytes=16 * 8 * 50)  # 16 queries, 50 rows
    got = cells.search(spark, path, asks, 10, probes=1000, candidates=1000, params=small)
    want = retrieve.topk(rows, asks, 10)
    line = lambda df: [(r["query_id"], r["rank"], r["chunk_id"]) for r in df.orderBy("query_id", "rank").collect()]
    assert line(got) == line(want)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PartitionFilters: [cell") == 1
    few = cells.search(spark, path, asks, 2, probes=1000, candidates=2, params=small)
    assert len(pairs(few)) == 2 * asks.count() and recall(few, retrieve.topk(rows, asks, 2)) >= 0.5


def test_no_row_for_a_pair_of_blocks(spark, tmp_path):
    """Groups of query blocks and shares of the index meet in tasks, not in a join, and find what exact search finds, among many equal vectors too."""
    path, rows = str(tmp_path / "cells"), some(spark, 700, 9, clusters=5)
    one = rows.filter("chunk_id = 3").select(F.explode(F.sequence(F.lit(8000), F.lit(8120))).alias("chunk_id"), "embedding", "label")
    rows = rows.union(one)
    cells.build(rows, path)
    asks = rows.filter("chunk_id % 9 = 3 OR chunk_id BETWEEN 8000 AND 8010").select(F.col("chunk_id").alias("query_id"), "embedding")
    small = cells.Params(asked_rows=8, group_blocks=2, block_bytes=16 * 8 * 40)
    got = cells.search(spark, path, asks, 7, probes=1000, candidates=1000, params=small)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "CartesianProduct" not in plan
    line = lambda df: [(r["query_id"], r["rank"], r["chunk_id"]) for r in df.orderBy("query_id", "rank").collect()]
    assert line(got) == line(retrieve.topk(rows, asks, 7))
