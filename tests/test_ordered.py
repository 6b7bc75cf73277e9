"""Running sums, batches, windows and occurrences where one key has most rows."""

import random

import pytest
from pyspark.sql import functions as F

from loomcorpus.operators import chunk, ordered, report
from loomcorpus.providers import batch_numbers, token_batches
from loomcorpus.streaming.ingest import SECTION


def test_running_sums(spark):
    rng = random.Random(1)
    rows = [(k, o, rng.randrange(9)) for k in ("a", "b", None) for o in range(400 if k == "a" else 30)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, o int, v int").repartition(5)
    assert ordered.crowded(df, ["k"]) and not ordered.crowded(df, ["k", "o"])
    got = {(r["k"], r["o"]): (r["s"], r["n"]) for r in ordered.running(df, ["k"], ["o"], s=F.col("v"), n=F.lit(1)).collect()}
    want = {(k, o): (sum(v for a, b, v in rows if a == k and b <= o), o + 1) for k, o, _ in rows}
    assert got == want


@pytest.mark.parametrize("most", [1, 7, 50, 400])
def test_batches_of_one_key(spark, most):
    rng = random.Random(most)
    rows = [(k, i, rng.choice([0, 0, 1, 3, 9, 60, None])) for k in ("hot", None) for i in range(700 if k else 20)]
    df = spark.createDataFrame(rows, "k string, i int, n int").repartition(3)
    assert ordered.crowded(df, ["k"])
    got = {(r["k"], r["i"]): r["batch"] for r in batch_numbers(df, "k", "i", "n", most).collect()}
    for k in ("hot", None):
        assert [got[k, i] for i in range(700 if k else 20)] == token_batches([n or 0 for a, _, n in rows if a == k], most)


def test_batches_have_even_tasks(spark):
    """All rows in one key: no range has over twice the median."""
    df = spark.range(4000).select(F.lit("one").alias("k"), "id", F.lit(3).alias("n"))
    sizes = sorted(r["count"] for r in ordered.ranged(df, ["k"], ["id"]).groupBy("__part").count().collect())
    assert len(sizes) == 4 and sizes[-1] <= 2 * sizes[1]


def test_rate_window_of_one_key(spark):
    rng = random.Random(3)
    rows = [(i, "hot" if i % 20 else "cold", rng.randrange(200) * 1_000_000, rng.randrange(5)) for i in range(500)]
    log = spark.createDataFrame(rows, "i int, key string, ts_us long, tokens int")
    got = {r["i"]: (r["n_window"], r["tokens_window"], r["breach"]) for r in report.rate_window(log, 10, 30, 70).collect()}
    for i, k, at, _ in rows:
        seen = [n for _, key, t, n in rows if key == k and at - 10_000_000 <= t <= at]
        assert got[i] == (len(seen), sum(seen), len(seen) > 30 or sum(seen) > 70)


def test_occurrences_of_one_heading(spark):
    rows = [(i, f"text {i}", "docs", "s", "p" if i % 9 else None, ["H"]) for i in range(200)]
    df = spark.createDataFrame(rows, SECTION).repartition(4)
    got = {r["text"]: r["chunk_id"] for r in chunk.chunk_documents(df).collect()}
    named = df.withColumn("section_path", F.lit("H")).withColumn("occurrence", chunk.occurrence())
    want = {r["text"]: r["chunk_id"] for r in chunk.chunk_rows(chunk.cut_sections(named)).collect()}
    assert got == want and len(set(got.values())) == 200
