"""Retrieval metrics over ranked lists; truth and lists are tables of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def per_query(ranked: DataFrame, truth: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, recall_at_k, mrr, k, num_relevant): null metrics where a query has no truth."""
    want = truth.select("query_id", "chunk_id").distinct()
    size = want.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    hits = ranked.filter(F.col("rank") <= k).join(want, ["query_id", "chunk_id"]).groupBy("query_id").agg(F.count(F.lit(1)).alias("h"), F.min("rank").alias("first"))
    rows = queries.select("query_id").join(size, "query_id", "left").join(hits, "query_id", "left")
    has = F.col("n").isNotNull()
    return rows.select(
        "query_id", F.when(has, F.coalesce("h", F.lit(0)) / F.col("n")).alias("recall_at_k"), F.when(has, F.coalesce(F.lit(1.0) / F.col("first"), F.lit(0.0))).alias("mrr"),
        F.lit(k).alias("k"), F.coalesce("n", F.lit(0)).alias("num_relevant"),
    )


def macro_means(per: DataFrame) -> DataFrame:
    """One row: the means of recall and reciprocal rank over the queries that have truth, and their number."""
    return per.agg(F.avg("recall_at_k").alias("recall"), F.avg("mrr").alias("mrr"), F.count("recall_at_k").alias("n"))


def by_category(ranked: DataFrame, truth: DataFrame, queries: DataFrame, category: str, k: int = 10, ks: tuple[int, ...] = (5, 10)) -> DataFrame:
    """Of each category: queries with truth, mean reciprocal rank within k and mean recall at each of ks; 0 where no query has truth."""
    want = truth.select("query_id", "chunk_id").distinct()
    size = want.groupBy("query_id").agg(F.count(F.lit(1)).alias("size"))
    hits = ranked.join(want, ["query_id", "chunk_id"]).groupBy("query_id").agg(F.min(F.when(F.col("rank") <= k, F.col("rank"))).alias("first"), *(F.count_if(F.col("rank") <= x).alias(f"h{x}") for x in ks))
    rows = queries.select("query_id", category).join(size, "query_id", "left").join(hits, "query_id", "left")
    mean = lambda x: F.coalesce(F.avg(F.when(F.col("size").isNotNull(), F.coalesce(x, F.lit(0.0)))), F.lit(0.0))
    return rows.groupBy(category).agg(F.count("size").alias("n"), mean(1.0 / F.col("first")).alias("mrr"), *(mean(F.col(f"h{x}") / F.col("size")).alias(f"recall_{x}") for x in ks))


def recall_at_ks(ranked: DataFrame, truth: DataFrame, ks: list[int]) -> DataFrame:
    """(k, recall): the mean over queries with truth, all k from one pass over the list."""
    want = truth.select("query_id", "chunk_id").distinct()
    size = want.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    hits = want.join(ranked, ["query_id", "chunk_id"]).groupBy("query_id").agg(*(F.count_if(F.col("rank") <= k).alias(f"h{k}") for k in ks))
    rows = size.join(hits, "query_id", "left")
    one = rows.agg(*(F.avg(F.coalesce(F.col(f"h{k}"), F.lit(0)) / F.col("n")).alias(f"h{k}") for k in ks))
    return one.select(F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"h{k}").alias("recall")) for k in ks))).alias("x")).select("x.*")
