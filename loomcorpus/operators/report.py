"""Reports over chunks, results and labels; each is one aggregation with a few sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomcorpus.operators.ordered import crowded, running
from loomcorpus.sources.shared import stored


def ingest_summary(chunks: DataFrame) -> DataFrame:
    """Per source type and in total: chunks, floor of the mean tokens, tokens."""
    n, t = F.count(F.lit(1)), F.sum("token_count")
    return chunks.rollup("source_type").agg(n.alias("n"), F.floor(t / n).alias("mean_tokens"), t.alias("tokens"), F.grouping("source_type").alias("g")).select(F.when(F.col("g") == 1, "TOTAL").otherwise(F.col("source_type")).alias("source_type"), "n", "mean_tokens", "tokens")


def corpus_table(chunks: DataFrame) -> DataFrame:
    """Per source type: distinct sources, chunks, mean rounded half to even, tokens; the total sums the distincts."""
    per = chunks.groupBy("source_type").agg(F.count_distinct("source_name").alias("files"), F.count(F.lit(1)).alias("chunks"), F.bround(F.avg("token_count"), 0).alias("mean_tokens"), F.sum("token_count").alias("tokens"), F.avg("token_count").alias("m"))
    total = per.agg(F.sum("files").alias("files"), F.sum("chunks").alias("chunks"), F.bround(F.sum("tokens") / F.sum("chunks"), 0).alias("mean_tokens"), F.sum("tokens").alias("tokens")).select(F.lit("TOTAL").alias("source_type"), "files", "chunks", "mean_tokens", "tokens")
    return per.drop("m").unionByName(total)


def distribution(rows: DataFrame, score: str) -> DataFrame:
    """Count and percentage of each value; nulls are a value."""
    per = rows.groupBy(score).agg(F.count(F.lit(1)).alias("n"))
    return per.withColumn("pct", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()), 4))


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b == 0, 0.0).otherwise(F.try_divide(a, b))


def abstention_scores(rows: DataFrame) -> DataFrame:
    """Precision, recall and F1 of abstained against should_abstain."""
    s, a = F.col("should_abstain"), F.col("abstained")
    one = rows.agg(F.count_if(s & a).alias("tp"), F.count_if(~s & a).alias("fp"), F.count_if(s & ~a).alias("fn"), F.count_if(s == a).alias("right"), F.count(F.lit(1)).alias("n"))
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return one.select("tp", "fp", "fn", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(ratio(2 * p * r, p + r), 6).alias("f1"), F.round(ratio(F.col("right"), F.col("n")), 6).alias("accuracy"))


def abstention_cells(rows: DataFrame) -> DataFrame:
    """Four outcomes of each category."""
    s, a = F.col("should_abstain"), F.col("abstained")
    return rows.groupBy("category").agg(F.count_if(s & a).alias("right_abstain"), F.count_if(~s & a).alias("false_abstain"), F.count_if(s & ~a).alias("missed_abstain"), F.count_if(~s & ~a).alias("answered"))


def ablation_table(rows: DataFrame) -> DataFrame:
    """Means of rag and base and their difference, per category and overall; rows with both scores only."""
    both = rows.filter("rag IS NOT NULL AND base IS NOT NULL")
    out = both.rollup("category").agg(F.count(F.lit(1)).alias("n"), F.avg("rag").alias("r"), F.avg("base").alias("b"), F.grouping("category").alias("g"))
    return out.select(F.when(F.col("g") == 1, "OVERALL").otherwise(F.col("category")).alias("category"), "n", F.round("r", 2).alias("rag"), F.round("b", 2).alias("base"), F.round(F.col("r") - F.col("b"), 2).alias("delta"))


def delta_extremes(rows: DataFrame, k: int = 3) -> DataFrame:
    """The k largest and k smallest differences; ties by id.  Both ends are top-k scans."""
    d = rows.filter("rag IS NOT NULL AND base IS NOT NULL").select("id", (F.col("rag") - F.col("base")).alias("delta"))
    top = d.orderBy(F.desc("delta"), "id").limit(k).withColumn("side", F.lit("top"))
    return top.unionByName(d.orderBy("delta", F.desc("id")).limit(k).withColumn("side", F.lit("bottom")))


def eval_summary(results: DataFrame) -> DataFrame:
    """One row: totals, errors, retrieval means, abstention accuracy, judge means (null where empty)."""
    return results.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("error").isNotNull()).alias("errors"), F.avg("retrieval_metrics.recall_at_k").alias("recall"), F.avg("retrieval_metrics.mrr").alias("mrr"),
        F.avg(F.col("judge_abstention.correct").cast("int")).alias("abstention_accuracy"), F.avg("judge_faithfulness.faithfulness_score").alias("faithfulness"), F.avg("judge_quality.score").alias("quality"),
        F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"),
    )


def rejudged(results: DataFrame, new: DataFrame) -> DataFrame:
    """Results with new faithfulness (id, score, reasoning, perhaps unsupported_claims); should-abstain rows get none, errors and empty answers stay."""
    old = F.col("judge_faithfulness")
    kind = results.schema["judge_faithfulness"].dataType
    none = F.struct(*(F.lit("should abstain").alias(f.name) if f.name == "reason" else F.lit(None).cast(f.dataType).alias(f.name) for f in kind.fields))
    given = {"faithfulness_score": F.col("score"), "reasoning": F.col("reasoning"), "judge": F.lit("faithfulness")} | ({"unsupported_claims": F.col("unsupported_claims")} if "unsupported_claims" in new.columns else {})
    fresh = F.struct(*(given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in kind.fields))
    rows = results.join(new.select("id", fresh.alias("__fresh"), F.lit(True).alias("__new")), "id", "left")
    keep = F.col("answer").isNull() | F.col("error").isNotNull() | F.col("__new").isNull()
    return rows.withColumn("judge_faithfulness", F.when(F.col("should_abstain"), none).when(keep, old).otherwise(F.col("__fresh"))).select(*results.columns)


def placed(rows: DataFrame, order: str, name: str = "place", ranges: int = 64) -> DataFrame:
    """Rows with their place from 0 in the order of a number column, nulls last; rows with equal numbers have places in any order.

    The numbers are cut into ranges at approximate quantiles, at most `ranges` + 1 counts reach the driver, and rows are
    numbered within their range: no task sorts the whole table.
    """
    cuts = list(rows.select(F.percentile_approx(order, [k / ranges for k in range(1, ranges)], 10_000)).first()[0] or [])
    within = sum(((F.col(order) > c).cast("int") for c in sorted(set(cuts))), F.lit(0))
    ranged = rows.withColumn("__range", F.coalesce(within, F.lit(ranges)))
    sizes = {r["__range"]: r["n"] for r in ranged.groupBy("__range").agg(F.count(F.lit(1)).alias("n")).collect()}
    base = {part: sum(n for other, n in sizes.items() if other < part) for part in sizes}
    offset = F.try_element_at(F.create_map(*(F.lit(x).cast("long") for kv in base.items() for x in kv)), F.col("__range").cast("long")) if base else F.lit(0).cast("long")
    return ranged.withColumn(name, F.row_number().over(Window.partitionBy("__range").orderBy(order)) - 1 + offset).drop("__range")


def sample_positions(rows: DataFrame, order: str) -> DataFrame:
    """First, middle and last row by place in the order of a number column, whatever gaps the numbers have."""
    n = rows.count()
    return placed(rows, order, "__place").filter(F.col("__place").isin(sorted({0, n // 2, n - 1}))).drop("__place")


def source_sizes(files: DataFrame, source: str = "source", size: str = "bytes") -> DataFrame:
    """Files and bytes of each source and in total."""
    rows = files.rollup(source).agg(F.count(F.lit(1)).alias("files"), F.sum(size).alias("bytes"), F.grouping(source).alias("g"))
    return rows.select(F.when(F.col("g") == 1, "TOTAL").otherwise(F.col(source)).alias(source), "files", "bytes")


def category_counts(rows: DataFrame, category: str = "category") -> DataFrame:
    return rows.groupBy(category).agg(F.count(F.lit(1)).alias("n"))


def category_means(rows: DataFrame, score: str, category: str = "category") -> DataFrame:
    """Rows, mean score and rows without a score of each category."""
    return rows.groupBy(category).agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean"), F.count_if(F.col(score).isNull()).alias("n_null"))


def category_summary(results: DataFrame) -> DataFrame:
    """Of each category: results, and the means of recall, reciprocal rank, faithfulness and quality over those that have them (null where none has)."""
    return results.groupBy(F.coalesce("category", F.lit("unknown")).alias("category")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("retrieval_metrics.recall_at_k"), 3).alias("recall"), F.round(F.avg("retrieval_metrics.mrr"), 3).alias("mrr"),
        F.round(F.avg("judge_faithfulness.faithfulness_score"), 2).alias("faithfulness"), F.round(F.avg("judge_quality.score"), 2).alias("quality"),
    )


def false_abstentions(rows: DataFrame) -> DataFrame:
    """Rows that should have been answered and weren't."""
    return rows.filter(~F.coalesce("should_abstain", F.lit(False)) & F.coalesce("abstained", F.lit(False)))


def unsupported(rows: DataFrame, claims: str = "unsupported_claims", category: str = "category") -> DataFrame:
    """Of each category the results with claims that nothing supports."""
    return rows.groupBy(category).agg(F.count_if(F.coalesce(F.size(claims) > 0, F.lit(False))).alias("unsupported"))


def rate_window(log: DataFrame, seconds: int = 62, requests: int = 300, tokens: int = 4_000_000) -> DataFrame:
    """Requests and tokens of the window that ends at each row of (key, ts_us, tokens), and whether a limit is broken.

    Where a key has more than its share of the rows, the window is the difference of two running sums, at its ends: a mark
    is set before all rows at its beginning and one behind all rows at its end, and marks and rows are summed in ranges.
    """
    if not crowded(log, ["key"]):
        w = Window.partitionBy("key").orderBy("ts_us").rangeBetween(-seconds * 1_000_000, 0)
        rows = log.withColumns({"n_window": F.count(F.lit(1)).over(w), "tokens_window": F.sum("tokens").over(w)})
    else:
        own = stored(log.withColumn("__id", F.monotonically_increasing_id()), "log")
        mark = lambda at, kind: F.struct(at.cast("long").alias("at"), F.lit(kind).alias("kind"))
        ends = F.explode(F.array(mark(F.col("ts_us") - seconds * 1_000_000, 0), mark(F.col("ts_us"), 1), mark(F.col("ts_us"), 2)))
        points = own.select("__id", "key", "tokens", ends.alias("__m")).select("__id", "key", "__m.at", "__m.kind", "tokens")
        one, own_tokens = (F.when(F.col("kind") == 1, x).otherwise(F.lit(0)) for x in (F.lit(1), F.coalesce("tokens", F.lit(0))))
        summed = running(points, ["key"], ["at", "kind", "__id"], n=one, t=own_tokens).filter("kind <> 1")
        side = F.when(F.col("kind") == 2, 1).otherwise(-1)
        found = summed.groupBy("__id").agg(F.sum(side * F.col("n")).alias("n_window"), F.sum(side * F.col("t")).alias("tokens_window"))
        rows = own.join(found, "__id").drop("__id")
    return rows.withColumn("breach", (F.col("n_window") > requests) | (F.col("tokens_window") > tokens))
