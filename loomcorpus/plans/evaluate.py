"""The evaluation of a question set: retrieval, metrics, answers, judges; the ablation; judging anew.

Question-sized frames that several steps read are written to the shared folder, so a provider is asked once for each
row.  With a ledger, no reply is asked for twice, by later runs either.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomcorpus.functions import text as T
from loomcorpus.ledger import Ledger, embedded_once
from loomcorpus.operators import judge, metrics, report, retrieve
from loomcorpus.providers import Budget, HashEmbedder, embedded, extractive_answer
from loomcorpus.sources.shared import stored

#: What a model is told.
ANSWER_RULES = "Answer from the numbered context alone and cite it as [n]. If it does not contain enough information, say so."
PLAIN_RULES = "Answer the question from what you know, in a few sentences."


def retrieved(questions: DataFrame, chunks: DataFrame, k: int = 10, embedder: Callable = HashEmbedder(), budget: Budget | None = None, ledger: Ledger | None = None, texts_of: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Questions with error, retrieved_chunk_ids, top_scores and retrieval_metrics; and the hits.  chunks: with embedding.

    texts_of: the chunks before they were embedded, where that isn't stored: else they are embedded again for their texts.

    A question that the provider can't embed has an error and no hits.
    """
    texts = questions.select(F.col("id").alias("query_id"), F.col("question").alias("text"))
    asks = stored(embedded_once(texts, embedder, ledger, "embedder", "query", budget=budget) if ledger else embedded(texts, embedder, "query", contain=True, budget=budget), "asks")
    found = stored(retrieve.topk(chunks, asks, k), "found")
    hit = (chunks if texts_of is None else texts_of).join(found.select("chunk_id").distinct(), "chunk_id", "left_semi")  # the texts of others aren't shuffled
    hits = stored(retrieve.hit_rows(found, hit), "hits")
    lists = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "score"))).alias("l"))
    lists = lists.select(F.col("query_id").alias("id"), F.transform("l", lambda x: x["chunk_id"]).alias("retrieved_chunk_ids"), F.transform("l", lambda x: F.round(x["score"], 4)).alias("top_scores"))
    counted = questions.filter(~F.coalesce("should_abstain", F.lit(False)) & (F.size("ground_truth_chunk_ids") > 0))
    truth = counted.select(F.col("id").alias("query_id"), F.explode("ground_truth_chunk_ids").alias("chunk_id"))
    found = metrics.per_query(hits, truth, counted.select(F.col("id").alias("query_id")), k)
    found = found.select(F.col("query_id").alias("id"), F.struct("recall_at_k", "mrr", "k", F.col("num_relevant").cast("int").alias("num_relevant")).alias("retrieval_metrics"))
    failed = asks.select(F.col("query_id").alias("id"), F.concat(F.lit("retrieval: "), F.col("embed_error")).alias("error"))
    rows = questions.join(failed, "id", "left").join(lists, "id", "left").join(found, "id", "left")
    return rows.withColumn("retrieval_metrics", F.when(F.col("error").isNull(), F.col("retrieval_metrics"))), hits


def answered(rows: DataFrame, hits: DataFrame, complete: Callable[[str], str] = extractive_answer, model: str = "offline", budget: Budget | None = None, ledger: Ledger | None = None) -> DataFrame:
    """Rows with answer, abstained, citations_used, model and tokens; a failed call is an error of its row."""
    block = retrieve.context(hits).withColumnRenamed("query_id", "id")
    prompt = F.concat(F.lit(ANSWER_RULES), F.lit("\n\n"), F.coalesce("context", F.lit("")), F.lit("\n\n---\n\nQuestion: "), F.coalesce("question", F.lit("")))
    asks = rows.join(block, "id", "left").withColumn("prompt", F.when(F.col("error").isNull(), prompt)).drop("context")
    out = judge.asked(asks, complete, budget, ledger, model, answer=F.col("prompt"))
    fine, a = F.col("answer_raw").isNotNull(), F.col("answer_raw")
    return out.select(
        *(c for c in rows.columns if c != "error"), F.coalesce("error", F.concat(F.lit("generation: "), F.col("answer_error"))).alias("error"), a.alias("answer"), F.when(fine, T.abstained(a)).alias("abstained"), F.when(fine, T.citations(a)).alias("citations_used"),
        F.when(fine, model).alias("model"), F.when(fine, T.token_count(F.col("prompt"))).cast("long").alias("input_tokens"), F.when(fine, T.token_count(a)).cast("long").alias("output_tokens"),
    )


def judged(rows: DataFrame, hits: DataFrame, complete: Callable[[str], str], budget: Budget | None = None, ledger: Ledger | None = None) -> DataFrame:
    """Rows with judge_abstention (wherever there is an answer), judge_faithfulness and judge_quality (where both flags are false)."""
    q, a, did, should = F.col("question"), F.col("answer"), F.col("abstained"), F.coalesce("should_abstain", F.lit(False))
    has, gate = F.col("answer").isNotNull(), judge.gate(should, did)
    out = judge.asked(
        rows.join(judge.passages(hits), "id", "left"), complete, budget, ledger,
        a=F.when(has, judge.abstention_prompt(q, a, did, should)), f=F.when(gate, judge.faithfulness_prompt(F.col("whole"), a)), q=F.when(gate, judge.quality_prompt(q, F.col("short"), a)),
    )
    return out.select(
        *rows.columns,
        F.when(has, judge.abstention(F.col("a_raw"), F.col("a_error"), did, should)).alias("judge_abstention"),
        F.when(gate, judge.faithfulness(F.col("f_raw"), F.col("f_error"))).alias("judge_faithfulness"),
        F.when(gate, judge.quality(F.col("q_raw"), F.col("q_error"))).alias("judge_quality"),
    )


def run(questions: DataFrame, chunks: DataFrame, k: int = 10, embedder: Callable = HashEmbedder(), complete: Callable[[str], str] = extractive_answer, judge_call: Callable[[str], str] | None = None, generate: bool = True, budget: Budget | None = None, embed_budget: Budget | None = None, ledger: Ledger | None = None, texts_of: DataFrame | None = None) -> DataFrame:
    """One result row for each question; without `generate` only retrieval, without `judge_call` no judges.

    budget holds for answers and judges, embed_budget for the embedding of questions.
    """
    rows, hits = retrieved(questions, chunks, k, embedder, embed_budget, ledger, texts_of)
    if not generate:
        return rows
    rows = stored(answered(rows, hits, complete, budget=budget, ledger=ledger), "answers")
    return rows if judge_call is None else judged(rows, hits, judge_call, budget, ledger)


def pending_ablation(results: DataFrame) -> DataFrame:
    """Results that expect an answer and have none without retrieval."""
    rows = results.filter(~F.coalesce("should_abstain", F.lit(False)))
    return rows.filter("no_rag_answer IS NULL") if "no_rag_answer" in results.columns else rows


def ablated(results: DataFrame, complete: Callable[[str], str], judge_call: Callable[[str], str], budget: Budget | None = None, ledger: Ledger | None = None) -> DataFrame:
    """Results with no_rag_answer and no_rag_quality; those that have them, or expect none, stay as they are.

    A failed call leaves the row pending; a failed judge is an error of the score.
    """
    for c, kind in (("no_rag_answer", "string"), ("no_rag_quality", judge.QUALITY)):
        if c not in results.columns:
            results = results.withColumn(c, F.lit(None).cast(kind))
    own = results.columns
    plain = F.concat(F.lit(PLAIN_RULES), F.lit("\n\nQuestion: "), F.coalesce("question", F.lit("")))
    due = ~F.coalesce("should_abstain", F.lit(False)) & F.col("no_rag_answer").isNull()
    rows = stored(judge.asked(results, complete, budget, ledger, "plain", plain=F.when(due, plain)), "plain")
    rows = judge.asked(rows, judge_call, budget, ledger, score=F.when(F.col("plain_raw").isNotNull(), judge.quality_prompt(F.col("question"), F.lit(""), F.col("plain_raw"))))
    new = F.when(F.col("plain_raw").isNotNull(), judge.quality(F.col("score_raw"), F.col("score_error")))
    return rows.withColumns({"no_rag_answer": F.coalesce("no_rag_answer", "plain_raw"), "no_rag_quality": F.coalesce("no_rag_quality", new)}).select(*own)


def rejudge(results: DataFrame, chunks: DataFrame, complete: Callable[[str], str], budget: Budget | None = None, ledger: Ledger | None = None) -> DataFrame:
    """Results with faithfulness judged anew from the stored ids of what was retrieved; no search is repeated."""
    hits = results.select(F.col("id").alias("query_id"), F.posexplode("retrieved_chunk_ids").alias("rank", "chunk_id")).withColumn("rank", F.col("rank") + 1).withColumn("score", F.lit(None).cast("double"))
    text = judge.passages(retrieve.hit_rows(hits, chunks)).select("id", "whole")
    due = results.filter(~F.coalesce("should_abstain", F.lit(False)) & F.col("answer").isNotNull() & F.col("error").isNull()).select("id", "answer").join(text, "id", "left")
    got = judge.asked(due, complete, budget, ledger, f=judge.faithfulness_prompt(F.col("whole"), F.col("answer"))).select("id", judge.faithfulness(F.col("f_raw"), F.col("f_error")).alias("f"))
    new = got.select("id", F.col("f.faithfulness_score").alias("score"), F.coalesce("f.reasoning", "f.error").alias("reasoning"), F.col("f.unsupported_claims").alias("unsupported_claims"))
    return report.rejudged(results, new)
