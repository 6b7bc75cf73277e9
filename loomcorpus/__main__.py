"""Commands: ingest sections into an index, ask it, evaluate questions, judge results anew."""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomcorpus.functions import text as T
from loomcorpus.ledger import Ledger
from loomcorpus.operators import index, report, retrieve
from loomcorpus.plans import evaluate
from loomcorpus.providers import completed, embedded, overlap_judge
from loomcorpus.sources import results, rst
from loomcorpus.sources.shared import stored
from loomcorpus.streaming.ingest import STREAMED, ingest_stream


def _ingest(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Section files as chunks with vectors; those that an earlier run has taken up aren't read again.  RST files are delivered anew, as wholes."""
    if a.rst:
        rows = rst.read_rst(spark, a.rst).withColumns({"doc_ord": F.col("doc_ord.section_no").cast("long"), "delivery": F.lit(int(time.time()))})
        rows.select(*(c.split()[0] for c in STREAMED.split(", "))).write.mode("append").parquet(a.sections)
    ingest_stream(spark, a.sections, a.index, a.checkpoint or f"{a.index}-checkpoint", most=a.max_tokens, overlap=a.overlap).awaitTermination()
    return report.corpus_table(index.read(spark, a.index).select("source_type", "source_name", "token_count"))


def _query(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    asks = stored(embedded(spark.createDataFrame([(0, a.question)], "query_id int, text string"), input_type="query"), "asks")
    chunks = retrieve.source_filter(index.read(spark, a.index), "source_type", a.source_type)
    hits = stored(retrieve.hit_rows(retrieve.topk(chunks, asks, a.k), chunks), "hits")
    if not a.answer:
        return hits.select("rank", F.round("score", 4).alias("score"), "source_type", "source_name", "section_path", T.preview(F.col("text"), 200).alias("preview")).orderBy("rank")
    block = retrieve.context(hits)
    prompt = F.concat(F.lit(evaluate.ANSWER_RULES), F.lit("\n\n"), F.col("context"), F.lit(f"\n\n---\n\nQuestion: {a.question}")).alias("prompt")
    return completed(block.select("query_id", prompt)).select("answer", T.citations(F.col("answer")).alias("citations_used"), T.abstained(F.col("answer")).alias("abstained"))


def _evaluate(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Questions without a result are run and added to the results."""
    asked = results.read_questions(spark, a.questions)
    if a.resume:
        asked = index.remaining(asked, results.read_results(spark, a.results), a.retry_errors)
    rows = evaluate.run(asked, index.read(spark, a.index), a.k, judge_call=overlap_judge, ledger=Ledger(a.ledger) if a.ledger else None)
    kind = spark.createDataFrame([], results.RESULT)
    results.write_results(kind.unionByName(rows.select(*(c for c in rows.columns if c in kind.columns)), allowMissingColumns=True), a.results, append=a.resume)
    return report.eval_summary(results.read_results(spark, a.results))


def _rejudge(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    rows = evaluate.rejudge(results.read_results(spark, a.results), index.read(spark, a.index), overlap_judge, ledger=Ledger(a.ledger) if a.ledger else None)
    results.write_results(rows, a.results, append=False)
    return report.eval_summary(results.read_results(spark, a.results))


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="loomcorpus", description=__doc__)
    own = p.add_subparsers(dest="command", required=True)
    c = own.add_parser("ingest")
    c.set_defaults(run=_ingest)
    c.add_argument("sections", help="folder of sections in Parquet")
    c.add_argument("--rst", help="RST files that are added to it first")
    c.add_argument("--checkpoint")
    c.add_argument("--max-tokens", type=int, default=1500)
    c.add_argument("--overlap", type=int, default=100)
    c = own.add_parser("query")
    c.set_defaults(run=_query)
    c.add_argument("question")
    c.add_argument("-k", type=int, default=5)
    c.add_argument("--source-type", nargs="*")
    c.add_argument("--answer", action="store_true")
    c = own.add_parser("evaluate")
    c.set_defaults(run=_evaluate)
    c.add_argument("questions", help="YAML file")
    c.add_argument("results")
    c.add_argument("-k", type=int, default=10)
    c.add_argument("--resume", action="store_true", help="only questions without a result")
    c.add_argument("--retry-errors", action="store_true")
    c.add_argument("--ledger")
    c = own.add_parser("rejudge")
    c.set_defaults(run=_rejudge)
    c.add_argument("results")
    c.add_argument("--ledger")
    for c in own.choices.values():
        c.add_argument("--index", required=True)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("loomcorpus").getOrCreate()
    a.run(spark, a).show(50, truncate=120)
    return 0


if __name__ == "__main__":
    sys.exit(main())
