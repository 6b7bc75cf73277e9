"""The corpus pipeline: quality rules, line dedup, near duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept; the columns stay
those of documents until the last.  An empty table gives an empty table in every stage; columns named as an
operator's own are kept untouched; very long texts are worked on whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomcorpus.llm import line_dedup, mixing, ngram_join, packing, quality_rules
from loomcorpus.llm.common import table, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that policy v2-full keeps.

    Null and empty texts have no words, so they go; repeated rows share their verdict; null ids and labels are no matter.
    """
    return quality_rules.filter_documents(docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that stand in an earlier one (smaller id, then place); those left without a word go.

    n_chars follows the text.  Null texts stay; rows equal in id and text are one document and keep or lose a passage
    together; a null id comes before all others.
    """
    return line_dedup.remove_repeats(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents, that with the smallest id.

    The contract of near-duplicate stages on word shingles: five words and a similarity of 0.8.  Texts without a word
    are linked with nothing and stay; rows with the kept id stay all, for an id names one document.
    """
    return ngram_join.keep_one(docs, params=ngram_join.Params(n=5, percent=80))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents thinned out by their fitted rates: none is repeated, so what is rare stays rare.

    A rate is a chance that a draw from id and text settles, so repeated rows stay or go together.  Null and empty texts
    have no tokens and the rate of their posterior.  Labels that are null, repeated or of no document are passed over.
    """
    return mixing.mix(docs, table(spark, sf_dir, "labels"), mixing.Params(most_rate=1.0))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Power-of-two pieces of the documents; a null or empty text is the one piece of its end token."""
    return packing.op3_packing(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("near_duplicates", near_duplicate_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Line chunks and tokens aside, the rates come from an iteration and the ids from a tokenizer: no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result but the last is a written table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
