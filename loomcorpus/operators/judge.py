"""Judges: prompts for a completion provider, and its replies as typed structs.

A reply is parsed inside the JVM; what a provider couldn't answer or what doesn't parse is a value of
the struct, never a failed task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from loomcorpus.functions.text import bound, faith_score, judge_json
from loomcorpus.ledger import Ledger, with_replies
from loomcorpus.providers import Budget, answer

FAITHFULNESS = "struct<judge: string, faithfulness_score: double, unsupported_claims: array<string>, reasoning: string, reason: string, raw: string, error: string>"
QUALITY = "struct<score: int, reason: string, judge: string, error: string, raw: string>"
ABSTENTION = "struct<correct: boolean, label: string, reason: string, judge: string, should_abstain: boolean, system_abstained: boolean, error: string>"

FAITHFULNESS_RULES = (
    "Check each factual statement of the answer against the numbered passages. Reply with one JSON object and nothing else, with the keys faithfulness_score, unsupported_claims and reasoning. "
    "faithfulness_score is 1.0 if the passages support all statements, 0.5 if one or two go a little beyond them, 0.0 if important ones have no support. unsupported_claims lists the statements without support."
)
QUALITY_RULES = (
    "Judge how correct, complete and clear the answer is, by what the given passages allow. Reply with one JSON object and nothing else, with the keys score and reason. "
    "score is an integer from 1, no usable answer, to 5, accurate and complete."
)
ABSTENTION_RULES = "Say whether the system answered the question or declined, and whether that was right. Reply with one JSON object and nothing else, with the keys correct, label (answered or abstained) and reason."
QUALITY_CHARS = 400  # of each passage


def passages(hits: DataFrame) -> DataFrame:
    """(id, whole, short): a query's numbered hits in rank order, with all of their text and with its beginning; k hits at most."""

    def block(body: Column) -> Column:
        return F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.col("source_name"), F.lit(" | "), F.col("section_path"), F.lit("\n"), body)

    cut = F.struct("rank", block(F.col("text")).alias("whole"), block(F.left("text", F.lit(QUALITY_CHARS))).alias("short"))
    rows = hits.groupBy(F.col("query_id").alias("id")).agg(F.array_sort(F.collect_list(cut)).alias("b"))
    return rows.select("id", *(F.array_join(f"b.{n}", "\n\n").alias(n) for n in ("whole", "short")))


def _part(title: str, value: Column) -> Column:
    return F.concat(F.lit(f"\n\n{title}:\n"), F.coalesce(value, F.lit("")))


def faithfulness_prompt(text: Column, answer: Column) -> Column:
    """Whole passages and the answer; the question plays no part."""
    return F.concat(F.lit(FAITHFULNESS_RULES), _part("PASSAGES", text), _part("ANSWER", answer))


def quality_prompt(question: Column, text: Column, answer: Column) -> Column:
    return F.concat(F.lit(QUALITY_RULES), _part("QUESTION", question), _part("PASSAGES", text), _part("ANSWER", answer))


def abstention_prompt(question: Column, answer: Column, abstained: Column, expected: Column) -> Column:
    told = F.when(expected, "decline").otherwise("answer")
    return F.concat(F.lit(ABSTENTION_RULES), _part("QUESTION", question), _part("EXPECTED", told), _part("ANSWER", answer), _part("DECLINED", F.when(abstained, "yes").otherwise("no")))


def _object(raw: Column, body: Callable[[Column], Column]) -> Column:
    """body of the reply's JSON object without an error of its own; of null if there is none."""
    fine = lambda v: F.when(F.schema_of_variant(v).startswith("OBJECT") & F.try_variant_get(v, "$.error", "string").isNull(), v)
    return bound(judge_json(raw), lambda v: bound(fine(v), body))


def _typed(kind: str, **fields: Column) -> Column:
    names = [f.split(":")[0].strip() for f in kind.removeprefix("struct<").removesuffix(">").replace("array<string>", "array").split(",")]
    return F.struct(*(fields.get(n, F.lit(None)).alias(n) for n in names)).cast(kind)


def _raised(kind: str, judge: str, error: Column) -> Column:
    return _typed(kind, judge=F.lit(judge), error=error)


def faithfulness(raw: Column, error: Column) -> Column:
    """The reply as FAITHFULNESS: a score of 0, 0.5 or 1; null with reasoning "parse_error" if nothing parses."""
    none = F.expr("cast(array() as array<string>)")

    def read(v: Column) -> Column:
        claims = F.coalesce(F.try_variant_get(v, "$.unsupported_claims", "array<string>"), none)
        fine = _typed(FAITHFULNESS, judge=F.lit("faithfulness"), faithfulness_score=bound(F.try_variant_get(v, "$.faithfulness_score", "double"), faith_score), unsupported_claims=claims, reasoning=F.coalesce(F.try_variant_get(v, "$.reasoning", "string"), F.lit("")))
        bad = _typed(FAITHFULNESS, judge=F.lit("faithfulness"), unsupported_claims=none, reasoning=F.lit("parse_error"), raw=F.left(raw, F.lit(300)))
        return F.when(error.isNotNull(), _raised(FAITHFULNESS, "faithfulness", error)).when(v.isNull(), bad).otherwise(fine)

    return _object(raw, read)


def quality(raw: Column, error: Column) -> Column:
    """The reply as QUALITY; error "parse_failed" and the first 200 characters if nothing parses."""

    def read(v: Column) -> Column:
        fine = _typed(QUALITY, score=F.try_variant_get(v, "$.score", "int"), reason=F.try_variant_get(v, "$.reason", "string"), judge=F.lit("answer_quality"))
        bad = _typed(QUALITY, judge=F.lit("answer_quality"), error=F.lit("parse_failed"), raw=F.left(raw, F.lit(200)))
        return F.when(error.isNotNull(), _raised(QUALITY, "answer_quality", error)).when(v.isNull(), bad).otherwise(fine)

    return _object(raw, read)


def abstention(raw: Column, error: Column, abstained: Column, expected: Column) -> Column:
    """The reply as ABSTENTION; whether the system was right follows from the two flags, not from the judge."""

    def read(v: Column) -> Column:
        failed = F.when(error.isNotNull(), error).when(v.isNull(), "parse_failed")
        return _typed(ABSTENTION, correct=abstained == expected, label=F.try_variant_get(v, "$.label", "string"), reason=F.try_variant_get(v, "$.reason", "string"), judge=F.lit("abstention"), should_abstain=expected, system_abstained=abstained, error=failed)

    return _object(raw, read)


def gate(expected: Column, abstained: Column) -> Column:
    """Whether faithfulness and quality are judged: the system should answer, and did."""
    return F.coalesce(~expected & ~abstained, F.lit(False))


def asked(rows: DataFrame, complete: Callable[[str], str], budget: Budget | None = None, ledger: Ledger | None = None, model: str = "judge", **prompts: Column) -> DataFrame:
    """Rows with the provider's replies to their prompts, <name>_raw and <name>_error; a null prompt isn't sent.

    One map over the rows, whatever the number of prompts: nothing is joined.  With a ledger, replies of the model that it
    holds are taken from there, and each distinct prompt is asked once.
    """
    if ledger:
        return with_replies(rows, complete, ledger, model, budget, **prompts)
    width, names = len(rows.columns), list(prompts)
    sent = rows.select("*", *(c.cast("string").alias(f"{n}_prompt") for n, c in prompts.items()))
    out = StructType([*rows.schema.fields, *(StructField(f"{n}_{x}", StringType()) for n in names for x in ("raw", "error"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            more = []
            for i in range(len(names)):
                got = [(None, None) if p is None else answer(complete, p, budget) for p in batch.column(width + i).to_pylist()]
                more += [pa.array([x[j] for x in got], pa.string()) for j in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], *more], names=out.names)

    return sent.mapInArrow(run, out)


def score_text(result: Column) -> Column:
    """The faithfulness score of a stored result for an audit: none, the score, or ? where it is null."""
    return F.when(result.isNull(), "none").otherwise(F.coalesce(result["faithfulness_score"].cast("string"), F.lit("?")))
