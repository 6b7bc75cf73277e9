"""Labelling of golden questions: what to label, what a labeller saw, what their answers change."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomcorpus.functions.text import parse_ranks, preview

ABSTAIN_CATEGORY = "should_abstain"
ABSTAIN_NOTE = "[reclassified as should_abstain during labeling]"
RULE = "=" * 64


def candidates(questions: DataFrame) -> DataFrame:
    """Questions that expect an answer and have no truth."""
    none = F.col("ground_truth_chunk_ids").isNull() | (F.size("ground_truth_chunk_ids") == 0)
    return questions.filter(~F.coalesce("should_abstain", F.lit(False)) & none)


def labelled(questions: DataFrame, hits: DataFrame, replies: DataFrame) -> DataFrame:
    """Questions with the replies (id, reply) applied; hits (query_id, rank, chunk_id) are what the labeller saw.

    "1,3" takes the ids at these ranks, repeats included; "n" makes the question one to abstain from; "s",
    anything without a rank, and replies with a rank out of bounds change nothing.
    """
    seen = hits.groupBy(F.col("query_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))).alias("__seen"))
    rows = questions.join(seen, "id", "left").join(replies.select("id", F.lower(F.trim("reply")).alias("__reply")), "id", "left")
    ids = F.coalesce(F.transform("__seen", lambda h: h["chunk_id"]), F.array().cast("array<string>"))
    asked = F.filter(F.transform(F.split("__reply", ","), lambda x: F.trim(x)), lambda x: x.rlike(r"^\d+$"))
    picked = parse_ranks(F.col("__reply"), ids)
    whole = (F.size(picked) > 0) & (F.size(picked) == F.size(asked))
    declined = F.coalesce(F.col("__reply") == "n", F.lit(False))
    return rows.withColumns({
        "ground_truth_chunk_ids": F.when(declined, F.array().cast("array<string>")).when(whole, picked).otherwise(F.col("ground_truth_chunk_ids")),
        "should_abstain": F.when(declined, True).otherwise(F.col("should_abstain")),
        "category": F.when(declined, ABSTAIN_CATEGORY).otherwise(F.col("category")),
        "notes": F.when(declined, F.trim(F.concat(F.coalesce("notes", F.lit("")), F.lit(f" {ABSTAIN_NOTE}")))).otherwise(F.col("notes")),
    }).select(*questions.columns)


def status(questions: DataFrame) -> DataFrame:
    """One row: total, with truth, to abstain from, and the rest."""
    has, ab = F.coalesce(F.size("ground_truth_chunk_ids") > 0, F.lit(False)), F.coalesce("should_abstain", F.lit(False))
    one = questions.agg(F.count(F.lit(1)).alias("total"), F.count_if(has).alias("labelled"), F.count_if(ab).alias("abstain"))
    return one.withColumn("unlabelled", F.col("total") - F.col("labelled") - F.col("abstain"))


def dump(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """(id, value): for each question the text that a labeller reads; written by write.text, one file part a task."""
    line = F.concat(
        F.lit("["), F.col("rank").cast("string"), F.lit("] score="), F.format_number("score", 3), F.lit(" type="), F.col("source_type"), F.lit(" source="), F.col("source_name"),
        F.lit("\n    Section: "), F.col("section_path"), F.lit("\n    Chunk ID: "), F.col("chunk_id").cast("string"), F.lit("\n    Preview: "), preview(F.col("text"), 400), F.lit("\n"),
    )
    per = hits.groupBy(F.col("query_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("lines"))
    notes = F.when(F.coalesce("notes", F.lit("")) != "", F.concat(F.lit("\nNOTES: "), F.col("notes"))).otherwise(F.lit(""))
    head = F.concat(F.lit(f"{RULE}\nQUESTION ID: "), F.col("id"), F.lit("\nCATEGORY: "), F.coalesce("category", F.lit("")), F.lit("\nQUESTION: "), F.coalesce("question", F.lit("")), notes, F.lit("\n\nRETRIEVED CHUNKS:\n"))
    body = F.coalesce(F.array_join(F.transform("lines", lambda x: x["line"]), "\n"), F.lit(""))
    return questions.join(per, "id", "left").select("id", F.concat(head, body, F.lit(f"{RULE}\n")).alias("value"))
