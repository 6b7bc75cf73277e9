"""Golden questions and evaluation results, with fixed schemas."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from loomcorpus.sources import snapshots

QUESTION = "id string, category string, question string, ground_truth_chunk_ids array<string>, reference_answer string, should_abstain boolean, notes string"
RESULT = (
    "id string, category string, question string, should_abstain boolean, ground_truth_chunk_ids array<string>, error string, retrieved_chunk_ids array<string>, top_scores array<double>, "
    "retrieval_metrics struct<recall_at_k: double, mrr: double, k: int, num_relevant: int>, answer string, abstained boolean, citations_used array<int>, model string, input_tokens bigint, output_tokens bigint, "
    "judge_abstention struct<correct: boolean, label: string, reason: string, judge: string, should_abstain: boolean, system_abstained: boolean, error: string>, "
    "judge_faithfulness struct<judge: string, faithfulness_score: double, unsupported_claims: array<string>, reasoning: string, reason: string, raw: string, error: string>, "
    "judge_quality struct<score: int, reason: string, judge: string, error: string, raw: string>, no_rag_answer string, no_rag_quality struct<score: int, reason: string, judge: string, error: string, raw: string>"
)


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """Questions of a YAML file; the list is small and read by the driver."""
    import yaml

    text = "\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())
    data = yaml.safe_load(text) or []
    rows = data.get("questions", []) if isinstance(data, dict) else data
    names = [c.split()[0] for c in QUESTION.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) if n not in ("should_abstain", "ground_truth_chunk_ids") else (bool(r.get(n)) if n == "should_abstain" else list(r.get(n) or [])) for n in names) for r in rows], QUESTION)


def write_questions(questions: DataFrame, path: str, width: int = 120) -> None:
    """Questions as a YAML file of the driver, in order of id; the list is small.  Strings are quoted, unset fields left out."""
    import yaml

    class Quoted(yaml.SafeDumper):
        def increase_indent(self, flow=False, indentless=False):
            return super().increase_indent(flow, False)

    Quoted.add_representer(str, lambda d, s: d.represent_scalar("tag:yaml.org,2002:str", s, style="|" if "\n" in s else '"'))
    Quoted.add_representer(Key, lambda d, s: d.represent_scalar("tag:yaml.org,2002:str", str(s)))
    names = [c.split()[0] for c in QUESTION.split(", ") if c.split()[0] in questions.columns]
    rows = [{n: r[n] for n in names if r[n] is not None} for r in questions.select(*names).orderBy("id").collect()]
    plain = [{Key(k): v for k, v in r.items()} for r in rows]
    text = yaml.dump(plain, Dumper=Quoted, width=width, sort_keys=False, allow_unicode=True, default_flow_style=False)
    part = Path(f"{path}.part")
    part.write_text(text, encoding="utf-8")
    part.replace(path)


class Key(str):
    """A key: written without quotation marks."""


def read_results(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """Result lines; malformed ones and those without an id are passed over, or fail if strict.

    A path that write_results wrote is read as its newest snapshot has it; any other is a file or folder of lines.
    """
    here = snapshots.newest(spark, path)
    rows = spark.read.schema(RESULT).json(snapshots.full_paths(path, here) if here.number else path, mode="FAILFAST" if strict else "DROPMALFORMED")
    return rows if strict else rows.filter("id IS NOT NULL")


def write_results(df: DataFrame, path: str, append: bool = True, tries: int = 20) -> None:
    """Add rows to the results in a folder, or put them in place of what is there, which they may be read from.

    The rows are written beside what is there and a snapshot names them, so that readers see all or nothing of it, and a
    writer that is killed changes nothing.  Of two writers that rewrite at once one fails with Conflict, and so does one whose
    rows come from an older snapshot; its folder is deleted.  Appending writers take turns.  A folder of plain lines becomes
    the first snapshot.
    """
    spark = df.sparkSession
    base = snapshots.newest(spark, path)
    if not base.number:
        base = snapshots.Snapshot(0, {name: {} for name in snapshots.files(spark, path)})
    read = snapshots.read_from(df, path)
    filled = {name for name, note in base.entries.items() if note.get("files")}
    if not append and read and not filled <= read <= base.entries.keys():
        raise snapshots.Conflict(f"{path}: the rows come from another snapshot than the newest")
    folder = snapshots.new_folder()
    try:
        df.write.json(f"{path}/{folder}")
        own = {folder: {"files": len(snapshots.files(spark, f"{path}/{folder}"))}}
        for left in reversed(range(tries)):
            try:
                snapshots.commit(spark, path, base, base.entries | own if append else own)
                return
            except snapshots.Conflict:
                if not append or not left:
                    raise
                base = snapshots.newest(spark, path)
    except BaseException:
        snapshots.remove(spark, path, folder)
        raise
