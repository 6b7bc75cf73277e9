"""Snapshots of results: rewriting what was read, killed writers, writers at once."""

from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from loomcorpus.plans import evaluate
from loomcorpus.providers import overlap_judge
from loomcorpus.sources import snapshots
from loomcorpus.sources.results import RESULT, read_results, write_results


def some(spark, n, start=0):
    rows = spark.range(start, start + n).select(F.col("id").cast("string"), F.lit("what?").alias("question"), F.lit("a b c").alias("answer"), F.lit(False).alias("should_abstain"), F.array(F.lit("c1")).alias("retrieved_chunk_ids"))
    return spark.createDataFrame([], RESULT).unionByName(rows, allowMissingColumns=True)


def test_rewriting_what_was_read_keeps_all_rows(spark, tmp_path):
    path = str(tmp_path / "results")
    write_results(some(spark, 20), path)
    write_results(some(spark, 5, 20), path)
    chunks = spark.createDataFrame([("c1", "a b c", "docs", "s", "p", "o")], "chunk_id string, text string, source_type string, source_name string, section_path string, original_path string")
    write_results(evaluate.rejudge(read_results(spark, path), chunks, overlap_judge), path, append=False)
    got = read_results(spark, path)
    assert sorted(int(r["id"]) for r in got.collect()) == list(range(25))
    assert got.filter("judge_faithfulness.faithfulness_score = 1.0").count() == 25
    write_results(got.filter("id < 3"), path, append=False)
    assert read_results(spark, path).count() == 3
    write_results(read_results(spark, path).limit(0), path, append=False)
    write_results(read_results(spark, path), path, append=False)
    assert read_results(spark, path).count() == 0
    write_results(some(spark, 2), path)
    write_results(read_results(spark, path), path, append=False)
    assert read_results(spark, path).count() == 2


def test_killed_writer_changes_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "results")
    write_results(some(spark, 4), path)
    with monkeypatch.context() as m:
        m.setattr(snapshots, "commit", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt))
        m.setattr(snapshots, "remove", lambda *a: None)  # a killed process doesn't tidy up
        with pytest.raises(KeyboardInterrupt):
            write_results(read_results(spark, path).filter("id = 0"), path, append=False)
    assert read_results(spark, path).count() == 4
    assert len(list((tmp_path / "results").glob("data-*"))) == 2
    assert snapshots.expire(spark, path, older_than_s=3600) == 0
    assert snapshots.expire(spark, path, older_than_s=-60) == 1
    assert read_results(spark, path).count() == 4
    boom = some(spark, 3).withColumn("answer", F.when(F.col("id") == "2", F.raise_error(F.lit("lost"))).otherwise(F.col("answer")))
    with pytest.raises(Exception, match="lost"):
        write_results(boom, path)
    assert read_results(spark, path).count() == 4 and len(list((tmp_path / "results").glob("data-*"))) == 1


def test_of_two_rewrites_one_fails_and_appends_take_turns(spark, tmp_path):
    path = str(tmp_path / "results")
    write_results(some(spark, 4), path)
    old = read_results(spark, path)
    write_results(some(spark, 1, 4), path)
    with pytest.raises(snapshots.Conflict, match="another snapshot"):
        write_results(old, path, append=False)
    base = snapshots.newest(spark, path)
    snapshots.commit(spark, path, base, base.entries)
    with pytest.raises(snapshots.Conflict, match="another writer"):
        snapshots.commit(spark, path, base, {})
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda i: write_results(some(spark, 1, 10 + i), path), range(4)))
    assert read_results(spark, path).count() == 9
    got = []
    with ThreadPoolExecutor(2) as pool:
        for f in [pool.submit(write_results, read_results(spark, path).limit(k), path, False) for k in (2, 3)]:
            try:
                got.append(f.result())
            except snapshots.Conflict:
                got.append("lost")
    assert got.count("lost") <= 1 and read_results(spark, path).count() in (2, 3)
    assert len([p for p in (tmp_path / "results").glob("_snapshots/.*")]) == 0


def test_plain_lines_become_the_first_snapshot(spark, tmp_path):
    folder = tmp_path / "results"
    folder.mkdir()
    (folder / "r.jsonl").write_text('{"id": "a", "answer": "x"}\nbroken\n')
    path = f"file://{folder}"
    assert read_results(spark, path).count() == 1
    write_results(some(spark, 1), path)
    assert sorted(r["id"] for r in read_results(spark, path).collect()) == ["0", "a"]
    write_results(read_results(spark, path), path, append=False)
    assert sorted(r["id"] for r in read_results(spark, path).collect()) == ["0", "a"]
    with pytest.raises(ValueError, match="is a file"):
        write_results(some(spark, 1), f"{path}/r.jsonl")
