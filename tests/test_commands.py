"""The commands, one after the other, on a few files."""

from loomcorpus.__main__ import main
from loomcorpus.operators import index
from loomcorpus.sources.results import read_results

PAGE = "Title\n=====\n\nThe estimator is robust. It needs two models.\n\nPart\n----\n\nLearners are trained on folds.\n"


def test_ingest_query_evaluate_rejudge(spark, tmp_path, capsys):
    docs, at = tmp_path / "docs", ["--index", str(tmp_path / "index")]
    docs.mkdir()
    (docs / "a.rst").write_text(PAGE)
    (docs / "b.rst").write_text("Other\n=====\n\nNothing of it.\n")
    ingest = ["ingest", str(tmp_path / "sections"), "--rst", str(docs), *at]
    assert main(ingest, spark) == 0
    assert "TOTAL" in capsys.readouterr().out and index.read(spark, at[1]).count() == 3
    main(["query", "which learners are trained on folds?", "-k", "2", *at], spark)
    assert "Learners are trained on folds." in capsys.readouterr().out
    main(["query", "which learners are trained on folds?", "--answer", *at], spark)
    assert "[1]" in capsys.readouterr().out
    (tmp_path / "q.yaml").write_text('questions:\n  - id: "q1"\n    category: "c"\n    question: "which learners are trained on folds?"\n  - id: "q2"\n    category: "c"\n    question: "is the estimator robust?"\n')
    out, ledger = str(tmp_path / "results"), ["--ledger", str(tmp_path / "ledger")]
    main(["evaluate", str(tmp_path / "q.yaml"), out, *ledger, *at], spark)
    main(["evaluate", str(tmp_path / "q.yaml"), out, "--resume", *at], spark)
    main(["rejudge", out, *ledger, *at], spark)
    rows = {r["id"]: r for r in read_results(spark, out).collect()}
    assert set(rows) == {"q1", "q2"} and all(r["answer"] and r["judge_quality"]["score"] for r in rows.values())
    (docs / "a.rst").write_text("Title\n=====\n\nShort now.\n")
    import time

    time.sleep(1.1)  # deliveries are numbered by seconds
    main(ingest, spark)
    assert {r["text"] for r in index.read(spark, at[1]).collect()} == {"Short now.", "Nothing of it."}
