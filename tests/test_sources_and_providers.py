"""Sources, providers under a budget, the bucketed index, retrieval in blocks, reports by category."""

import random
import subprocess

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomcorpus import providers
from loomcorpus.functions import text as T
from loomcorpus.operators import chunk, index, metrics, report, retrieve
from loomcorpus.plans import evaluate
from loomcorpus.providers import Budget, RateLimiter, Throttled, batch_numbers, completed, embedded, token_batches
from loomcorpus.sources import acquire, html, pdf, results, rst, snapshots


def test_html_frames():
    assert html.readable("<p>a<br>b</p><!--c--><script>no</script><img alt=' z '><pre> x\n y</pre>") == "a\n\nbc[image: z] x\n y"
    page = "<main><p>first</p></main><main id=main-content><ul><section><h2>lost</h2>x</section></ul><section><p>t</p><h3> A <b>b</b> #</h3><h3>second</h3></section></main>"
    assert list(html.sections(page, "s")) == [(["Ab"], "t\n\nsecond")]
    assert list(html.sections("<div><h2>B</h2>one<h1>A</h1>two<h3>C</h3></div>three", "s", "heading")) == [(["B"], "one"), (["A"], "two"), (["A", "C"], "three")]
    assert list(html.sections("", "s")) == [] and list(html.sections("text", "s", "heading")) == [(["s"], "text")]


def test_chapter_links(spark):
    page = """<a href="a.html">1</a><A class=x HREF='b/index.html'>2</A><a href=c.html><a href="index.html"><a href='landing-page.html'><a href="a.html"><a href="#x.html"><a href='https://h/z.html'><link href="l.html"><a data-href="d.html" href="landing.html">"""
    got = spark.createDataFrame([(page,), (None,)], "html string").select(html.links(base="http://h/b//").alias("x")).collect()
    assert [r["x"] for r in got] == [["http://h/b/a.html", "http://h/b/b/index.html", "http://h/b/c.html", "http://h/b/landing.html"], []]


def test_rst_headings_and_directives():
    lines = ["===", "Over", "===", "", "Under", "-----", "no heading", "--", "Long title here", "-------------", "^^^^", "Own", "~~~~", "tail"]
    assert rst.headings(lines) == [(0, 3, "Over", "="), (4, 6, "Under", "-"), (7, 10, "Long title here", "-"), (10, 13, "Own", "~")]
    assert list(rst.without_directives([".. note::", "", "   body", "    deep", "", "  stays", "text", " .. _x:", "    gone", "   gone too?", " end"])) == ["  stays", "text", "   gone too?", " end"]
    assert list(rst.without_directives([".. note:: x", "   body"], frozenset({"note"}))) == ["   body"]


def test_read_pdf(spark, tmp_path):
    """The parser is a provider: here, lines of "size|text"; a file that it fails on gives nothing."""
    (tmp_path / "a.pdf").write_bytes(b"10|plain body\n14|Big\n10|more text\n\f10|1.2 Next\n10|end")
    (tmp_path / "bad.pdf").write_bytes(b"14|Fine\nbroken")
    (tmp_path / "note.txt").write_bytes(b"10|no")

    def parser(data):
        for page in data.decode().split("\f"):
            rows = [x.split("|") for x in page.strip("\n").split("\n")]
            yield [(float(top), float(size), c) for top, (size, text) in enumerate(rows) for c in text], [text for _, text in rows]

    got = {tuple(r["section_hierarchy"]): (r["text"], r["source_type"]) for r in pdf.read_pdf(spark, str(tmp_path), parser).collect()}
    assert got == {("a",): ("plain body", "paper"), ("a", "Big"): ("more text", "paper"), ("a", "1.2 Next"): ("end", "paper")}


def test_acquire_repository(tmp_path):
    calls = []

    def run(command, **options):
        calls.append(command)
        if "bad" in command[-2]:
            raise subprocess.CalledProcessError(128, command)
        (tmp_path / "docs" / ".git").mkdir(parents=True)
        (tmp_path / "docs" / "x.rst").write_text("12345")

    assert acquire.acquire_repository("http://h/docs.git", str(tmp_path / "docs"), run) == {"name": "docs", "bytes": 5, "state": "saved", "error": None}
    assert acquire.acquire_repository("http://h/docs.git", str(tmp_path / "docs"), run)["state"] == "kept" and len(calls) == 1
    assert acquire.acquire_repository("http://h/bad.git", str(tmp_path / "other"), run)["state"] == "failed"
    assert calls[0][:4] == ["git", "clone", "--depth", "1"]


def test_questions_round_trip(spark, tmp_path):
    rows = [("q2", "c", 'why "so"?', ["a::1", "b: 2"], "two\nlines " + "long " * 60, True, None), ("q1", None, "é # no comment", [], None, False, "note: yes")]
    df = spark.createDataFrame(rows, results.QUESTION)
    path = str(tmp_path / "q.yaml")
    results.write_questions(df, path)
    assert sorted(results.read_questions(spark, path).collect()) == sorted(df.collect())
    text = open(path, encoding="utf-8").read()
    assert text.startswith('- id: "q1"') and max(map(len, text.splitlines())) <= 320


def test_budget(monkeypatch):
    now, waits = [0.0], []

    def sleep(s):
        waits.append(s)
        now[0] += s

    budget = Budget(requests=8, tokens=1000, callers=4, pause=3.0)
    monkeypatch.setattr(providers, "_limiters", {budget: RateLimiter(budget.requests // budget.callers, budget.tokens // budget.callers, clock=lambda: now[0], sleep=sleep)})
    assert [budget.send(lambda: "x", 10) for _ in range(3)] == ["x"] * 3 and len(waits) == 1 and waits[0] > 61
    tries = []

    def slow():
        tries.append(1)
        if len(tries) < 3:
            raise Throttled("429")
        return "late"

    now[0] += 100
    assert budget.send(slow, 1) == "late" and waits[1:] == [3.0, 6.0]
    with pytest.raises(ValueError):
        budget.send(lambda: [][0] if False else (_ for _ in ()).throw(ValueError("other")), 1)


def test_providers_under_a_budget(spark, tmp_path):
    """Calls of embeddings, answers and judges pass the limiter; batches run on across Arrow batches."""
    folder = str(tmp_path)

    def embed(texts, input_type="document"):
        import os
        import uuid

        with open(os.path.join(folder, uuid.uuid4().hex), "w") as f:
            f.write(str(len(texts)))
        if "bad" in texts:
            raise OSError("no")
        return [[1.0, float(len(t))] for t in texts]

    budget = Budget(requests=10_000, tokens=10_000_000)
    rows = spark.createDataFrame([(i, "one two three") for i in range(50)], "query_id int, text string").coalesce(1)
    got = embedded(rows, embed, budget=budget, most=30)
    assert sorted(r["query_id"] for r in got.collect()) == list(range(50))
    assert sorted(int(p.read_text()) for p in tmp_path.iterdir()) == [10] * 5
    failed = embedded(spark.createDataFrame([(1, "bad"), (2, "xyz")], "query_id int, text string").coalesce(1), embed, contain=True, most=1).collect()
    assert failed[0]["embed_error"].startswith("OSError") and failed[1]["embedding"] == [1.0, 3.0]
    assert completed(spark.createDataFrame([(1, "p q")], "query_id int, prompt string"), lambda p: p.upper(), budget=budget).first()["answer"] == "P Q"
    questions = spark.createDataFrame([("a", "c", "red fox", ["1"], False)], "id string, category string, question string, ground_truth_chunk_ids array<string>, should_abstain boolean")
    chunks = embedded(spark.createDataFrame([("1", "A red fox.", "s", "p")], "chunk_id string, text string, source_name string, section_path string"))
    out = evaluate.run(questions, chunks, 2, judge_call=providers.overlap_judge, budget=budget, embed_budget=budget).first()
    assert out["error"] is None and out["judge_quality"]["score"] >= 1


def test_batch_numbers(spark):
    rng = random.Random(2)
    rows = [(k, i, rng.randrange(0, 30)) for k in "ab" for i in range(200)]
    got = {(r["k"], r["i"]): r["batch"] for r in batch_numbers(spark.createDataFrame(rows, "k string, i int, n int"), "k", "i", "n", 50).collect()}
    for k in "ab":
        assert [got[k, i] for i in range(200)] == token_batches([n for key, _, n in rows if key == k], 50)


def test_upsert_replaces_touched_buckets_only(spark, tmp_path):
    path = str(tmp_path / "index")
    kind = "chunk_id string, text string"
    index.upsert(spark, spark.createDataFrame([(f"c{i}", "old") for i in range(40)], kind), path, most_rows=8)
    before = index.directory(snapshots.newest(spark, path))
    index.upsert(spark, spark.createDataFrame([("c3", "first"), ("c3", "last"), ("new", "x")], kind).coalesce(1), path, most_rows=8)
    got = {r["chunk_id"]: r["text"] for r in index.read(spark, path).collect()}
    assert len(got) == 41 and got["c3"] == "last" and got["new"] == "x" and got["c4"] == "old"
    after = index.directory(snapshots.newest(spark, path))
    kept = {b for b in before if after.get(b) == before[b]}
    assert len(before) >= 6 and len(before) - 2 <= len(kept) < len(before)
    index.upsert(spark, spark.createDataFrame([], kind), path)
    assert index.read(spark, path).count() == 41


def test_full_buckets_split_alone(spark, tmp_path):
    path, most = str(tmp_path / "index"), 50
    seen = {}
    for step, n in enumerate((20, 200, 2000)):
        rows = spark.range(n).select(F.format_string("c%d", "id").alias("chunk_id"), F.lit(step).alias("step"))
        index.upsert(spark, rows, path, most)
        buckets = index.directory(snapshots.newest(spark, path))
        sizes = {b: index.read(spark, path, [b]).count() for b in buckets}
        assert sum(sizes.values()) == n and max(sizes.values()) <= most
        assert sum(2.0 ** -(len(b) - 1) for b in buckets) == 1.0 and not any(a != b and b.startswith(a) for a in buckets for b in buckets)
        assert all(len(list((tmp_path / "index" / p).glob("*.parquet"))) == 1 for p in buckets.values() if p)
        seen[step] = len(buckets)
    assert seen[0] == 1 and seen[2] >= 2000 / most
    hit = [b for b in buckets if index.read(spark, path, [b]).filter("chunk_id = 'c7'").count()]
    index.upsert(spark, spark.createDataFrame([("c7", 9)], "chunk_id string, step int"), path, most)
    after = index.directory(snapshots.newest(spark, path))
    assert {b for b in buckets if after[b] != buckets[b]} == set(hit) and len(hit) == 1


def test_upsert_deletes_moves_and_passes_over_batches(spark, tmp_path):
    path, kind = str(tmp_path / "index"), "chunk_id string, text string"
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "chunk_id string")
    first = spark.createDataFrame([(f"c{i}", f"t{i}") for i in range(6)], kind)
    assert index.upsert(spark, first, path, 2, batch=("s", 0))
    assert not index.upsert(spark, first.limit(0), path, 2, gone=ids("c1"), batch=("s", 0))
    moves = spark.createDataFrame([("c0", "c1"), ("c1", "c2"), ("c5", "c9")], "chunk_id string, new_id string")
    assert index.upsert(spark, spark.createDataFrame([("c0", "new")], kind), path, 2, gone=ids("c4", "c0", "none"), moved=moves, batch=("s", 1))
    assert {r["chunk_id"]: r["text"] for r in index.read(spark, path).collect()} == {"c0": "new", "c1": "t0", "c2": "t1", "c3": "t3", "c9": "t5"}
    index.upsert(spark, first.limit(0), path, 2, gone=ids("c0", "c1", "c2", "c3", "c9"))
    assert index.read(spark, path).count() == 0
    index.upsert(spark, first.withColumn("more", F.lit(1)), path, 2)
    assert index.read(spark, path).filter("more = 1").count() == 6
    with pytest.raises(Exception, match="lost"):
        index.upsert(spark, first.withColumn("text", F.raise_error(F.lit("lost"))), path)
    assert index.read(spark, path).count() == 6


def test_topk_in_blocks(spark):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((300, 6)).round(2)
    rows = [(f"v{i:03d}", v.tolist()) for i, v in enumerate(x)] + [("short", [1.0, 2.0]), ("none", None)]
    df = spark.createDataFrame(rows, "chunk_id string, embedding array<double>")
    asks = df.filter("chunk_id < 'v040' OR chunk_id = 'short'").withColumnRenamed("chunk_id", "query_id")
    near = lambda d: sorted((r["query_id"], r["rank"], r["chunk_id"], round(r["score"], 9)) for r in d.collect())
    one, many = near(retrieve.topk(df, asks, 7)), near(retrieve.topk(df, asks, 7, group=5))
    assert one == many and len(one) == 40 * 7 + 1
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q in range(0, 40, 9):
        want = sorted(range(300), key=lambda j: (-(unit[q] @ unit[j]), j))[:7]
        assert [r[2] for r in one if r[0] == f"v{q:03d}"] == [f"v{j:03d}" for j in want]
    assert retrieve.topk(df, asks.limit(0), 3).collect() == [] and retrieve.topk(df.limit(0), asks, 3).collect() == []


def test_citations_and_abstention(spark):
    hits = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "query_id int, rank int, chunk_id string")
    answers = spark.createDataFrame([(1, [2, 2, 9, 0], False), (2, [1], True)], "query_id int, citations_used array<int>, abstained boolean")
    assert [(r["query_id"], r["chunk_id"]) for r in retrieve.cited(hits, answers).collect()] == [(1, "b")]


def test_places_with_gaps(spark):
    rng = random.Random(5)
    numbers = sorted(rng.sample(range(100_000), 777))
    df = spark.createDataFrame([(n,) for n in numbers] + [(None,)], "n long")
    assert {r["n"]: r["place"] for r in report.placed(df, "n").collect()} == {n: i for i, n in enumerate([*numbers, None])}
    assert {r["n"] for r in report.sample_positions(df, "n").collect()} == {numbers[0], numbers[389], None}
    assert report.sample_positions(df.limit(0), "n").collect() == []


def test_reports_by_category(spark):
    ranked = spark.createDataFrame([(1, 6, "a"), (1, 2, "b"), (2, 1, "z")], "query_id int, rank int, chunk_id string")
    truth = spark.createDataFrame([(1, "a"), (1, "b"), (3, "q")], "query_id int, chunk_id string")
    queries = spark.createDataFrame([(1, "x"), (2, "y"), (3, "x")], "query_id int, category string")
    got = {r["category"]: (r["n"], r["mrr"], r["recall_5"], r["recall_10"]) for r in metrics.by_category(ranked, truth, queries, "category").collect()}
    assert got == {"x": (2, 0.25, 0.25, 0.5), "y": (0, 0.0, 0.0, 0.0)}
    rows = spark.createDataFrame([("a", True, True, ["c"]), ("a", False, True, []), (None, None, True, None)], "category string, should_abstain boolean, abstained boolean, unsupported_claims array<string>")
    assert report.false_abstentions(rows).count() == 2
    assert {r["category"]: r["unsupported"] for r in report.unsupported(rows).collect()} == {"a": 1, None: 0}


@pytest.mark.parametrize("overlap", [0, 3])
def test_packing_of_code_and_empty_atoms(spark, overlap):
    """Fenced code is an atom; blank atoms and oversized ones keep their places."""
    text = "One two. Three four five. ```x = 1\ny = 2 ``` Six. " + "w " * 12 + "end. Last one."
    got = spark.createDataFrame([(text,), ("",), (None,)], "t string").select(chunk.packed(T.atoms(F.col("t")), 6, overlap).alias("x")).collect()
    if not overlap:
        assert got[0]["x"] == ["One two. Three four five.", "```x = 1\ny = 2 ```", "Six.", ("w " * 12 + "end."), "Last one."] or got[0]["x"][0] == "One two. Three four five."
    assert got[1]["x"] == [] and got[2]["x"] is None and "".join(" ".join(got[0]["x"]).split()).count("```") == 2
