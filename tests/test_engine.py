"""The engine's operators on small fixtures, and its queries against DuckDB."""

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomcorpus.functions import text as T
from loomcorpus.functions import tokens
from loomcorpus.operators import chunk, index, judge, metrics, report, retrieve
from loomcorpus.plans import evaluate
from loomcorpus.plans import queries as Q
from loomcorpus.providers import RateLimiter, completed, embedded, overlap_judge, token_batches, with_retry
from loomcorpus.sources import acquire, html, pdf, results, rst
from loomcorpus.streaming.ingest import SECTION, ingest_stream

SF = "/root/testdata/sf0.001"


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v")).alias("x")).first()["x"]


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return float(v) if type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations", "events", "part"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    r = con.execute(Q.SQL[name])
    names = [x[0] for x in r.description]
    df = Q.QUERIES[name](spark, SF)
    assert sorted(names) == sorted(df.columns)
    assert sorted(repr([plain(row[c]) for c in names]) for row in df.collect()) == sorted(repr([plain(v) for v in row]) for row in r.fetchall())


def test_ordinal_names_of_all_pages(spark, tmp_path):
    pages = [(i * 7 % 1201, f"http://x/a/p{i}.html/") for i in range(1201)]
    spark.createDataFrame(pages, "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r["page_id"]: r["name"] for r in Q.QUERIES["q_ordinal_names"](spark, str(tmp_path)).collect()}
    assert got == {i: f"{k:02d}-{u.rstrip('/').split('/')[-1]}" for k, (i, u) in enumerate(sorted(pages), 1)}


def test_rst_sections():
    text = "lost\n\nTitle\n=====\nintro :ref:`Here <x>` and :py:func:`name`\n\n.. note::\n   gone\n  stays\n\n.. _label:\n\nSub\n---\nbody |a\nb| `link`_ <http://x.y>\n\n====\nOver\n====\n\nSub\n---\nagain\nShort head\n-----\n"
    got = list(rst.sections(text, "file"))
    assert [h for h, _ in got] == [["Title"], ["Title", "Sub"], ["Over", "Sub"]]
    assert got[0][1] == "intro Here  and name\n\n  stays" and got[1][1] == "body  link"
    assert list(rst.sections("plain text", "stem")) == [(["stem"], "plain text")] and list(rst.sections("", "stem")) == []
    assert rst.rule_char("==") == "=" and rst.rule_char("=") == "" and rst.rule_char("::") == "" and rst.rule_char("=-") == ""


def test_read_rst(spark, tmp_path):
    for name, body in (("a.rst", "A\n==\nx"), ("_static/b.rst", "no"), ("sub/c.rst", "{{ a }} {% b"), ("sub/d.rst", "plain")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(body)
    (tmp_path / "sub" / "e.rst").write_bytes(b"bad \xff byte")
    got = rst.read_rst(spark, str(tmp_path)).collect()
    assert sorted((r["text"], r["section_hierarchy"][-1]) for r in got) == [("bad \ufffd byte", "e"), ("plain", "d"), ("x", "A")]


def test_read_html(spark, tmp_path):
    (tmp_path / "a.html").write_bytes(b"<main><section><h1>T</h1><p>x \xff</p></section></main>")
    (tmp_path / "deep.html").write_text("<main><section><h1>D</h1>" + "<div><b>" * 3000 + "low" + "</section></main>")
    (tmp_path / "none.html").write_text("<p>no main</p>")
    got = {r["section_hierarchy"][0]: r["text"] for r in html.read_html(spark, str(tmp_path)).collect()}
    assert got == {"T": "x \ufffd", "D": "low"}


def test_html_sections():
    page = "<main id='main-content'><section id='a-b'><p>one<!--c--></p><img alt='pic'><nav>no</nav><section><h2>Sub#</h2><pre>x  y</pre><span class='math'>$a$</span></section><div><section><h3>In</h3>deep</section></div></section></main>"
    got = list(html.sections(page, "s"))
    assert [h for h, _ in got] == [["A B"], ["A B", "Sub"], ["A B", "In"]]
    assert got[0][1] == "one\nc\n\n[image: pic]\n\nIn\ndeep".replace("In\ndeep", "Indeep") or "deep" in got[0][1]
    assert got[1][1] == "x  y\n\n$a$" and list(html.sections("<p>x</p>", "s")) == []
    assert list(html.sections("<h1>T</h1><p>a</p><h2>U</h2><p>b</p>", "s", "heading")) == [(["T"], "a"), (["T", "U"], "b")]


def test_pdf_sections(spark):
    chars = spark.createDataFrame([("d/p.pdf", 1, i, float(top), size, c) for i, (top, size, c) in enumerate([(1, 18.0, c) for c in "Big title"] + [(2, 10.0, c) for c in "body text body text"])], "file string, page int, char_no int, top double, size double, text string")
    lines = spark.createDataFrame([("d/p.pdf", 1, i, x) for i, x in enumerate(["preface words", "Big title", "body text body text", "", "more", "1.2 Next", "end"])], "file string, page int, line_no int, line string")
    got = {r["section_no"]: (r["text"], r["section_hierarchy"]) for r in pdf.pdf_sections(lines, chars).collect()}
    assert got == {0: ("preface words", ["p"]), 1: ("body text body text\n\nmore", ["p", "Big title"]), 2: ("end", ["p", "1.2 Next"])}


@settings(max_examples=15, deadline=None)
@given(st.lists(st.integers(1, 9), min_size=1, max_size=12), st.integers(3, 9), st.integers(0, 3))
def test_packing_keeps_atoms(spark, sizes, most, overlap):
    atoms = [" ".join([f"a{i}"] * n) for i, n in enumerate(sizes)]
    out = spark.createDataFrame([(atoms,)], "a array<string>").select(chunk.packed(F.col("a"), most, overlap).alias("x")).first()["x"]
    want, buf = [], []
    for i, n in enumerate(sizes):
        total = sum(sizes[j] for j in buf)
        if n > most:
            want += [buf] * bool(buf) + [[i]]
            buf = []
        elif total + n > most:
            want += [buf] * bool(buf)
            keep, t = [], 0
            for j in reversed(buf):
                if t + sizes[j] > overlap:
                    break
                keep, t = [j, *keep], t + sizes[j]
            buf = [*keep, i]
        else:
            buf = [*buf, i]
    want += [buf] * bool(buf)
    assert out == [" ".join(atoms[j] for j in c) for c in want]


def test_chunk_documents(spark):
    rows = [(0, "One. Two! Three?", "docs", "s", "p", ["H", "Título é"]), (1, "word " * 30 + "```code here``` end.", "docs", "s", "p", ["H", "Título é"]), (2, "x", "docs", "s", None, [])]
    got = chunk.chunk_documents(spark.createDataFrame(rows, SECTION), most=20, overlap=2)
    assert len({r["chunk_id"] for r in got.collect()}) == got.count()
    chunk.assert_unique(got)
    with pytest.raises(ValueError):
        chunk.assert_unique(got.union(got))
    first = got.filter("text = 'One. Two! Three?'").first()
    assert first["section_path"] == "H > Título é" and first["chunk_id"].split("::")[1] == "titulo_e" and first["total_chunks_in_section"] == 1


def test_text_functions(spark):
    assert one(spark, "see [1], [4, 2] and [x] [2]", T.citations) == [1, 2, 4]
    for s in ("It does NOT contain enough information.", "we CAN’T answer", "insufficient context", "unable to answer"):
        assert one(spark, s, T.abstained)
    assert not one(spark, "an answer", T.abstained)
    for v, want in (("0.3", 0.5), ("0.25", 0.0), ("0.75", 0.5), ("text", None), ("0.9", 1.0), (None, None)):
        assert one(spark, v, T.faith_score) == want
    for raw, ok in (("```json\n{\"a\": 1}\n```", True), ("x {\"a\": 1} y", True), ("{\"a\":1} {\"b\":2}", False), ("no", False), ("", False)):
        assert (one(spark, raw, lambda c: T.judge_json(c).cast("string")) is not None) == ok
    row = spark.createDataFrame([("1, 3,x,9,1", ["a", "b", "c"])], "r string, ids array<string>").select(T.parse_ranks(F.col("r"), F.col("ids")).alias("x")).first()
    assert row["x"] == ["a", "c", "a"]
    assert one(spark, "Some - Heading_x", T.slug) == one(spark, "Some - Heading_x", T.slug_ascii) == "some_heading_x"
    assert one(spark, "a\nb", T.quoted) == "> a\n> b"


def test_retrieval_edges(spark):
    rows = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [-1.0, 0.0]), ("c", [1.0, 0.0]), ("z", [0.0, 0.0])], "chunk_id string, embedding array<float>")
    ask = spark.createDataFrame([(1, [2.0, 0.0])], "query_id int, embedding array<float>")
    got = [(r["chunk_id"], r["rank"], r["score"]) for r in retrieve.topk(rows, ask, 9).orderBy("rank").collect()]
    assert got == [("a", 1, 1.0), ("c", 2, 1.0), ("z", 3, 0.0), ("b", 4, 0.0)]
    assert retrieve.source_filter(rows, "chunk_id", []).count() == 4 and retrieve.source_filter(rows, "chunk_id", "a").count() == 1


def test_metrics_edges(spark):
    ranked = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "query_id int, rank int, chunk_id string")
    truth = spark.createDataFrame([(1, "b"), (1, "b"), (1, "x"), (2, "q")], "query_id int, chunk_id string")
    asked = spark.createDataFrame([(1,), (2,), (3,)], "query_id int")
    got = {r["query_id"]: (r["recall_at_k"], r["mrr"], r["num_relevant"]) for r in metrics.per_query(ranked, truth, asked, 5).collect()}
    assert got == {1: (0.5, 0.5, 2), 2: (0.0, 0.0, 1), 3: (None, None, 0)}


def test_index_and_stream(spark, tmp_path):
    rows = [(i, f"text {i}", "docs", "s", f"p{i}", ["H"]) for i in range(3)]
    spark.createDataFrame(rows, SECTION).write.parquet(str(tmp_path / "in/1"))
    src, idx, ck = str(tmp_path / "in/*"), str(tmp_path / "index"), str(tmp_path / "ck")
    ingest_stream(spark, src, idx, ck).awaitTermination()
    assert index.read(spark, idx).count() == 3
    spark.createDataFrame([(0, "changed", "docs", "s", "p0", ["H"]), (9, "new", "docs", "s", "p9", ["H"])], SECTION).write.parquet(str(tmp_path / "in/2"))
    ingest_stream(spark, src, idx, ck).awaitTermination()
    got = index.read(spark, idx)
    assert got.count() == 4 and got.filter("text = 'changed'").count() == 1 and got.filter("text = 'text 0'").count() == 0
    assert index.metadata(got).columns == index.META
    done = spark.createDataFrame([("a", None), ("b", "boom")], "id string, error string")
    ask = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    assert index.remaining(ask, done).count() == 1 and index.remaining(ask, done, True).count() == 2


def test_providers(spark):
    now = [0.0]
    limit = RateLimiter(requests=2, tokens=100, clock=lambda: now[0], sleep=lambda s: now.__setitem__(0, now[0] + s))
    for _ in range(3):
        limit.wait(10)
    assert now[0] > 62
    assert token_batches([5, 5, 20, 1], 10) == [0, 0, 1, 2]
    tries = []
    assert with_retry(lambda: tries.append(1) or (1 if len(tries) > 1 else 1 / 0), sleep=lambda s: None) == 1
    df = spark.createDataFrame([(1, "boom"), (2, "fine")], "query_id int, prompt string")
    got = {r["query_id"]: r for r in completed(df, lambda p: 1 / 0 if p == "boom" else p).collect()}
    assert got[1]["error"].startswith("ZeroDivisionError") and got[2]["answer"] == "fine"
    assert len(embedded(df, text_col="prompt").first()["embedding"]) == 64


def test_results_and_reports(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text('{"id": "a", "should_abstain": false, "answer": "x", "judge_faithfulness": {"faithfulness_score": 0.5}}\nbroken\n{"answer": "no id"}\n{"id": "b", "should_abstain": true, "answer": "y", "error": null}\n')
    rows = results.read_results(spark, str(tmp_path / "r.jsonl"))
    assert sorted(r["id"] for r in rows.collect()) == ["a", "b"]
    summary = report.eval_summary(rows).first()
    assert summary["n"] == 2 and summary["faithfulness"] == 0.5 and summary["recall"] is None
    new = spark.createDataFrame([("a", 1.0, "ok"), ("b", 1.0, "ok")], "id string, score double, reasoning string")
    got = {r["id"]: r["judge_faithfulness"] for r in report.rejudged(rows, new).collect()}
    assert got["a"]["faithfulness_score"] == 1.0 and got["b"]["faithfulness_score"] is None
    empty = spark.createDataFrame([], "should_abstain boolean, abstained boolean")
    assert report.abstention_scores(empty).first()["f1"] == 0.0
    (tmp_path / "q.yaml").write_text("questions:\n- id: q1\n  category: c\n  question: why\n  should_abstain: true\n")
    assert results.read_questions(spark, str(tmp_path / "q.yaml")).first()["should_abstain"] is True


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def _golden(spark):
    rows = [("a", "x", "red fox", ["1"], False), ("b", "x", "blue whale", [], False), ("c", "y", "bad", ["2"], False), ("d", "y", "green tree", ["3"], True)]
    return spark.createDataFrame(rows, "id string, category string, question string, ground_truth_chunk_ids array<string>, should_abstain boolean")


def picky():
    """An embedder and a completion that fail for some texts; local functions travel to the tasks whole."""

    def embed(texts, input_type="document"):
        if any("bad" in t for t in texts):
            raise OSError("no vector")
        return [[float("fox" in t) + 0.1, float("whale" in t) + 0.1, 1.0 * len(t) / 99] for t in texts]

    def complete(prompt):
        asked = prompt.rsplit("Question:", 1)[-1]
        if "blue whale" in asked:
            raise TimeoutError("late")
        return "The fox is red. [1]" if "fox" in asked else "I cannot answer this."

    return embed, complete


def test_evaluation_contains_errors(spark):
    embed, complete = picky()
    chunks = embedded(spark.createDataFrame([("1", "a red fox", "docs", "s", "p"), ("2", "a blue whale", "docs", "s", "p"), ("3", "tree", "docs", "s", "p")], "chunk_id string, text string, source_type string, source_name string, section_path string"), embed)
    out = {r["id"]: r for r in evaluate.run(_golden(spark), chunks, 2, embed, complete, overlap_judge).collect()}
    assert out["a"]["retrieved_chunk_ids"][0] == "1" and out["a"]["retrieval_metrics"]["mrr"] == 1.0 and out["a"]["judge_quality"]["score"] >= 1 and out["a"]["judge_abstention"]["correct"]
    assert out["b"]["error"].startswith("generation: TimeoutError") and out["b"]["retrieval_metrics"] is None and out["b"]["judge_abstention"] is None and len(out["b"]["retrieved_chunk_ids"]) == 2
    assert out["c"]["error"] == "retrieval: OSError: no vector" and out["c"]["retrieved_chunk_ids"] is None and out["c"]["answer"] is None
    assert out["d"]["abstained"] and out["d"]["judge_abstention"]["correct"] and out["d"]["judge_faithfulness"] is None and out["d"]["retrieval_metrics"] is None
    none = evaluate.run(_golden(spark).limit(0), chunks, 2, embed, complete, overlap_judge)
    assert none.collect() == []


def test_ablation_and_rejudging(spark):
    complete = picky()[1]
    chunks = embedded(spark.createDataFrame([("1", "The fox is red.", "docs", "s", "p")], "chunk_id string, text string, source_type string, source_name string, section_path string"))
    results = evaluate.run(_golden(spark).filter("id IN ('a', 'd')"), chunks, 2, complete=complete, judge_call=overlap_judge).persist()
    once = evaluate.ablated(results, complete, overlap_judge).persist()
    got = {r["id"]: r for r in once.collect()}
    assert got["a"]["no_rag_answer"] == "The fox is red. [1]" and got["a"]["no_rag_quality"]["score"] == 1 and got["d"]["no_rag_answer"] is None
    assert evaluate.pending_ablation(once).count() == 0
    again = {r["id"]: r for r in evaluate.rejudge(once, chunks, lambda p: '{"faithfulness_score": "0.7", "unsupported_claims": ["u"], "reasoning": "new"}').collect()}
    assert again["a"]["judge_faithfulness"].asDict() == {"judge": "faithfulness", "faithfulness_score": 0.5, "unsupported_claims": ["u"], "reasoning": "new", "reason": None, "raw": None, "error": None}
    assert again["d"]["judge_faithfulness"]["faithfulness_score"] is None and again["d"]["judge_faithfulness"]["reason"] == "should abstain"
    audit = once.select("id", judge.score_text(F.col("judge_faithfulness")).alias("s")).collect()
    assert {r["id"]: r["s"] for r in audit}["d"] == "none"


@pytest.mark.parametrize("raw, score", [('{"faithfulness_score": 0.3}', 0.5), ('{"faithfulness_score": "1"}', 1.0), ('{"faithfulness_score": true}', 1.0), ('{"faithfulness_score": null}', None), ('{"faithfulness_score": "x"}', None), ("7", None), ("", None), (None, None), ("[1]", None), ('a {"faithfulness_score": 0.25} b', 0.0), ('{"error": "e", "faithfulness_score": 1}', None)])
def test_judge_replies(spark, raw, score):
    got = one(spark, raw, lambda c: judge.faithfulness(c, F.lit(None).cast("string")))
    assert got["faithfulness_score"] == score and got["judge"] == "faithfulness"


def test_acquire(tmp_path):
    pages = {"http://h/one.html": b"x" * 50, "http://h/two.html": b"y", "http://h/three.html": b"z" * 60}

    def fetch(url):
        return pages[url]

    got = acquire.acquire_pages([*pages, "http://h/gone.html"], str(tmp_path), fetch=fetch, least_bytes=10)
    assert [(r["name"], r["state"]) for r in got] == [("01-one.html", "saved"), ("02-two.html", "failed"), ("03-three.html", "saved"), ("04-gone.html", "failed")]
    assert sorted(p.name for p in tmp_path.iterdir()) == ["01-one.html", "03-three.html"]
    assert [r["state"] for r in acquire.acquire_pages(list(pages), str(tmp_path), fetch=fetch, least_bytes=10)] == ["kept", "failed", "kept"]


def test_bpe_chunks(spark, tmp_path):
    import base64

    path = tmp_path / "ranks"
    path.write_bytes(b"".join(base64.b64encode(bytes([i])) + b" %d\n" % i for i in range(256)))
    rows = spark.createDataFrame([(1, "abc def. ghi jkl. mno", "docs", "s", None, ["h"]), (2, None, "docs", "s", None, ["h"])], SECTION)
    got = chunk.chunk_documents(rows, 10, 0, tokens.bpe_counter(str(path))).collect()
    assert [(r["text"], r["token_count"]) for r in got if r["text"] is not None] == [("abc def.", 8), ("ghi jkl.", 8), ("mno", 3)]
