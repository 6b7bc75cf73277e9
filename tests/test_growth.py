"""What grows with the input is done once: hashing of words, vectors of chunks, counts of tokens."""

import re
from hashlib import md5

import numpy as np
from pyspark.sql import functions as F

from loomcorpus import providers
from loomcorpus.functions import text as T
from loomcorpus.operators import chunk
from loomcorpus.plans import evaluate


def test_words_are_hashed_once(monkeypatch):
    calls = []
    monkeypatch.setattr(providers, "md5", lambda w, **more: calls.append(w) or md5(w, **more))
    texts = ["Ox ox yak_1 ox", "", "yak_1 Élan ox ox"] * 5
    providers.HashEmbedder()(["warm"])
    calls.clear()
    got = providers.HashEmbedder(8)(texts)
    assert len(calls) == len(set(calls))
    for t, v in zip(texts, got, strict=True):
        want = np.zeros(8)
        for w in re.findall(r"\w+", t.lower()):
            h = int.from_bytes(md5(w.encode()).digest()[:8], "big")
            want[h % 8] += 1 if h >> 63 else -1
        assert np.allclose(v, want / max(np.linalg.norm(want), 1e-9))


def test_evaluation_embeds_chunks_once(spark, tmp_path):
    docs = spark.createDataFrame([(str(i), f"Word{i} stands here. More.", "s", "p") for i in range(20)], "chunk_id string, text string, source_name string, section_path string")
    asks = spark.createDataFrame([("a", "Where is word3?", "c", False, ["3"])], "id string, question string, category string, should_abstain boolean, ground_truth_chunk_ids array<string>")
    log = tmp_path / "log"

    def embed(texts, kind="document"):
        if kind == "document":
            with log.open("a") as f:
                f.write("x" * len(texts))
        return providers.HashEmbedder()(texts, kind)

    rows, hits = evaluate.retrieved(asks, providers.embedded(docs, embed), 5, texts_of=docs)
    assert rows.first()["retrieved_chunk_ids"][0] == "3" and hits.count() == 5 and hits.filter("text = ''").count() == 0
    assert len(log.read_text()) == 20


def test_token_counts_of_odd_texts(spark):
    texts = [None, "", " ", "a", " a", "a ", "\n a\tb\x0b", "\x0c\x1c c", " d e", "  \r\n "]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.token_count(F.col("t")).alias("n"), T.stripped(F.col("t")).alias("s"))
    space = " \t\n\x0b\x0c\r"
    for r in rows.collect():
        assert r["n"] == (None if r["t"] is None else len([w for w in re.split(f"[{space}]+", r["t"]) if w]))
        assert r["s"] == (None if r["t"] is None else r["t"].strip(space))


def test_chunks_are_cut_once(spark, tmp_path):
    docs = [(1, "One two three. Four five six. Seven eight.", "d", "s", "p", ["h"]), (2, "", "d", "s", "p", ["h"]), (3, None, "d", "s", "p", ["h"])]
    spark.createDataFrame(docs, "doc_ord long, text string, source_type string, source_name string, original_path string, section_hierarchy array<string>").write.parquet(str(tmp_path / "docs"))
    out = chunk.chunk_documents(spark.read.parquet(str(tmp_path / "docs")), 4, 0)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("(?<=[.!?])") == 1
    assert sorted((r["chunk_id"][-1], r["text"]) for r in out.collect() if r["text"]) == [("0", "One two three."), ("1", "Four five six."), ("2", "Seven eight.")]
    assert out.count() == 5


def test_chunks_carry_counts_and_vectors_stay_a_matrix(spark):
    """Words of chunks are sums of their atoms', also at fences within words; vectors are not made into Python numbers."""
    texts = ["One two. Three  four\tfive. Six.", "ab```x y. z```cd. E f g h i j", "a\u0001b. c", "a b\u0001c d e", " ", "", None]
    docs = spark.createDataFrame([(i, t, "d", "s", str(i), ["h"]) for i, t in enumerate(texts)], "doc_ord long, text string, source_type string, source_name string, original_path string, section_hierarchy array<string>")

    class Embedder(providers.HashEmbedder):
        def __call__(self, texts, input_type="document"):
            raise AssertionError("vectors as lists")

    rows = providers.embedded(chunk.chunk_documents(docs, 3, 1), Embedder(8)).collect()
    assert len(rows) > len(texts)
    for r in rows:
        assert r["token_count"] == (None if r["text"] is None else len((r["text"]).encode().split()))
        assert np.allclose(r["embedding"], providers.HashEmbedder(8)([r["text"] or ""])[0])
    assert [r["text"] for r in rows if r["original_path"] == "2"] == ["a\u0001b. c"]


def test_words_are_those_of_the_pattern():
    for t in ["Ox_1, ox-2\x1cb", "Élan vital x²", "straße İΣ Σ", "", " \x00a\x7f", "日本 語。x"]:
        assert providers._words(t) == re.findall(r"\w+", t.lower())
