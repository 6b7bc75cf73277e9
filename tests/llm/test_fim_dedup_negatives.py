"""Fill-in-middle, exact dedup and hard negatives against plain Python and SQL, with odd rows."""

import random
from hashlib import sha256

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from loomcorpus.llm import exact_dedup, fim, hard_negatives

DOCS = "doc_id long, text string, digests string, id string, form string, kept string"


def docs_of(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, "x", "y", None, "z") for i, t in zip(range(len(texts)) if ids is None else ids, texts, strict=True)], DOCS)


def duck(df, sql, view):
    con = duckdb.connect()
    con.register("given", df.toArrow())
    con.execute(f"CREATE TABLE {view} AS SELECT * FROM given")
    r = con.execute(sql)
    return sorted(repr(sorted(zip([x[0] for x in r.description], row, strict=True))) for row in r.fetchall())


def rows_of(df):
    return sorted(repr(sorted(r.asDict().items())) for r in df.collect())


def odd_texts():
    rng = random.Random(5)
    letters = "aé漢😀z\n. <P>S"
    return [None, "", "a", "é", "😀", "x<M>y", "<", *("".join(rng.choice(letters) for _ in range(rng.randrange(1, 400))) for _ in range(60)), "漢字😀." * 40_000, "b" * 300_000]


# --- fill in the middle


def test_rank_and_select_match_counting():
    rng = np.random.default_rng(1)
    for n in (0, 1, 63, 64, 511, 512, 513, 5000):
        data = rng.choice(np.array([0x41, 0xC3, 0xA9, 0x80], np.uint8), n)
        starts = [i for i, b in enumerate(data.tolist()) if b & 0xC0 != 0x80] + [n]
        points, at = fim.CodePoints(data), np.arange(n + 1)
        assert points.rank(at).tolist() == [sum(s < i for s in starts) for i in at.tolist()] if n < 600 else True
        assert points.select(np.arange(len(starts))).tolist() == starts


def plain_fim(doc_id, text, p):
    text = text or ""
    h = sha256(f"{p.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= p.transformed:
        return (doc_id, n, "plain", None, None, text)
    if h[3] % 100 < p.suffix_first:
        return (doc_id, n, "spm", a, b - a, f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}")
    return (doc_id, n, "psm", a, b - a, f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}")


@pytest.mark.parametrize("p", [fim.Params(), fim.Params(seed=7, transformed=100, suffix_first=50)])
def test_fim_matches_plain_python_and_restores(spark, p):
    texts = odd_texts()
    ids = [None, *range(1, len(texts))]
    rows = fim.transformed(docs_of(spark, texts, ids), params=p)
    got = [tuple(r) for r in rows.collect()]
    assert sorted(got, key=repr) == sorted((plain_fim(i, t, p) for i, t in zip(ids, texts, strict=True)), key=repr)
    back = {r["doc_id"]: r["t"] for r in rows.select("doc_id", fim.restored(F.col("output"), F.col("form")).alias("t")).collect()}
    assert back == {i: t or "" for i, t in zip(ids, texts, strict=True)}
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_fim_matches_sql(spark):
    docs = docs_of(spark, [*odd_texts(), "again", "again"], [*range(len(odd_texts())), 7, 7])
    assert rows_of(fim.op11_fill_in_middle(docs)) == duck(docs, fim.OP11_SQL, "documents")
    assert fim.op11_fill_in_middle(docs.limit(0)).collect() == []


# --- exact dedup


@pytest.fixture(scope="module")
def copies():
    rng = random.Random(9)
    sentence = lambda: " ".join(f"w{rng.randrange(50)}" for _ in range(rng.randrange(3, 12))) + rng.choice([". ", "!\n", "\n", "? "])
    base = ["".join(sentence() for _ in range(rng.randrange(1, 300))) for _ in range(25)]
    texts = base + [t.upper() for t in base[:8]] + [base[0]] * 60 + [base[1] + "x", "y" + base[1], base[2].replace("w1", "w2", 1)]
    return [*texts, None, "", "", "É", "é", "ẞ. ß", "ß. ß", "q" * 5000, "Q" * 5000, "q" * 5001]


@pytest.mark.parametrize("p", [exact_dedup.Params(), exact_dedup.Params(digest_bits=2), exact_dedup.Params(broadcast_keys=0, one_in=1, piece=7)])
def test_exact_dedup_matches_sql_with_and_without_clashes(spark, copies, p):
    docs = docs_of(spark, copies)
    assert rows_of(exact_dedup.classes(docs, params=p).drop("n_chunks")) == duck(docs, exact_dedup.OP12_SQL, "documents")


def test_chunks_are_the_text_and_resist_shifts(spark, copies):
    docs = docs_of(spark, [t for t in copies if t])
    text = exact_dedup.normal(F.col("text"))
    rows = docs.select(text.alias("t"), exact_dedup.chunks(text).alias("c")).collect()
    assert all("".join(r["c"]) == r["t"] for r in rows)
    assert max(len(r["c"]) for r in rows) > 10
    long = max((t for t in copies if t), key=len) * 3
    a, b = (r["c"] for r in docs_of(spark, [long, "Inserted. " + long]).orderBy("doc_id").select(exact_dedup.chunks(F.col("text")).alias("c")).collect())
    assert len(set(a) & set(b)) >= len(set(a)) - 2


def test_exact_dedup_odd_rows(spark):
    docs = docs_of(spark, ["A b.", "a B.", "a b.", None, "", "other", "other"], [None, 3, 3, None, None, 5, 5])
    got = sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.classes(docs).collect()), key=repr)
    assert got == sorted([(None, 3, 3, False), (3, 3, 3, True), (3, 3, 3, True), (None, None, 2, True), (None, None, 2, True), (5, 5, 2, True), (5, 5, 2, True)], key=repr)
    out = exact_dedup.keep_one(docs)
    assert out.columns == docs.columns and sorted((r["doc_id"] or 0, r["text"] or "") for r in out.collect()) == [(0, ""), (0, ""), (3, "a B."), (3, "a b."), (5, "other"), (5, "other")]
    assert exact_dedup.op12_exact_dedup(docs.limit(0)).collect() == []


# --- hard negatives

VECTORS = "vec_id long, embedding array<float>, label int, id string, key string, score string"


def vectors_of(spark, rows):
    return spark.createDataFrame([(*r, "x", None, "y") for r in rows], VECTORS)


def plain_negatives(rows, is_anchor, p):
    fine = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v], label) for i, v, label in rows if i is not None and label is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for i, v, label in fine:
        if not is_anchor(i):
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j, other == label) for j, w, other in fine if j != i and len(w) == len(v))
        for s, j in [(-s, j) for s, j, same in scored if same][: p.positives]:
            hard = [(-t, k) for t, k, same in scored if not same and p.low * s <= -100 * t <= p.high * s][: p.negatives]
            out |= {(i, j, r, k, s, t) for r, (t, k) in enumerate(hard, 1)}
    return sorted(out)


def some_vectors(kind, n=400):
    rng = np.random.default_rng(3)
    if kind == "clusters":
        centre = rng.normal(size=(9, 8)) * 3
        v = centre[rng.integers(0, 9, n)] + rng.normal(size=(n, 8)) * 0.3
    elif kind == "copies":
        v = rng.normal(size=(n, 8))
        v[: n // 3] = v[0]
    else:
        v = rng.normal(size=(n, 8)) * (1e5 if kind == "large" else 0.2)
    return [(i, x.astype(np.float32).tolist(), int(rng.integers(0, 4))) for i, x in enumerate(v)]


@pytest.mark.parametrize("kind", ["clusters", "copies", "random", "large"])
def test_hard_negatives_match_plain_python(spark, kind):
    rows = some_vectors(kind)
    p = hard_negatives.Params(positives=3, negatives=4, anchor_rows=5, share_rows=90, block_bytes=512)
    got = sorted(tuple(r) for r in hard_negatives.mine(vectors_of(spark, rows), F.col("vec_id") % 9 == 0, params=p).collect())
    assert got == plain_negatives(rows, lambda i: i % 9 == 0, p) and got


def test_bounds_leave_rows_at_home(spark):
    """Of clustered rows most are sent to few groups."""
    rows = [(i, v, label) for i, v, label in some_vectors("clusters", 600)]
    x = np.floor(np.array([v for _, v, _ in rows]) * 256).astype(np.int64)
    geometry = hard_negatives.Geometry(x[:20].tolist(), float((x.astype(float) ** 2).sum(axis=1).max()))
    far, near = geometry.rows(x), geometry.anchors(x[::9])
    true = np.sqrt(np.maximum(0.0, (x[::9].astype(float) ** 2).sum(axis=1)[:, None] + geometry.m2 - 2.0 * (x[::9] @ x.T)))
    for cell in range(far.shape[1]):  # the bounds hold
        low, high = np.abs(far[:, cell][None] - near[:, cell][:, None]), far[:, cell][None] + near[:, cell][:, None]
        assert (low <= true + geometry.slack).all() and (true <= high + geometry.slack).all()


def test_hard_negatives_match_sql_with_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = some_vectors("random", 300) + [(300, None, 1), (400, [1.0, None, *[0.0] * 6], 1), (500, [nan, *[0.0] * 7], 1), (501, [inf, *[0.0] * 7], 2), (600, [0.5] * 8, None), (700, [0.0] * 8, 3)]
    df = vectors_of(spark, rows)
    got = rows_of(hard_negatives.op13_hard_negatives(df))
    assert got == duck(df.select("vec_id", "embedding", "label"), hard_negatives.OP13_SQL, "embeddings") and got


def test_hard_negatives_odd_tables(spark):
    p = hard_negatives.Params()
    rows = [(0, [1.0, 1.0], 1), (0, [1.0, 1.0], 1), (1, [1.0, 1.0], 1), (2, [1.0, 0.5], 2), (2, [1.0, 0.5], 2), (3, [1.0, 0.5, 0.0], 2), (4, [], 2), (None, [1.0, 0.6], 2), (100, [5.0], 1), (200, [1e30, 1e30], 1)]
    got = sorted(tuple(r) for r in hard_negatives.mine(vectors_of(spark, rows), F.col("vec_id") % 100 == 0, params=p).collect())
    s, t = 2 * 256 * 256, 256 * 256 + 256 * 128
    assert got == [(0, 1, 1, 2, s, t), (0, 1, 2, 2, s, t)]
    assert hard_negatives.op13_hard_negatives(vectors_of(spark, [])).collect() == []
    assert hard_negatives.op13_hard_negatives(vectors_of(spark, [(1, [1.0], 1), (2, [1.0], 2)])).collect() == []
