"""Operators without SQL against plain Python, hot keys and odd inputs, and what operators leave alone."""

import math
import random
import textwrap
import warnings
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash

from loomcorpus.llm import ann, common, licenses, line_dedup, mixing, ngram_join, packing, quality_rules, substring_dedup, toxicity, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, size=4000):
    return [f"w{rng.randrange(size)}" for _ in range(n)]


def docs_of(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in zip(range(len(texts)) if ids is None else ids, texts, strict=True)], DOCS)


def duck(docs, sql, view="documents"):
    con = duckdb.connect()
    frame = docs.toPandas()
    con.register(view, frame)
    r = con.execute(sql)
    names = [x[0] for x in r.description]
    return sorted(repr(sorted(zip(names, row, strict=True))) for row in r.fetchall())


def rows_of(df):
    return sorted(repr(sorted(r.asDict().items())) for r in df.collect())


def test_slices_bound_rows_and_bytes():
    rng = random.Random(4)
    texts = ["x" * rng.choice([1, 10, 3_000_000]) for _ in range(40)] + ["y"] * 2000
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["i", "t"])
    parts = list(common.slices(batch))
    assert [i for p in parts for i in p.column(0).to_pylist()] == list(range(len(texts)))
    assert all(p.num_rows <= common.BATCH_ROWS and (p.num_rows == 1 or p.nbytes <= common.BATCH_BYTES) for p in parts)
    assert list(common.slices(batch.slice(0, 0))) == []


def test_dealt_join_loses_no_row(spark):
    rows = spark.createDataFrame([(i % 3 if i % 10 else i, i % 2, i) for i in range(3000)], "k long, j long, v long")
    counted = rows.groupBy("k", "j").agg({"v": "count"}).withColumnRenamed("count(v)", "copies").filter("copies > 1").cache()
    got = common.dealt_join(rows, counted, ["k", "j"], ["k"], "v").count()
    assert got == rows.join(counted, ["k", "j"]).count() > 2000
    assert common.dealt_join(rows, counted, ["k", "j"], ["k"], "v", how="left").count() == 3000


def test_no_operator_changes_the_session(spark, tmp_path):
    before = dict(spark.conf.getAll)
    docs = docs_of(spark, ["a b c d e f", "a b c d e f", "Released under the MIT License."])
    labels = spark.createDataFrame([(0, 1, 0), (1, 0, 1)], "doc_id long, quality int, toxic int")
    for op in (ngram_join.op1_ngram_join, substring_dedup.op2_substring_dedup, packing.op3_packing, quality_rules.op5_quality_rules, line_dedup.op6_line_dedup, licenses.op8_license_scan, lambda x: toxicity.op9_toxicity(x, labels), lambda x: mixing.op10_mixing(x, labels)):
        op(docs).collect()
    ann.op4_collision_search(spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")).collect()
    warc.op7_warc_assembly(spark.createDataFrame([(1, "u", "h")], "page_id long, url string, html string")).collect()
    assert dict(spark.conf.getAll) == before


# --- n-gram join


def test_long_texts_are_hashed_in_pieces(monkeypatch):
    rng = random.Random(12)
    texts = [" ".join(words(rng, n)) for n in (1, 3, 50, 4000)] + ["x" * 900 + " y z q r s", "", None, "  a\t b\nC d "]
    whole = [x.tolist() for x in ngram_join.shingles(texts, 4)]
    monkeypatch.setattr(ngram_join, "BLOCK_BYTES", 64)
    assert [x.tolist() for x in ngram_join.shingles(texts, 4)] == whole


@pytest.mark.parametrize("more", [{"broadcast_keys": 0}, {"group": 2, "list_rows": 2, "crowded": 3, "leaders": 2}])
def test_ngram_join_is_the_same_on_every_path(spark, more):
    """Keys too many for a broadcast, hot sets dealt into parts, long lists dealt into blocks."""
    rng = random.Random(31)
    texts = []
    for _ in range(3):
        base = words(rng, 80)
        for k in range(14):
            w = list(base)
            for _ in range(k % 7):
                w[rng.randrange(80)] = f"e{rng.randrange(9999)}"
            texts.append(" ".join(w))
    docs = docs_of(spark, texts)
    want = duck(docs, ngram_join.OP1_SQL)
    assert rows_of(ngram_join.link(docs, params=ngram_join.Params(**more))) == want


@pytest.mark.parametrize("task_edges", [3, 40, 10_000])
def test_components_of_chains_stars_and_cycles(spark, task_edges):
    rng = random.Random(9)
    names = rng.sample(range(-500, 500), 400)
    edges = [(names[i], names[i + 1]) for i in range(120)] + [(names[150], names[150 + i]) for i in range(1, 60)] + [(names[220 + i], names[220 + (i + 1) % 50]) for i in range(50)] + [(names[300], names[300]), (names[301], names[302])] * 2
    rng.shuffle(edges)
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r["node"]: r["root"] for r in ngram_join.components(spark.createDataFrame(edges, "a long, b long").repartition(7), task_edges).collect()}
    assert {x: got.get(x, x) for x in root} == {x: find(x) for x in root} and all(a > b for a, b in got.items() if a != b)


# --- substring dedup


def plain_cuts(b, p):
    """Chunk ends of one text, byte by byte."""
    gear = [0, *(xxhash.xxh3_64_intdigest(bytes([i])) >> 48 for i in range(1, 256))]
    ends, last = [], -p.min_bytes
    for i in range(len(b)):
        h = sum(gear[b[i - k]] << k for k in range(16) if i >= k) & 0xFFFF
        if h >> (16 - p.bits):
            continue
        end = i + 1
        while end < len(b) and b[end] & 0xC0 == 0x80:
            end += 1
        if end - last >= p.min_bytes and end < len(b) and (not ends or end > ends[-1]):
            ends.append(end)
        last = end
    return [0, *ends, len(b)] if b else [0]


def test_substring_passages_match_plain_python(spark):
    rng = random.Random(77)
    passages = [" ".join(words(rng, 60)), "\t".join(words(rng, 40)), "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(200)), "короткий текст " + " ".join(words(rng, 30))]
    texts = [" ".join([*words(rng, rng.randrange(3, 40)), rng.choice(passages), *words(rng, rng.randrange(3, 40))]) for _ in range(40)]
    texts += [passages[2], passages[2], texts[3], "", None, "x", "x", "\n".join([passages[0]] * 3), " ".join(words(rng, 30_000))]
    p, first, chunks = substring_dedup.Params(), {}, {}
    for d, t in enumerate(texts):
        b = (t or "").encode()
        c = plain_cuts(b, p)
        assert substring_dedup.cuts([b], p) == [c]
        chunks[d] = [(x, y, b[x:y], len([i for i in range(x, y) if b[i : i + 1].strip(b" \t\n\x0b\x0c\r") and (i == 0 or not b[i - 1 : i].strip(b" \t\n\x0b\x0c\r"))])) for x, y in zip(c, c[1:])]
        for x, _, piece, _ in chunks[d]:
            first.setdefault(piece, (d, x))
    want, whole = [], {d: (t or "").encode() for d, t in enumerate(texts)}
    for d, found in chunks.items():
        run = []
        for chunk in [*found, None]:
            at = chunk and first[chunk[2]]
            again = at and at != (d, chunk[0])
            if again and run and (at[0], at[1] - chunk[0]) == (first[run[0][2]][0], first[run[0][2]][1] - run[0][0]):
                run.append(chunk)
                continue
            if run and (sum(r[3] for r in run) >= p.min_words or run[-1][1] - run[0][0] >= p.least_bytes):
                want.append((d, run[0][0], run[-1][1] - run[0][0], sum(r[3] for r in run), len(run), [first[run[0][2]][0]]))
            run = [chunk] if again else []
    for d, start, length, _, _, (kept,) in want:
        assert whole[d][start : start + length] in whole[kept]
    got = [(r["doc_id"], r["start"], r["length"], r["n_words"], r["n_chunks"], r["kept_doc_ids"]) for r in substring_dedup.op2_substring_dedup(docs_of(spark, texts)).collect()]
    assert sorted(got) == sorted(want) and {41, 42} <= {x[0] for x in got}
    cut = {r["doc_id"]: r["text"] for r in substring_dedup.remove_repeated(docs_of(spark, texts)).collect()}
    for d, t in enumerate(texts):
        b = bytearray((t or "").encode())
        for _, start, length, *_ in sorted((x for x in want if x[0] == d), reverse=True):
            del b[start : start + length]
        assert cut[d] == (None if t is None else b.decode())


# --- nearest neighbours


def test_search_by_vector_length(spark):
    rows = [(0, [1.0, 0.0]), (100, [1.0, 0.0, 0.0]), (200, [0.0, 1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.0, 0.0, 2.0]), (300, [3.0]), (3, [])]
    got = {(r["query_id"], r["rank"]): (r["vec_id"], round(r["score"], 9)) for r in ann.op4_collision_search(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    assert got == {(0, 1): (1, round(math.sqrt(0.5), 9)), (100, 1): (200, round(math.sqrt(2), 9)), (100, 2): (2, round(math.sqrt(5), 9)), (200, 1): (100, round(math.sqrt(2), 9)), (200, 2): (2, round(math.sqrt(5), 9))}


def test_search_verifies_a_part(spark):
    """Recall over several blocks and shares, with few of the vectors looked at."""
    rng = np.random.default_rng(6)
    x = rng.standard_normal((6000, 32)).astype(np.float32)
    x[3000:] = x[rng.integers(0, 3000, 3000)] + 0.3 * rng.standard_normal((3000, 32)).astype(np.float32)
    p = ann.Params(block_rows=500, share_blocks=3)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = ann.search(df, df.filter("vec_id % 100 = 0"), params=p).collect()
    found = 0
    for q in range(0, 6000, 100):
        d = ((x.astype(float) - x[q].astype(float)) ** 2).sum(axis=1)
        d[q] = np.inf
        found += len({r["vec_id"] for r in got if r["query_id"] == q} & set(np.argsort(d, kind="stable")[:10].tolist()))
    assert found / 600 >= 0.95
    lines, verified = ann.projections(32, p), 0
    blocks = [ann.Block(np.arange(a, a + 500), x[a : a + 500].astype(float), lines) for a in range(0, 6000, 500)]
    for q in range(0, 6000, 100):
        best = (np.empty(0), np.empty(0, dtype=np.int64))
        for b in blocks:
            best, n = b.search(q, x[q].astype(float), x[q].astype(float) @ lines, best, p, p.reach())
            verified += n
    assert verified / (60 * 6000) < 0.4


# --- archives


def test_revisits_follow_refers_to(spark, tmp_path):
    """The response comes from the record that a revisit names, hot ones among them; a dangling name gives nulls."""
    big = "q" * 500
    rows = [(i, f"http://h/{i}", big if i % 3 else f"{i} " * 90) for i in range(5, 400)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for bound in (0, 1000):
        kept = {r["page_id"]: r["kept_id"] for r in warc.captures(pages, broadcast_rows=bound).collect()}
        assert kept == {i: 5 if i % 3 and i > 5 else None for i, _, _ in rows}
    warc.write_archives(pages, str(tmp_path / "w"))
    records = warc.read_archives(spark, str(tmp_path / "w")).cache()
    whole = {r["metadata"]["page_id"]: r for r in warc.assemble(records).collect()}
    assert len(whole) == len(rows) and all(r["request"]["record_id"] and r["main"]["target_uri"] == f"http://h/{i}" for i, r in whole.items())
    assert whole[7]["main"]["type"] == "revisit" and whole[7]["refers"].asDict() == {"record_id": whole[5]["main"]["record_id"], "page_id": 5, "payload_bytes": 500, "found_digest": whole[5]["main"]["found_digest"]}
    assert whole[5]["main"]["payload"] == big.encode() and whole[5]["refers"] is None
    lost = warc.assemble(records.filter(records["record_id"] != whole[5]["main"]["record_id"]), with_payload=False).filter("main.type = 'revisit'").collect()
    assert len(lost) == 262 and all(r["refers"] is None for r in lost)


# --- licences


def ended(sentences):
    return " ".join(licenses.SENTENCES[k] + ("" if licenses.SENTENCES[k][-1] in ":;" else ".") for k in sentences)


def test_licences_match_sql_in_every_layout(spark):
    whole = [ended(s) for _, _, s in licenses.RULES]
    layouts = [lambda s: s, lambda s: textwrap.fill(s, 72), lambda s: textwrap.fill(s, 60, initial_indent="// ", subsequent_indent="// ")]
    rng = random.Random(5)
    texts = [f"{' '.join(words(rng, 5))}\n\n{w(s)}\n{' '.join(words(rng, 9))}." for w in layouts for s in rng.sample(whole, 60)]
    texts += ["\n".join(rng.sample(whole, 3)) for _ in range(20)] + [w(whole[0]).replace("MIT", "BIT") for w in layouts] + [None, "", " ".join(words(rng, 20_000)) + ". " + whole[3]]
    texts += ["Released\nunder the\n\nMIT License", "Licensed under the Apache License, Version 2.0 (the\n\"License\")", "Licensed under the Apache License. Version 2.0."]
    docs = docs_of(spark, texts)
    got = licenses.op8_license_scan(docs)
    assert rows_of(got) == duck(docs, licenses.OP8_SQL)
    assert {r["doc_id"] for r in got.collect()} >= set(range(200)) - {200}


# --- toxicity


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def plain_features(text, terms, stems, p):
    low = (text or "").lower()
    spans = list(toxicity.WORD.finditer(low))
    sums = Counter()
    for i, m in enumerate(spans):
        w = m.group()
        kind = "stem" if any(w.startswith(s) for s in stems) else "exact" if w in terms else "near" if any(len(t) >= p.edits_from and edits(w, t) == 1 for t in terms) else None
        if kind is None:
            continue
        near = spans[max(0, i - p.window) : i + p.window + 1]
        before, after = low[near[0].start() : m.start()], low[m.end() : near[-1].end()]
        marked = sum(before.count(q) for q in toxicity.QUOTES) % 2 and any(q in after for q in toxicity.QUOTES)
        told = ":" in before and any(x.group() in toxicity.SPEECH for x in near if x.start() < m.start())
        sums["quoted" if marked or told else kind] += 1
    abuse = sum(v for k, v in sums.items() if k != "quoted")
    return [math.log1p(sums[k]) for k in ("exact", "stem", "near", "quoted")] + [100 * abuse / max(1, len(spans)), float(abuse > 0)]


def plain_newton(x, y):
    """Ridge logistic regression by plain gradient steps with halving, to convergence."""
    x, w, ridge = np.c_[x, np.ones(len(x))], np.zeros(len(x[0]) + 1), np.array([1.0] * len(x[0]) + [1e-6])
    value = lambda w: float((np.logaddexp(0, x @ w) - y * (x @ w)).sum() + (ridge * w * w).sum() / 2)
    for _ in range(200):
        q = 1 / (1 + np.exp(-(x @ w)))
        g = x.T @ (q - y) + ridge * w
        step = np.linalg.inv(x.T @ np.diag(q * (1 - q)) @ x + np.diag(ridge)) @ g
        rate = 1.0
        while value(w - rate * step) > value(w) and rate > 1e-9:
            rate /= 2
        w = w - rate * step
        if np.abs(g).max() < 1e-10:
            break
    return w


def plain_terms(rows, purity, lengths, p):
    t, c = Counter(), Counter()
    for text, label in rows:
        ws = {w for w in toxicity.WORD.findall((text or "").lower()) if 3 < len(w) < 40}
        (t if label else c).update(ws | {w[:n] + "*" for w in ws for n in lengths if len(w) > n})
    least = max(p.least_rows, p.least_share * sum(label for _, label in rows))
    found = sorted((x for x in t if t[x] >= least and t[x] / (t[x] + c[x] + 0.5) >= purity), key=lambda x: (-t[x], x))[: p.terms]
    terms, stems = set(toxicity.SEED_TERMS), set()
    for x in sorted(found, key=lambda x: (len(x.rstrip("*")) + x.endswith("*"), x)):
        if any(x.rstrip("*")[: len(s)] == s for s in stems):
            continue
        if not x.endswith("*"):
            terms.add(x)
        elif 4 * t[x] >= 5 * max((t[w] for w in found if not w.endswith("*") and w.startswith(x[:-1])), default=0):
            stems.add(x[:-1])
    return terms, stems


def test_toxicity_matches_plain_python(spark):
    """Setting, terms, weights and scores, from training rows alone."""
    rng = random.Random(41)
    endings = ["ed", "ing", "er", "s", "ly", "ist"]
    texts, labels = [], []
    for i in range(400):
        w, toxic = words(rng, rng.randrange(5, 60), 300), int(rng.random() < 0.3)
        for _ in range(rng.randrange(1, 4) if toxic else 0):
            w.insert(rng.randrange(len(w)), rng.choice(["grobnak", "vilquor", "gorbnak", "snarfel" + rng.choice(endings), "idiot"]))
        if not toxic and rng.random() < 0.1:
            w += ["he", "said:", '"you', "grobnak", 'there"', *words(rng, 4, 300)]
        if rng.random() < 0.15:
            w.append("mixword")
        texts.append(" ".join(w))
        labels.append((i, 1, toxic))
    texts += [None, "", texts[0]]
    labels += [(3, 1, 1), (900, 1, 1), (None, 1, 1), (400, 1, None)]
    p = toxicity.Params()
    docs, labelled = docs_of(spark, texts), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    known = {}
    for i, _, y in labels:
        if i is not None and y is not None and i < len(texts):
            known[i] = min(y, known.get(i, y))
    train = [(texts[i], y) for i, y in sorted(known.items()) if zlib.crc32(str(i).encode()) % 5]
    parts = {r["text"]: r["part"] for r in toxicity.training_rows(docs, labelled, p).collect()}
    best = None
    for lengths in p.stems:
        for purity in p.purities:
            loss = 0.0
            for part in range(p.parts):
                rest = [x for x in train if parts[x[0]] != part]
                lexicon = plain_terms(rest, purity, lengths, p)
                w = plain_newton(np.array([plain_features(t, *lexicon, p) for t, _ in rest]), np.array([y for _, y in rest], dtype=float))
                for t, y in train:
                    if parts[t] == part:
                        z = float(np.dot(w[:-1], plain_features(t, *lexicon, p)) + w[-1])
                        loss += math.log1p(math.exp(-abs(z))) + max(z, 0) - y * z
            if best is None or loss < best[0] - 1e-6:
                best = (loss, purity, lengths)
    model = toxicity.fit(docs, labelled)
    assert model.setting == best[1:]
    terms, stems = plain_terms(train, *best[1:], p)
    assert (set(model.words) ^ terms, set(model.stems) ^ stems) == (set(), set())
    assert "gorbnak" in terms and "snar" in stems
    weights = plain_newton(np.array([plain_features(t, terms, stems, p) for t, _ in train]), np.array([y for _, y in train], dtype=float))
    got = {r["doc_id"]: r for r in toxicity.op9_toxicity(docs, labelled).collect()}
    for i, t in enumerate(texts):
        z = float(np.dot(weights[:-1], plain_features(t, terms, stems, p)) + weights[-1])
        assert abs(got[i]["score"] - 1 / (1 + math.exp(-z))) < 1e-4 and got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)


def test_held_out_labels_change_nothing(spark):
    rng = random.Random(43)
    texts = [" ".join([*words(rng, 20, 300), *(["grobnak"] if i % 4 == 0 else [])]) for i in range(120)]
    labels = [(i, 1, int(i % 4 == 0)) for i in range(120)]
    turned = [(i, q, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, q, y in labels]
    a, b = (rows_of(toxicity.op9_toxicity(docs_of(spark, texts), spark.createDataFrame(x, "doc_id long, quality int, toxic int"))) for x in (labels, turned))
    assert a == b


# --- mixing


def plain_posteriors(texts, labels, p):
    """Naive Bayes over cells and counts of marking terms, in plain Python."""
    def parts(t):
        ws = [w for w in (t or "").lower().replace("\t", " ").split() if w]
        cell = min(int(math.log2(len(ws) + 1)), 15) * 1000 + (len(set(ws)) * 10 // max(1, len(ws))) * 20 + min(sum((t or "").count(c) for c in mixing.SYMBOLS) * 5 // max(1, len(ws)), 10)
        return len(ws), cell, {w[: p.prefix] for w in ws}

    seen = {i: parts(t) for i, t in enumerate(texts)}
    count = Counter(labels.values())
    marks = {}
    for d in mixing.DOMAINS[1:]:
        own, rest = Counter(), Counter()
        for i, y in labels.items():
            for t in seen[i][2]:
                own[t] += y == d
                rest[t] += sum((1 / max(1, count[x]) for x in mixing.DOMAINS if x != d and x == y), 0.0)
        fine = [t for t in own if own[t] >= max(p.least_rows, p.least_share * count[d]) and own[t] / max(1, count[d]) > p.lift * rest[t]]
        marks[d] = set(sorted(fine, key=lambda t: (-own[t], t))[: p.terms])
    key = lambda i: sum(min(len(marks[d] & seen[i][2]), 4) * 5 ** (len(marks) - 1 - k) for k, d in enumerate(marks))
    tables = []
    for of in (lambda i: seen[i][1], key):
        cells = {of(i) for i in labels}
        tables.append((of, {k: [math.log((sum(of(i) == k and y == d for i, y in labels.items()) + 0.5) / (count[d] + 0.5 * len(cells))) for d in mixing.DOMAINS] for k in cells}))
    out = []
    for i in range(len(texts)):
        z = [math.log((count[d] + 1) / (len(labels) + len(mixing.DOMAINS))) for d in mixing.DOMAINS]
        for of, table in tables:
            z = [a + (table[of(i)][d] if of(i) in table else min(v[d] for v in table.values())) for d, a in enumerate(z)]
        e = [math.exp(a - max(z)) for a in z]
        out.append((seen[i][0], [x / sum(e) for x in e]))
    return out


def nnls(tokens, posterior, targets, most=np.inf, steps=60_000):
    """Least squares with bounds, one rate for each document, by accelerated projected gradient steps."""
    a = np.array(tokens)[:, None] * np.array(posterior)
    size = np.linalg.norm(a, 2) ** 2
    r = y = np.ones(len(a))
    t = 1.0
    for _ in range(steps):
        new = np.clip(y - a @ (a.T @ y - targets) / size, 0, most)
        t, before = (1 + math.sqrt(1 + 4 * t * t)) / 2, t
        y, r = new + (before - 1) / t * (new - r), new
    return float(np.linalg.norm(a.T @ r - targets))


def mixed(spark, seed=19, kinds=(0, 1)):
    rng = random.Random(seed)
    texts, labels = [], {}
    for i in range(240):
        w, kind = words(rng, rng.randrange(20, 90)), rng.randrange(8)
        if kind == 0 and 0 in kinds:
            w[::5] = ["vilexor"] * len(w[::5])
        if kind == 1 and 1 in kinds:
            w = [f"{x}%%" for x in w]
        texts.append(" ".join(w))
        if i % 3:
            labels[i] = "toxic" if kind == 0 and 0 in kinds else "low" if kind == 1 and 1 in kinds else "clean"
    texts += [None, "", texts[5]]
    rows = [(i, int(y != "low"), int(y == "toxic")) for i, y in labels.items()]
    return docs_of(spark, texts), spark.createDataFrame(rows, "doc_id long, quality int, toxic int"), texts, labels


@pytest.mark.parametrize("more", [{}, {"total": 9000.0, "weights": {"clean": 0.5, "low": 0.3, "toxic": 0.2}}, {"most_rate": 1.0}, {"total": 2000.0, "most_rate": 1.0}])
def test_mixing_matches_plain_python(spark, more):
    p = mixing.Params(**more)
    docs, labelled, texts, labels = mixed(spark)
    want = plain_posteriors(texts, labels, p)
    m = mixing.fit(docs, labelled, p)
    rows = {r["doc_id"]: r for r in mixing.rated(m).collect()}
    for i, (n, post) in enumerate(want):
        assert rows[i]["__tokens"] == n and np.allclose([rows[i][f"__p{d}"] for d in range(3)], post, atol=1e-9)
        assert 0 <= rows[i]["__rate"] <= p.most_rate and rows[i]["__copies"] in (math.floor(rows[i]["__rate"]), math.floor(rows[i]["__rate"]) + 1)
    tokens, posterior = [n for n, _ in want], [x for _, x in want]
    reached = np.array(posterior).T @ (np.array(tokens) * np.array([rows[i]["__rate"] for i in range(len(texts))]))
    assert np.allclose(reached, m.reached, rtol=1e-6)
    assert abs(np.linalg.norm(np.array(m.targets) - reached) - nnls(tokens, posterior, np.array(m.targets), p.most_rate)) <= 2e-3 * sum(m.targets)
    if p.total:
        assert math.isclose(sum(m.targets), p.total)
    out = mixing.mix(docs, labelled, p)
    assert out.columns == docs.columns and Counter(r["doc_id"] for r in out.collect()) == Counter({i: r["__copies"] for i, r in rows.items() if r["__copies"]})


def test_mixing_says_what_it_misses(spark):
    docs, labelled, _, _ = mixed(spark, kinds=())
    with warnings.catch_warnings():
        warnings.simplefilter("error", UserWarning)
        m = mixing.fit(docs, labelled)  # nothing is low or toxic, and the fit stands still
    assert m.residual > 0
    one = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert len(mixing.op10_mixing(docs, one).collect()) == 243
    rows = spark.createDataFrame([(100, 0.9, 0.1, 0.0), (50, 0.1, 0.8, 0.1), (10, 0.0, 0.1, 0.9)], "__tokens long, __p0 double, __p1 double, __p2 double")
    with pytest.warns(UserWarning, match="misses a target"):
        mixing.fit_rates(rows, mixing.Params(steps=1, most_rate=1.2, total=150.0, weights={"clean": 0.1, "low": 0.2, "toxic": 0.7}))


# --- the pipeline


def test_pipeline_stages_on_odd_tables(spark, tmp_path):
    import corpus_pipeline

    labels = spark.createDataFrame([(0, 1, 0), (1, 0, 1)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    rng = random.Random(3)
    texts = [" ".join(words(rng, 60)) for _ in range(4)] + [None, "", " ".join(words(rng, 30_000))]
    more = ["id", "text_key", "digest", "n", "row_key", "copies", "rate", "length", "start"]
    rows = [(i if t else None, t, "en", "s", len(t or ""), *["x"] * len(more)) for i, t in enumerate([*texts, texts[0], texts[0]])]
    wide = spark.createDataFrame(rows, DOCS + "".join(f", {c} string" for c in more))
    for docs in (wide, wide.limit(0)):
        here = docs
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, here, str(tmp_path))
            kept = out.collect()
            if name == "packing":
                assert {r["doc_id"] for r in kept} <= {r["doc_id"] for r in rows_before}
                continue
            assert out.columns == docs.columns, name
            rows_before = kept
            here = spark.createDataFrame(kept, out.schema)
        assert len({r["text"] for r in rows_before}) == len(rows_before) and (len(rows_before) >= 4 or docs is not wide)
