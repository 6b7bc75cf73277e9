"""Quality rules as a bitmask ledger.

Every rule is evaluated once for a document.  The ledger keeps the measurements and one failure bit
for each rule; a policy is a versioned set of bits, so verdicts of any policy, and what each of its
rules adds, come from bitwise operations on the ledger without touching the texts again.

Defined cases: a null text counts as empty (no words: it fails BASE_WORDS); rows are judged one by
one, so repeated rows get equal verdicts; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomcorpus.llm.common import SPACE, arrow_map, encode

SYMBOLS = "#*$%&|<>"
WINDOW = 8
MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]
#: Bits of the ledger, in this order.  Integer comparisons only, so that every engine agrees.
RULES = {
    "BASE_WORDS": lambda m: m["n_words"] < 20,
    "BASE_REPEATS": lambda m: m["n_repeat_words"] * 100 > m["n_words"] * 30,
    "SYMBOLS": lambda m: m["n_symbols"] * 100 > m["n_words"] * 40,
    "DUP_LINES": lambda m: m["n_dup_lines"] * 100 > m["n_lines"] * 50,
    "SHORT_WORDS": lambda m: m["word_chars"] * 10 < m["n_words"] * 20,
    "LONG_WORDS": lambda m: m["word_chars"] > m["n_words"] * 15,
}
BIT = {name: 1 << i for i, name in enumerate(RULES)}


@dataclass(frozen=True)
class Policy:
    """A version of the verdict: a document is kept if none of the named rules failed."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(BIT[r] for r in self.rules)


POLICIES = {
    p.version: p
    for p in (
        Policy("v1-base", ("BASE_WORDS", "BASE_REPEATS")),
        Policy("v2-full", tuple(RULES)),
    )
}


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window found at least twice; windows are compared by their bytes."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    # Every word has its smallest number; equal sums are candidates, then the words are compared.
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    mixed = np.zeros(n, dtype=np.uint64)
    for k in range(window):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n]
    order = np.argsort(mixed, kind="stable")
    same = mixed[order[1:]] == mixed[order[:-1]]
    if not same.any():
        return 0
    hit = np.zeros(n, dtype=bool)
    hit[order[1:][same]] = hit[order[:-1][same]] = True
    starts = np.flatnonzero(hit)
    exact = Counter(tuple(words[i : i + window]) for i in starts.tolist())
    covered = np.zeros(len(words) + 1, dtype=np.int64)
    for i in starts.tolist():
        if exact[tuple(words[i : i + window])] > 1:
            covered[i] += 1
            covered[i + window] -= 1
    return int((np.cumsum(covered) > 0).sum())


def measure(text: str | None) -> tuple[int, ...]:
    """The measurements of one text, in the order of MEASURES."""
    text = text or ""
    words = encode(text).split()
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    return (
        len(words),
        len(text) - sum(text.count(c) for c in SPACE),
        sum(text.count(c) for c in SYMBOLS),
        len(lines),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, measurements, fail_bits.  A map over rows: nothing is shuffled."""

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [measure(t) for t in batch.column(1).to_pylist()]
        cols = [pa.array([r[i] for r in rows], pa.int64()) for i in range(len(MEASURES))]
        return pa.RecordBatch.from_arrays([batch.column(0), *cols], names=["id", *MEASURES])

    kind = docs.schema[id_col].dataType.simpleString()
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = arrow_map(narrow, fn, f"id {kind}, " + ", ".join(f"{m} long" for m in MEASURES))
    m = {c: F.col(c) for c in MEASURES}
    bits = sum((F.when(rule(m), F.lit(BIT[r])).otherwise(F.lit(0)) for r, rule in RULES.items()), F.lit(0))
    return out.select(F.col("id").alias(id_col), *MEASURES, bits.cast("long").alias("fail_bits"))


def failed(policy: Policy) -> Column:
    """Of a ledger: whether the policy rejects the row."""
    return F.col("fail_bits").bitwiseAND(F.lit(policy.mask)) != 0


def ablation(rows: DataFrame, policies: dict[str, Policy] = POLICIES) -> DataFrame:
    """For each policy and rule: rows that fail it, and rows that only this rule of the policy rejects.

    One aggregation with a fixed number of sums over the bits; the texts aren't read again.
    """
    def total(hit: Column, name: str) -> Column:
        return F.coalesce(F.sum(F.when(hit, 1).otherwise(0)), F.lit(0)).cast("long").alias(name)

    cells, bits = [], F.col("fail_bits")
    for v, p in policies.items():
        for r in p.rules:
            cells.append((v, r, total(bits.bitwiseAND(F.lit(BIT[r])) != 0, f"f_{len(cells)}"), total(bits.bitwiseAND(F.lit(p.mask)) == BIT[r], f"o_{len(cells)}")))
    one = rows.agg(*(c for _, _, f, o in cells for c in (f, o)))
    table = F.array(*(F.struct(F.lit(v).alias("policy"), F.lit(r).alias("rule"), F.col(f"f_{i}").alias("n_failed"), F.col(f"o_{i}").alias("n_only")) for i, (v, r, _, _) in enumerate(cells)))
    return one.select(F.explode(table).alias("x")).select("x.*")


def filter_documents(docs: DataFrame, policy: Policy = POLICIES["v2-full"], text_col: str = "text") -> DataFrame:
    """The documents that the policy keeps, with all their columns, in one pass over the rows."""
    schema, at, mask = docs.schema, docs.columns.index(text_col), policy.mask

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep = []
        for t in batch.column(at).to_pylist():
            m = dict(zip(MEASURES, measure(t), strict=True))
            keep.append(not sum(BIT[r] for r, rule in RULES.items() if rule(m)) & mask)
        return batch.filter(pa.array(keep, pa.bool_()))

    return arrow_map(docs, fn, schema)


def op5_quality_rules(docs: DataFrame) -> DataFrame:
    """The contract's columns, derived from the ledger; kept follows policy v2-full."""
    base, full = POLICIES["v1-base"], POLICIES["v2-full"]
    return ledger(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed(base).alias("base_failed"), (~failed(full)).alias("kept"), "n_lines", "fail_bits",
    )


#: The same by DuckDB, over the view documents.
OP5_SQL = r"""
WITH t AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
wins AS (
  SELECT rid, i, array_to_string(w[i:i+7], ' ') AS g
  FROM (SELECT rid, w, unnest(range(1, len(w) - 6)) AS i FROM t WHERE len(w) >= 9)),
hits AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM wins) WHERE c > 1),
cover AS (SELECT rid, count(DISTINCT i + k) AS n FROM hits, (SELECT unnest(range(8)) AS k) GROUP BY rid),
lines AS (
  SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup
  FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM t)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
m AS (
  SELECT doc_id, len(w) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         coalesce(n_lines, 0) AS n_lines, coalesce(n_dup, 0) AS n_dup_lines, coalesce(cover.n, 0) AS n_repeat_words
  FROM t LEFT JOIN cover USING (rid) LEFT JOIN lines USING (rid)),
b AS (
  SELECT *, (CASE WHEN n_words < 20 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END)
          + (CASE WHEN 100 * n_symbols > 40 * n_words THEN 4 ELSE 0 END) + (CASE WHEN 100 * n_dup_lines > 50 * n_lines THEN 8 ELSE 0 END)
          + (CASE WHEN 10 * word_chars < 20 * n_words THEN 16 ELSE 0 END) + (CASE WHEN word_chars > 15 * n_words THEN 32 ELSE 0 END) AS bits FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
       n_repeat_words::BIGINT AS n_repeat_words, (bits & 3) <> 0 AS base_failed, bits = 0 AS kept, n_lines::BIGINT AS n_lines, bits::BIGINT AS fail_bits
FROM b"""
