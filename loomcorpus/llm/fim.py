"""Fill-in-middle transformation by succinct rank and select over code points.

A batch of texts is one byte string.  A packed bit vector marks the bytes at which a code point starts, and a
directory holds how many starts stand before each block of 512 bits.  The number of a text's code points is the
difference of two ranks (popcounts of whole blocks from the directory, of words within a block); a cut after c
code points is the select of the text's first rank plus c, a byte position, so texts are cut as bytes and never
decoded.  Draws come from a hash of seed and id: a task that is run again makes the same rows.

Defined cases: a null text is the empty one, and an empty text is plain; so is one that contains a mark, which no
reader could tell from the marks put in.  A null id draws as an id of no digits.  Repeated rows are the same row
each; a long text is a part of its own; bytes that start no code point go with the code point before them; other
columns are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomcorpus.llm.common import arrow_map

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
WORDS = 8  # words of 64 bits in a block of the directory


@dataclass(frozen=True)
class Params:
    seed: int = 1
    transformed: int = 90  # of 100 texts; the others stay plain
    suffix_first: int = 20  # of 100 transformed texts


class CodePoints:
    """Rank and select over the starts of code points in a byte string; its end counts as one more start."""

    def __init__(self, data: np.ndarray) -> None:
        starts = np.append((data & 0xC0) != 0x80, True)
        packed = np.packbits(starts, bitorder="little")
        whole = np.zeros((len(packed) // (8 * WORDS) + 1) * 8 * WORDS, np.uint8)
        whole[: len(packed)] = packed
        self.words = whole.view("<u8").reshape(-1, WORDS)
        self.counts = np.bitwise_count(self.words).astype(np.int64)
        self.directory = np.append(0, np.cumsum(self.counts.sum(axis=1)))

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Starts before each byte position."""
        block, word, bit = at >> 9, (at >> 6) % WORDS, (at & 63).astype(np.uint64)
        within = np.where(np.arange(WORDS) < word[:, None], self.counts[block], 0).sum(axis=1)
        below = np.bitwise_count(self.words[block, word] & ((np.uint64(1) << bit) - np.uint64(1)))
        return self.directory[block] + within + below

    def select(self, k: np.ndarray) -> np.ndarray:
        """The byte position of each start, counted from 0."""
        block = np.searchsorted(self.directory, k, side="right") - 1
        left, upto = k - self.directory[block], np.cumsum(self.counts[block], axis=1)
        word = (upto <= left[:, None]).sum(axis=1)
        left = left - np.where(word > 0, np.take_along_axis(upto, np.maximum(word - 1, 0)[:, None], axis=1)[:, 0], 0)
        bits = np.unpackbits(np.ascontiguousarray(self.words[block, word]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        bit = np.argmax(np.cumsum(bits, axis=1) > left[:, None], axis=1)
        return (block * WORDS + word) * 64 + bit


def draws(id_col: str, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers of seed and id: the first groups of eight digits of a hash."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def _cut(batch: pa.RecordBatch, p: Params) -> pa.RecordBatch:
    texts = batch.column(1).fill_null("").cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[ends[0] : ends[-1]] if raw is not None else np.empty(0, np.uint8)
    ends = ends - ends[0]
    points, whole = CodePoints(data), data.tobytes()
    ranks = points.rank(ends)
    n = np.diff(ranks)
    h = [batch.column(2 + i).to_numpy() for i in range(4)]
    a, b = h[0] % (n + 1), h[1] % (n + 1)
    first, last = np.minimum(a, b), np.maximum(a, b)
    cut, cut2 = (np.minimum(points.select(ranks[:-1] + c), ends[1:]) for c in (first, last))
    plain, suffix_first = h[2] % 100 >= p.transformed, h[3] % 100 < p.suffix_first
    form, out = [], []
    for i, (at, x, y, end) in enumerate(zip(ends[:-1].tolist(), cut.tolist(), cut2.tolist(), ends[1:].tolist(), strict=True)):
        text = whole[at:end]
        if plain[i] or not text or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
            form.append("plain")
            out.append(text)
            continue
        head, tail = (PREFIX, whole[at:x]), (SUFFIX, whole[y:end])
        form.append("spm" if suffix_first[i] else "psm")
        out.append(b"".join((*(tail + head if suffix_first[i] else head + tail), MIDDLE, whole[x:y])))
    spans = [pa.array(v, pa.int64(), mask=np.array([f == "plain" for f in form])) for v in (first, last - first)]
    text = pa.array(out, pa.large_binary() if pa.types.is_large_string(batch.column(1).type) else pa.binary()).view(batch.column(1).type)
    return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(form, pa.string()), *spans, text], names=["id", "n", "form", "prefix_chars", "middle_chars", "output"])


def transformed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", params: Params = Params()) -> DataFrame:
    """One row a document: id, n (code points), form (plain, psm or spm), prefix_chars, middle_chars, output.

    A map over rows: nothing is shuffled, and a task holds one part of a batch.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *(h.alias(f"h{i}") for i, h in enumerate(draws(id_col, params.seed))))
    schema = f"id {kind}, n long, form string, prefix_chars long, middle_chars long, output string"
    return arrow_map(rows, lambda batch: _cut(batch, params), schema).withColumnRenamed("id", id_col)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of; the parts of psm and spm stand between marks that no part contains."""
    parts = F.split(output, "<[PSM]>", -1)
    a, b, middle = F.get(parts, 1), F.get(parts, 2), F.get(parts, 3)
    return F.when(form == "psm", F.concat(a, middle, b)).when(form == "spm", F.concat(b, middle, a)).otherwise(output)


def op11_fill_in_middle(docs: DataFrame) -> DataFrame:
    """The contract's columns, with digests of what the operator made and of what is read back from it."""
    rows = transformed(docs)
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


OP11_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS x, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
e AS (SELECT *, length(x)::BIGINT AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN n = 0 OR contains(x, '<P>') OR contains(x, '<S>') OR contains(x, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM e),
g AS (SELECT *, substring(x, 1, a) AS p, substring(x, a + 1, b - a) AS m, substring(x, b + 1, n - b) AS s FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN x WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(x) AS restored_sha256
FROM g"""
