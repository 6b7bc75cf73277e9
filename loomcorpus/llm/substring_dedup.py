"""Substring dedup by content-defined chunking with a gear rolling hash.

A text is cut where the upper bits of a gear hash over the last 16 bytes are zero; a cut depends on
those bytes alone, so an insertion moves no cut behind it.  Chunks are counted by a digest of 128 bits over
the corpus.  Runs of adjacent chunks that were first seen side by side in one document (smaller id, then position)
are the repeated passages, if they have `min_words` words or `least_bytes` bytes (texts without white space have no
words to count); the first occurrence stays, so a passage stands whole in the document that keeps it.

Texts are cut once; the chunks are written, counted, and joined with the digests found twice.

Defined cases: a null text counts as empty; an empty text has no chunks and a null or empty one no passage;
rows equal in id and text are one document (they keep or lose a passage together), and chunks at the same
place of rows with one id are one occurrence; a text is cut between characters only; very long texts are cut
whole; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomcorpus.llm.common import arrow_map, dealt_join, encode, row_key, written

#: 16 random bits for each byte; byte 0 has none, so that a run of 16 zero bytes starts the hash anew.
GEAR = np.array([0, *(xxhash.xxh3_64_intdigest(bytes([i])) >> 48 for i in range(1, 256))], dtype=np.uint16)
#: The first byte of each word.
STARTS = re.compile(rb"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D]")
PAD = bytes(16)
GROUP_BYTES = 1 << 20


@dataclass(frozen=True)
class Params:
    bits: int = 5  # a cut at one byte in 2 ** bits
    min_bytes: int = 12  # a cut that follows another more closely is none
    min_words: int = 12  # of a run that is reported,
    least_bytes: int = 150  # or its bytes


def cuts(blobs: list[bytes], p: Params) -> list[list[int]]:
    """For each text, the chunk bounds: 0, ..., its length.  All texts of a group are hashed at once."""
    data = np.frombuffer(PAD.join([*blobs, b""]) + b"\x00", dtype=np.uint8)
    h = GEAR[data]
    for k in (1, 2, 4, 8):  # doubling: the sum over the last 2 k bytes from two sums over k
        h[k:] += h[:-k] << np.uint16(k)
    ends = np.flatnonzero(h >> np.uint16(16 - p.bits) == 0) + 1
    ends = ends[ends < len(data)]
    for _ in range(3):
        ends = ends + ((data[ends] & 0xC0) == 0x80)
    ends = np.unique(ends)
    near = np.concatenate([[False], ends[1:] - ends[:-1] < p.min_bytes])
    ends = ends[~near]
    out, at = [], 0
    starts = np.cumsum([0] + [len(b) + len(PAD) for b in blobs])
    first = np.searchsorted(ends, starts)
    for b, lo, hi in zip(blobs, first[:-1], first[1:], strict=True):
        inner = ends[lo:hi] - at
        out.append([0, *inner[(inner > 0) & (inner < len(b))].tolist(), len(b)] if b else [0])
        at += len(b) + len(PAD)
    return out


def chunk_rows(keyed: DataFrame, p: Params) -> DataFrame:
    """Of rows (row_key, text): row_key, no, start, length, words and digest (d1, d2) of each chunk."""

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        row, no, start, length, words, digest = [], [], [], [], [], []

        def flush(first: int, blobs: list[bytes]) -> None:
            for i, (b, c) in enumerate(zip(blobs, cuts(blobs, p), strict=True), first):
                n = len(c) - 1
                row.extend([i] * n)
                no.extend(range(n))
                start.extend(c[:-1])
                for x, y in zip(c, c[1:]):
                    length.append(y - x)
                    words.append(len(STARTS.findall(b, x, y)))
                    digest.append(xxhash.xxh3_128_digest(b[x:y]))

        blobs, size, first = [], 0, 0
        for i, text in enumerate(batch.column(1)):
            blobs.append(encode(text.as_py()))
            size += len(blobs[-1])
            if size >= GROUP_BYTES:
                flush(first, blobs)
                first, blobs, size = i + 1, [], 0
        if blobs:
            flush(first, blobs)
        halves = np.frombuffer(b"".join(digest), dtype="<i8").reshape(-1, 2)
        cols = [batch.column(0).take(pa.array(row, pa.int64())), *(pa.array(x, pa.int32()) for x in (no, start, length, words)), *(pa.array(np.ascontiguousarray(halves[:, j])) for j in (0, 1))]
        return pa.RecordBatch.from_arrays(cols, names=["row_key", "no", "start", "length", "words", "d1", "d2"])

    kind = keyed.schema["row_key"].dataType.simpleString()
    return arrow_map(keyed, fn, f"row_key {kind}, no int, start int, length int, words int, d1 long, d2 long")


def runs_of(found: list[dict], p: Params) -> list[tuple[int, int, int, int, list]]:
    """(start, length, words, chunks, ids that keep it) of each run of adjacent repeated chunks, kept side by side in one document, that is a passage."""
    out, run = [], []
    for x in [*sorted(found, key=lambda x: x["no"]), None]:
        if x and run and x["no"] == run[-1]["no"] + 1 and (x["kept_id"], x["kept_start"] - x["start"]) == (run[0]["kept_id"], run[0]["kept_start"] - run[0]["start"]):
            run.append(x)
            continue
        n_words, length = (sum(r[k] for r in run) for k in ("words", "length"))
        if run and (n_words >= p.min_words or length >= p.least_bytes):
            out.append((run[0]["start"], length, n_words, len(run), [run[0]["kept_id"]] if run[0]["kept_id"] is not None else []))
        run = [x] if x else []
    return out


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", params: Params = Params()) -> DataFrame:
    """The repeated passages: row_key, start and length in bytes, n_words, n_chunks, kept_ids (where it stays)."""
    p = params
    chunks = written(chunk_rows(docs.select(row_key(id_col, text_col).alias("row_key"), F.col(text_col).alias("text")), p), "chunks")
    place = F.struct(F.col("row_key.id").alias("id"), "start")
    many = written(chunks.groupBy("d1", "d2").agg(F.count(F.lit(1)).alias("copies"), F.min(place).alias("kept")).filter("copies > 1"), "repeated_chunks")
    hits = dealt_join(chunks, many, ["d1", "d2"], ["d1", "d2"], "row_key").filter(~place.eqNullSafe(F.col("kept")))
    per = hits.groupBy("row_key").agg(F.collect_set(F.struct("no", "start", "length", "words", F.col("kept.id").alias("kept_id"), F.col("kept.start").alias("kept_start"))).alias("hits"))
    id_type = docs.schema[id_col].dataType.simpleString()

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [(i, *run) for i, hits in enumerate(batch.column(1)) for run in runs_of(hits.as_py(), p)]
        row, *numbers, kept = zip(*found, strict=True) if found else ([],) * 6
        names = ["start", "length", "n_words", "n_chunks"]
        ids = pa.list_(batch.column(1).type.value_type.field("kept_id").type)
        cols = [batch.column(0).take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in numbers), pa.array(kept, ids)]
        return pa.RecordBatch.from_arrays(cols, names=["row_key", *names, "kept_ids"])

    kind = chunks.schema["row_key"].dataType.simpleString()
    return arrow_map(per, fn, f"row_key {kind}, start long, length long, n_words long, n_chunks long, kept_ids array<{id_type}>")


def remove_repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", params: Params = Params()) -> DataFrame:
    """The documents without their repeated passages; all columns and rows stay."""
    spans = repeated(docs, id_col, text_col, params).groupBy("row_key").agg(F.collect_list(F.struct("start", "length")).alias("__spans")).withColumnRenamed("row_key", "__row_key")
    joined = docs.withColumn("__row_key", row_key(id_col, text_col)).join(spans, "__row_key", "left").drop("__row_key")
    at, schema = docs.columns.index(text_col), docs.schema

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = []
        for text, spans in zip(batch.column(at).to_pylist(), batch.column(len(schema)).to_pylist(), strict=True):
            if spans:
                b, here, parts = encode(text), 0, []
                for s in sorted(spans, key=lambda s: s["start"]):
                    parts.append(b[here : s["start"]])
                    here = s["start"] + s["length"]
                text = b"".join([*parts, b[here:]]).decode("utf-8", "surrogatepass")
            texts.append(text)
        return pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if i == at else batch.column(i) for i in range(len(schema))], names=schema.names)

    return arrow_map(joined.select(*docs.columns, "__spans"), fn, schema)


def op2_substring_dedup(docs: DataFrame) -> DataFrame:
    """One row per repeated passage, with the documents that keep it."""
    return repeated(docs).select(F.col("row_key.id").alias("doc_id"), "start", "length", "n_words", "n_chunks", F.col("kept_ids").alias("kept_doc_ids"))
