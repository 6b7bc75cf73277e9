"""Packing by power-of-two decomposition.

A document's token ids, closed by one end id, are cut into pieces whose lengths are powers of two:
whole sequences of `max_len` first, then the binary digits of the rest, largest first.  Each piece
is a sequence of its own, so no sequence crosses documents and none is padded; pieces of equal
length form a bucket, from which batches of one shape are drawn.

Defined cases: a null or empty text is the end id alone (one piece of length 1); repeated rows are
packed each on their own; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loomcorpus.llm.common import arrow_map

END_ID = 0
MAX_LEN = 1024
SPECIAL = "<|endoftext|>"


class Encoder:
    """Ids of the byte-level vocabulary.  The ranks file holds the vocabulary of the JSON file and is
    several times faster; texts that name the special token, or that it can't take, go to the other."""

    def __init__(self, json_path: str, ranks_path: str) -> None:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks_path, "rb"))}
        self.fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.json_path, self.exact = json_path, None

    def __call__(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, dtype="<u4")
        if SPECIAL not in text:
            try:
                return np.asarray(self.fast.encode_ordinary(text), dtype="<u4")
            except BaseException as e:  # the pattern engine gives up on extreme runs and panics
                if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
                    raise
        if self.exact is None:
            self.exact = Tokenizer.from_file(self.json_path)
        return np.asarray(self.exact.encode(text, add_special_tokens=False).ids, dtype="<u4")


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(json_path: str | None = None, ranks_path: str | None = None) -> Encoder:
    """One encoder per Python worker and vocabulary."""
    key = (json_path or public_tokenizers.path("byte_bpe_50k.json"), ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"))
    if key not in _encoders:
        _encoders[key] = Encoder(*key)
    return _encoders[key]


def lengths(n: int, max_len: int = MAX_LEN) -> list[int]:
    """Piece lengths of a document of n tokens, in order."""
    rest = n % max_len
    return [max_len] * (n // max_len) + [1 << b for b in range(max_len.bit_length() - 1, -1, -1) if rest >> b & 1]


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_len: int = MAX_LEN, json_path: str | None = None, ranks_path: str | None = None, with_ids: bool = True) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, token_ids (unless with_ids is false).

    A map over rows: nothing is shuffled and a task holds one batch of documents.
    """
    if max_len < 1 or max_len & (max_len - 1):
        raise ValueError("max_len must be a power of two")

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        enc = encoder(json_path, ranks_path)
        row, start, length, crc, total, ids = [], [], [], [], [], []
        for i, text in enumerate(batch.column(1).to_pylist()):
            tokens = np.append(enc(text), np.uint32(END_ID)).astype("<u4")
            at = 0
            for size in lengths(len(tokens), max_len):
                piece = tokens[at : at + size]
                row.append(i)
                start.append(at)
                length.append(size)
                crc.append(zlib.crc32(piece.tobytes()))
                total.append(len(tokens))
                if with_ids:
                    ids.append(piece.astype(np.int32))
                at += size
        cols = [batch.column(0).take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))]
        names = ["id", "start", "length", "ids_crc32", "doc_tokens"]
        if with_ids:
            cols.append(pa.array(ids, pa.list_(pa.int32())))
            names.append("token_ids")
        return pa.RecordBatch.from_arrays(cols, names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", token_ids array<int>" * with_ids
    return arrow_map(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), fn, schema).withColumnRenamed("id", id_col)


def pack(docs: DataFrame, **options) -> DataFrame:
    """Pieces with their sequence: sequence_id, offset (0: a piece is a sequence), bucket (log2 of the length).

    The id numbers the rows of each task, so it is unique without a shuffle and the same when a task is run again.
    """
    return pieces(docs, **options).withColumns({
        "sequence_id": F.monotonically_increasing_id(),
        "offset": F.lit(0).cast("long"),
        "bucket": F.log2(F.col("length")).cast("int"),
    })


def write_buckets(packed: DataFrame, path: str) -> None:
    """Write the sequences so that each bucket is a folder of equal lengths, ready for batches of one shape.

    Nothing is shuffled: each task splits its own rows, so a bucket that holds most rows stays spread.
    """
    packed.write.partitionBy("bucket").parquet(path)


def op3_packing(docs: DataFrame) -> DataFrame:
    """The contract's columns; the ids themselves stay with the operator."""
    return pack(docs, with_ids=False).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "bucket")
