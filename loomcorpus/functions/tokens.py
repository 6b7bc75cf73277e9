"""Token counters by a byte-pair vocabulary, for arrays of texts."""

from __future__ import annotations

import base64
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Runs of letters, digits, other signs, and white space; a blank opens the run that follows it.
PATTERN = r" ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_encodings: dict[tuple[str, str], object] = {}


def _encoding(path: str, pattern: str):
    """One for each Python worker; the file is read where the task runs."""
    key = (path, pattern)
    if key not in _encodings:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encodings[key] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encodings[key]


def bpe_counter(path: str, pattern: str = PATTERN) -> Callable[[Column], Column]:
    """A counter for chunk_documents: tokens of each text of an array, by a ranks file that every worker can open."""

    @F.pandas_udf("array<int>")
    def count(arrays: pd.Series) -> pd.Series:
        e = _encoding(path, pattern)
        return arrays.map(lambda a: None if a is None else [0 if t is None else len(e.encode_ordinary(t)) for t in a])

    return count
