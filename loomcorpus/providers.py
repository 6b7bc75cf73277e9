"""Pluggable embedding and completion providers, with deterministic offline defaults."""

from __future__ import annotations

import json
import re
import time
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from hashlib import md5
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, FloatType, IntegerType, StringType, StructField, StructType

from loomcorpus.operators.ordered import batches_of, crowded


class _Places(dict):
    """Twice the place of each word among `dim`, and its sign: small numbers, of which a memo of words holds many; beyond `most` words it starts anew."""

    most = 1 << 18

    def __init__(self, dim: int) -> None:
        self.dim = dim

    def __missing__(self, word: str) -> int:
        if len(self) >= self.most:
            self.clear()
        h = int.from_bytes(md5(word.encode(), usedforsecurity=False).digest()[:8], "big")
        n = self[word] = 2 * (h % self.dim) + (h >> 63)
        return n


_places: dict[int, _Places] = {}
_OTHER = re.compile(r"[^\w\s]+")
_ASCII = "".join(c if c.isalnum() or c == "_" else " " for c in map(chr, range(128)))


def _words(text: str) -> list[str]:
    """The runs of \\w in lower case; splitting at blanks takes a fraction of a search for each word."""
    low = text.lower()
    return (low.translate(_ASCII) if low.isascii() else _OTHER.sub(" ", low)).split()


class HashEmbedder:
    """Signed feature hashing of words; documents and queries share the space here."""

    def __init__(self, dim: int = 64) -> None:
        self.dim = dim

    def __call__(self, texts: list[str], input_type: str = "document") -> list[list[float]]:
        return self.matrix(texts, input_type).tolist()

    def matrix(self, texts: list[str], input_type: str = "document") -> np.ndarray:
        """A row for each text."""
        places = _places.setdefault(self.dim, _Places(self.dim))
        found = [_words(t) for t in texts]
        sizes = np.array([len(w) for w in found], np.int64)
        at = np.fromiter(map(places.__getitem__, chain.from_iterable(found)), np.int64, sizes.sum())
        row = np.repeat(np.arange(len(texts)) * self.dim, sizes)
        out = np.bincount(row + (at >> 1), 2.0 * (at & 1) - 1, len(texts) * self.dim).reshape(len(texts), self.dim).astype(np.float32)
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(n == 0, 1, n)


def extractive_answer(prompt: str) -> str:
    """The offline completion: the first sentence of the first context block, cited; else it declines."""
    m = re.search(r"\[1\] Source: [^\n]*\n(.*?[.!?])(?:\s|$)", prompt, re.S)
    return f"{m[1].strip()} [1]" if m else "The provided context does not contain enough information to answer this question."


def overlap_judge(prompt: str) -> str:
    """The offline judge: scores by the share of the answer's words that the passages have; answers any of the judges' prompts."""
    parts = dict(re.findall(r"\n\n([A-Z]+):\n(.*?)(?=\n\n[A-Z]+:\n|\Z)", prompt, re.S))
    answer, seen = re.findall(r"\w+", parts.get("ANSWER", "").lower()), set(re.findall(r"\w+", parts.get("PASSAGES", "").lower()))
    share = sum(w in seen for w in answer) / max(1, len(answer))
    faith = 1.0 if share > 0.8 else 0.5 if share > 0.4 else 0.0
    claims = [] if faith == 1.0 else [parts.get("ANSWER", "").strip()[:80]]
    label = "abstained" if parts.get("DECLINED", "").strip() == "yes" else "answered"
    return json.dumps({"faithfulness_score": faith, "unsupported_claims": claims, "reasoning": f"{share:.2f} of the words", "score": 1 + round(4 * share), "reason": "word overlap", "correct": True, "label": label})


class RateLimiter:
    """A sliding window of requests and tokens; the new batch is counted with a margin, the log without."""

    def __init__(self, requests: int = 300, tokens: int = 4_000_000, window: float = 62.0, margin: float = 1.5, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> None:
        self.requests, self.tokens, self.window, self.margin, self.clock, self.sleep = requests, tokens, window, margin, clock, sleep
        self.log: deque[tuple[float, int]] = deque()

    def wait(self, tokens: int) -> None:
        while True:
            now = self.clock()
            while self.log and now - self.log[0][0] > self.window:
                self.log.popleft()
            used = sum(n for _, n in self.log)
            if not self.log or (len(self.log) < self.requests and used + tokens * self.margin <= self.tokens):
                self.log.append((now, tokens))
                return
            self.sleep(max(0.01, self.window - (now - self.log[0][0]) + 0.01))


class Throttled(Exception):
    """What a provider raises, itself or a subclass, if its service asks to slow down."""


def with_retry(call: Callable, attempts: int = 3, pause: float = 30.0, sleep: Callable[[float], None] = time.sleep, on: type[Exception] | tuple[type[Exception], ...] = Exception):
    for i in range(attempts):
        try:
            return call()
        except on:
            if i == attempts - 1:
                raise
            sleep(pause * 2**i)


@dataclass(frozen=True)
class Budget:
    """What all tasks together may send in a window; each of `callers` tasks that run at once keeps to its part of it.

    Set callers to the cores of the cluster: a limiter lives in one Python worker and knows nothing of the others.
    """

    requests: int = 300
    tokens: int = 4_000_000
    window: float = 62.0
    margin: float = 1.5
    callers: int = 1
    attempts: int = 3
    pause: float = 30.0

    def send(self, call: Callable, tokens: int):
        """The call's result, after as long a wait as the budget asks for; throttled calls are tried again."""
        limiter = _limiters.get(self)
        if limiter is None:
            limiter = _limiters[self] = RateLimiter(max(1, self.requests // self.callers), self.tokens // self.callers, self.window, self.margin)
        limiter.wait(tokens)
        return with_retry(call, self.attempts, self.pause, limiter.sleep, Throttled)


_limiters: dict[Budget, RateLimiter] = {}


def sent(budget: Budget | None, call: Callable, tokens: int):
    return call() if budget is None else budget.send(call, tokens)


def token_batches(counts: list[int], most: int = 80_000) -> list[int]:
    """Greedy, order-preserving batch numbers; an oversized item is a batch of its own."""
    out, number, total = [], 0, 0
    for n in counts:
        if total and total + n > most:
            number, total = number + 1, 0
        out.append(number)
        total += n
    return out


def batch_numbers(rows: DataFrame, key: str, order: str, tokens: str, most: int = 80_000) -> DataFrame:
    """Rows with the batch they fall into, as token_batches numbers them within each key in the given order.

    Greedy batches are a running fold: a task reads its keys' rows in order and remembers one number and one sum.  Keys
    with more than their share of the rows are folded in ranges (see operators.ordered).
    """
    if crowded(rows, [key]):
        return batches_of(rows, key, order, tokens, most)
    names = [*rows.columns, "batch"]
    at = [names.index(c) for c in (key, tokens)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, number, total = object(), 0, 0
        for batch in batches:
            out = []
            for k, n in zip(*(batch.column(i).to_pylist() for i in at), strict=True):
                if k != group:
                    group, number, total = k, 0, 0
                if total and total + (n or 0) > most:
                    number, total = number + 1, 0
                total += n or 0
                out.append(number)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int32())], names=names)

    return rows.repartition(key).sortWithinPartitions(key, order).mapInArrow(run, StructType([*rows.schema.fields, StructField("batch", IntegerType())]))


def _lists(vectors: list | np.ndarray) -> pa.Array:
    """Vectors as an Arrow list column; those of a matrix are not made into Python numbers."""
    if not isinstance(vectors, np.ndarray):
        return pa.array(vectors, pa.list_(pa.float32()))
    return pa.ListArray.from_arrays(pa.array(np.arange(len(vectors) + 1) * vectors.shape[1], pa.int32()), pa.array(vectors.astype(np.float32).ravel()))


def embedded(chunks: DataFrame, embedder: Callable = HashEmbedder(), input_type: str = "document", text_col: str = "text", contain: bool = False, budget: Budget | None = None, most: int = 80_000) -> DataFrame:
    """Chunks with their vectors, sent in batches of at most `most` tokens, under a budget if there is one.

    An embedder may have a method `matrix` that gives the vectors as one.  Batches run on across Arrow batches, so a task sends as few as its rows allow.  If `contain`, a failing call gives
    its rows a null vector and their embed_error, instead of a failed task.
    """
    at, names, ask = chunks.columns.index(text_col), chunks.columns, getattr(embedder, "matrix", embedder)
    added = [*names, "embedding", *["embed_error"] * contain]

    def send(rows: pa.RecordBatch, texts: list[str], tokens: int) -> pa.RecordBatch:
        error = None
        try:
            got = sent(budget, lambda: ask(texts, input_type), tokens)
            if len(got) != len(texts):
                raise ValueError("the provider returned another number of vectors")
        except Exception as e:
            if not contain:
                raise
            got, error = [None] * len(texts), f"{type(e).__name__}: {e}"
        more = [pa.array([error] * len(texts), pa.string())] if contain else []
        return pa.RecordBatch.from_arrays([*rows.columns, _lists(got), *more], names=added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        texts: list[str] = []
        total = 0

        def flush() -> pa.RecordBatch:
            nonlocal total
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            out = send(rows, list(texts), total)
            held.clear()
            texts.clear()
            total = 0
            return out

        for batch in batches:
            start = 0
            for i, text in enumerate(batch.column(at).to_pylist()):
                n = len((text or "").split())
                if texts and total + n > most:
                    held.append(batch.slice(start, i - start)) if i > start else None
                    yield flush()
                    start = i
                texts.append(text or "")
                total += n
            if batch.num_rows > start:
                held.append(batch.slice(start))
        if texts:
            yield flush()

    fields = [StructField("embedding", ArrayType(FloatType()))] + [StructField("embed_error", StringType())] * contain
    return chunks.mapInArrow(run, StructType([*chunks.schema.fields, *fields]))


def answer(complete: Callable[[str], str], prompt: str, budget: Budget | None = None) -> tuple[str | None, str | None]:
    """(reply, error): a failing call is a value."""
    try:
        return sent(budget, lambda: complete(prompt), len(prompt.split())), None
    except Exception as e:
        return None, f"{type(e).__name__}: {e}"


def completed(prompts: DataFrame, complete: Callable[[str], str] = extractive_answer, model: str = "offline", budget: Budget | None = None) -> DataFrame:
    """Prompts with answer, usage and error: a failing call becomes a row, not a failed task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [answer(complete, p or "", budget) for p in batch.column("prompt").to_pylist()]
            answers, errors = [x[0] for x in got], [x[1] for x in got]
            tokens = [[len((t or "").split()) for t in x] for x in (batch.column("prompt").to_pylist(), answers)]
            yield pa.RecordBatch.from_arrays([batch.column("query_id"), pa.array(answers, pa.string()), pa.array(errors, pa.string()), pa.array([model] * len(answers)), *(pa.array(t, pa.int64()) for t in tokens)], names=["query_id", "answer", "error", "model", "input_tokens", "output_tokens"])

    kind = prompts.schema["query_id"].dataType.simpleString()
    return prompts.select("query_id", "prompt").mapInArrow(run, f"query_id {kind}, answer string, error string, model string, input_tokens long, output_tokens long")
