"""What providers have replied, by content address: nobody is asked twice.

An address is a hash of model, rules and prompt.  Distinct prompts are dealt into buckets by address, and a bucket is
one task's: it reads what earlier attempts have noted there, asks for the rest, and notes each reply the moment it
comes, so a lost executor or a failed task loses no reply, and a second action asks nothing.  A lease keeps a
speculative copy, or another job, from asking the same bucket at once; it runs out if its holder dies.  Errors are not
noted: they are asked again the next time.

The folder must be one that all executors can write to: a path that they mount, or a URI that pyarrow.fs knows.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomcorpus.providers import Budget, sent
from loomcorpus.sources.shared import stored

Send = Callable[[list[str]], list[str]]


@dataclass(frozen=True)
class Ledger:
    """buckets: tasks at most; lease: seconds after which a holder that noted nothing counts as dead, longer than any call."""

    path: str
    buckets: int = 64
    lease: float = 900.0
    poll: float = 0.5

    def opened(self) -> tuple[fs.FileSystem, str]:
        system, path = fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)
        return system, path.rstrip("/")


def address(prompt: Column, model: str, rules: str = "") -> Column:
    return F.sha2(F.to_json(F.array(F.lit(model), F.lit(rules), prompt)), 256)


class _Bucket:
    """The notes of one bucket, under its lease."""

    def __init__(self, ledger: Ledger, number: int) -> None:
        self.ledger, (self.fs, base) = ledger, ledger.opened()
        self.folder, self.holder = f"{base}/{number:05d}", uuid.uuid4().hex
        self.fs.create_dir(self.folder, recursive=True)
        self.out, self.segments = None, 0

    def __enter__(self) -> _Bucket:
        while not self._take():
            time.sleep(self.ledger.poll)
        self.beat = time.monotonic()
        return self

    def _take(self) -> bool:
        at = f"{self.folder}/lease"
        info = self.fs.get_file_info(at)
        if info.type != fs.FileType.NotFound and time.time() - info.mtime.timestamp() > self.ledger.lease:
            self.fs.delete_file(at)
        elif info.type != fs.FileType.NotFound:
            return False
        if isinstance(self.fs, fs.LocalFileSystem):
            try:
                with os.fdopen(os.open(at, os.O_CREAT | os.O_EXCL | os.O_WRONLY), "w") as f:
                    f.write(self.holder)
                return True
            except FileExistsError:
                return False
        self._hold()  # no exclusive creation there: the last that wrote holds it
        time.sleep(self.ledger.poll)
        return self._held()

    def _hold(self) -> None:
        with self.fs.open_output_stream(f"{self.folder}/lease") as f:
            f.write(self.holder.encode())

    def _held(self) -> bool:
        try:
            with self.fs.open_input_stream(f"{self.folder}/lease") as f:
                return f.read().decode() == self.holder
        except FileNotFoundError:
            return False

    def noted(self) -> dict[str, str]:
        """All replies of the bucket; a line that a killed task left unfinished counts for nothing."""
        out = {}
        for info in self.fs.get_file_info(fs.FileSelector(self.folder)):
            if info.path.endswith(".jsonl"):
                with self.fs.open_input_stream(info.path) as f:
                    for line in f.read().split(b"\n"):
                        try:
                            k, v = json.loads(line)
                            out[k] = v
                        except ValueError:
                            continue
        return out

    def note(self, replies: dict[str, str]) -> None:
        lines = b"".join(json.dumps([k, v]).encode() + b"\n" for k, v in replies.items())
        if isinstance(self.fs, fs.LocalFileSystem):
            self.out = self.out or open(f"{self.folder}/{self.holder}.jsonl", "ab")
            self.out.write(lines)
            self.out.flush()
            os.fsync(self.out.fileno())
        else:
            with self.fs.open_output_stream(f"{self.folder}/{self.holder}-{self.segments}.jsonl") as f:
                f.write(lines)
            self.segments += 1
        if time.monotonic() - self.beat > self.ledger.lease / 4 and self._held():
            self._hold()
            self.beat = time.monotonic()

    def __exit__(self, *_) -> None:
        if self.out:
            self.out.close()
        if self._held():
            self.fs.delete_file(f"{self.folder}/lease")


def replies(prompts: DataFrame, send: Send, ledger: Ledger, budget: Budget | None = None, most: int = 1) -> DataFrame:
    """(address, reply, error) of the distinct prompts (address, prompt).

    send takes prompts and gives as many replies; at most `most` words are sent at once, or one prompt.
    """
    bucket = F.pmod(F.xxhash64("address"), F.lit(ledger.buckets)).cast("int")
    once = prompts.filter(F.col("prompt").isNotNull()).groupBy("address").agg(F.min("prompt").alias("prompt")).withColumn("bucket", bucket)
    dealt = once.repartitionById(ledger.buckets, F.col("bucket")).sortWithinPartitions("bucket")

    def groups(rows: Iterator[tuple[str, str]], known: dict[str, str]) -> Iterator[list[tuple[str, str]]]:
        group, total = [], 0
        for a, p in rows:
            if a in known:
                yield [(a, p)]
                continue
            n = len(p.split())
            if group and total + n > most:
                yield group
                group, total = [], 0
            group.append((a, p))
            total += n
        if group:
            yield group

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(found: list[tuple[str, str | None, str | None]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.string()) for i in range(3)], names=["address", "reply", "error"])

        def rows() -> Iterator[tuple[str, str]]:
            yield from zip(first.column(0).to_pylist(), first.column(1).to_pylist(), strict=True)
            for b in batches:
                yield from zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)

        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        with _Bucket(ledger, first.column(2)[0].as_py()) as here:
            known, out = here.noted(), []
            for group in groups(rows(), known):
                ask = [(a, p) for a, p in group if a not in known]
                error = None
                if ask:
                    try:
                        got = sent(budget, lambda: send([p for _, p in ask]), sum(len(p.split()) for _, p in ask))  # noqa: B023
                        if len(got) != len(ask):
                            raise ValueError("the provider returned another number of replies")
                        new = {a: r for (a, _), r in zip(ask, got, strict=True)}
                        here.note(new)
                        known |= new
                    except Exception as e:
                        error = f"{type(e).__name__}: {e}"
                out += [(a, known.get(a), error if a not in known else None) for a, _ in group]
                if len(out) >= 256:
                    yield batch(out)
                    out = []
            yield batch(out)

    return dealt.select("address", "prompt", "bucket").mapInArrow(run, "address string, reply string, error string")


def each(complete: Callable[[str], str]) -> Send:
    """A completion provider as one that takes several prompts."""
    return lambda prompts: [complete(p) for p in prompts]


def with_replies(rows: DataFrame, complete: Callable[[str], str], ledger: Ledger, model: str, budget: Budget | None = None, **prompts: Column) -> DataFrame:
    """Rows with <name>_raw and <name>_error of their prompts, as judge.asked gives them; equal prompts are asked once for all.

    The prompts are asked here and now, and what came of it is written to the shared folder.
    """
    names = list(prompts)
    keyed = rows.withColumns({f"__p_{n}": c.cast("string") for n, c in prompts.items()}).withColumns({f"__a_{n}": F.when(F.col(f"__p_{n}").isNotNull(), address(F.col(f"__p_{n}"), model)) for n in names})
    asked = keyed.select(F.explode(F.array(*(F.struct(F.col(f"__a_{n}").alias("address"), F.col(f"__p_{n}").alias("prompt")) for n in names))).alias("x")).select("x.address", "x.prompt")
    found = stored(replies(asked, each(complete), ledger, budget), "replies")
    for n in names:
        own = found.select(F.col("address").alias(f"__a_{n}"), F.col("reply").alias(f"{n}_raw"), F.col("error").alias(f"{n}_error"))
        keyed = keyed.join(own, f"__a_{n}", "left")
    return keyed.select(*rows.columns, *(f"{n}_{x}" for n in names for x in ("raw", "error")))


def embedded_once(rows: DataFrame, embedder: Callable, ledger: Ledger, model: str, input_type: str = "document", text_col: str = "text", budget: Budget | None = None, most: int = 80_000) -> DataFrame:
    """Rows with embedding and embed_error; equal texts are sent once, in batches of at most `most` words."""
    keyed = rows.withColumn("__a", address(F.coalesce(F.col(text_col), F.lit("")), model, input_type))
    send = lambda texts: [json.dumps(v) for v in embedder(texts, input_type)]
    found = stored(replies(keyed.select(F.col("__a").alias("address"), F.coalesce(F.col(text_col), F.lit("")).alias("prompt")), send, ledger, budget, most), "vectors")
    own = found.select(F.col("address").alias("__a"), F.from_json("reply", "array<float>").alias("embedding"), F.col("error").alias("embed_error"))
    return keyed.join(own, "__a", "left").select(*rows.columns, "embedding", "embed_error")
