"""Files of a folder as sections, by Spark's data source API: spark.read.format("sections") and readStream.

Register it once a session: `spark.dataSource.register(SectionSource)`.  Options: path, kind (rst, html or html-headings),
source_type, source_name, partition_bytes, push.  Files are planned into partitions of about as many bytes each, and a
file that can't be read or cut is a row with its problem and no text.  With push, filters on original_path choose files
before any is opened; Spark wants spark.sql.python.filterPushdown.enabled to be true then.  As a stream, files arrive in
order of their time of change, each once; one that is changed later arrives again, with a larger delivery.

The folder is read through pyarrow.fs: a path that executors mount, or a URI that pyarrow knows.
"""

from __future__ import annotations

import fnmatch
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition, StringContains, StringEndsWith, StringStartsWith

from loomcorpus.sources import html, rst

#: Of a file's sections in order: delivery is the file's time of change in microseconds; problem says why there is no text.
SCHEMA = "doc_ord long, text string, source_type string, source_name string, original_path string, section_hierarchy array<string>, delivery long, problem string"
KINDS = {"rst": ("*.rst", rst.sections), "html": ("*.html", html.sections), "html-headings": ("*.html", lambda text, stem: html.sections(text, stem, "heading"))}
TESTS = {EqualTo: lambda v, x: v == x, In: lambda v, x: v in x, StringStartsWith: str.startswith, StringEndsWith: str.endswith, StringContains: lambda v, x: x in v}


@dataclass(frozen=True)
class Found:
    path: str  # relative to the folder
    size: int
    changed: int


@dataclass
class Files(InputPartition):
    files: list[Found]


class Folder:
    """The files of the options' kind, and their sections."""

    def __init__(self, options: dict) -> None:
        self.root, self.kind = options["path"], options.get("kind", "rst")
        self.pattern, self.cut = KINDS[self.kind]
        self.source_type, self.source_name = options.get("source_type", "docs" if self.kind == "rst" else "book"), options.get("source_name", "docs")
        self.bytes = int(options.get("partition_bytes", 64 << 20))

    def opened(self) -> tuple[fs.FileSystem, str]:
        system, path = fs.FileSystem.from_uri(self.root) if "://" in self.root or self.root.startswith("file:") else (fs.LocalFileSystem(), self.root)
        return system, path.rstrip("/")

    def list(self) -> list[Found]:
        """Templates, of which no section is wanted, are passed over."""
        system, base = self.opened()
        rows = [Found(i.path.removeprefix(f"{base}/"), i.size, int(i.mtime.timestamp() * 1_000_000)) for i in system.get_file_info(fs.FileSelector(base, recursive=True)) if i.is_file]
        return [f for f in rows if fnmatch.fnmatch(f.path.rsplit("/", 1)[-1], self.pattern) and not {"_templates", "_static"} & set(f.path.split("/"))]

    def planned(self, files: list[Found]) -> list[Files]:
        """Files in order of their paths, in runs of about partition_bytes; a larger file is a run of its own."""
        out, total = [], 0
        for f in sorted(files, key=lambda f: f.path):
            if not out or total + f.size > self.bytes:
                out.append(Files([]))
                total = 0
            out[-1].files.append(f)
            total += f.size
        return out

    def read(self, part: Files) -> Iterator[pa.RecordBatch]:
        """A batch for each file, which is the most that is held at once."""
        system, base = self.opened()
        for f in part.files:
            problem, found = None, []
            try:
                with system.open_input_stream(f"{base}/{f.path}") as stream:
                    text = stream.read().decode("utf-8", "replace")
                if not (self.kind == "rst" and all(mark in text for mark in ("{{", "}}", "{%"))):
                    found = list(self.cut(text, f.path.rsplit("/", 1)[-1].rsplit(".", 1)[0]))
            except (OSError, ValueError, AssertionError, RecursionError) as e:
                problem = f"{type(e).__name__}: {e}"
            rows = [(i, t, h, None) for i, (h, t) in enumerate(found)] or ([(None, None, None, problem)] if problem else [])
            if rows:
                same = lambda v, n=len(rows): pa.array([v] * n, pa.string())
                cols = [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), same(self.source_type), same(self.source_name), same(f.path), pa.array([r[2] for r in rows], pa.list_(pa.string())), pa.array([f.changed] * len(rows), pa.int64()), pa.array([r[3] for r in rows], pa.string())]
                yield pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in SCHEMA.split(", ")])


class Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.folder, self.tests = Folder(options), []

    def partitions(self) -> list[Files]:
        return self.folder.planned([f for f in self.folder.list() if all(test(f.path, value) for test, value in self.tests)]) or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        yield from self.folder.read(partition)


class PushingReader(Reader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if type(f) in TESTS and f.attribute == ("original_path",):
                self.tests.append((TESTS[type(f)], f.value))
            else:
                yield f


class StreamReader(DataSourceStreamReader):
    """An offset is the last file that was taken up, in order of time of change and path."""

    def __init__(self, options: dict) -> None:
        self.folder = Folder(options)

    def initialOffset(self) -> dict:
        return {"changed": -1, "path": ""}

    def latestOffset(self, *_) -> dict:
        last = max(((f.changed, f.path) for f in self.folder.list()), default=(-1, ""))
        return {"changed": last[0], "path": last[1]}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        after, upto = ((o["changed"], o["path"]) for o in (start, end))
        return self.folder.planned([f for f in self.folder.list() if after < (f.changed, f.path) <= upto]) or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        yield from self.folder.read(partition)

    def commit(self, end: dict) -> None:
        pass


class SectionSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sections"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return (PushingReader if self.options.get("push", "false").lower() == "true" else Reader)(dict(self.options))

    def streamReader(self, schema) -> StreamReader:
        return StreamReader(dict(self.options))
