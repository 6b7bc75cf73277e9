"""reStructuredText files to sections with heading paths."""

from __future__ import annotations

import re
import warnings
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of heading rules.
RULE_CHARS = "=-~+#^*<>_"
RULE = re.compile("([" + re.escape(RULE_CHARS) + r"])\1+")
DIRECTIVE = re.compile(r"\.\. (?:\w|\|[^|]+\|\b)")
NAME = re.compile(r"\.\. ([\w-]+)::")
#: Inline markup and its replacement, in this order.
INLINE = [(r":[a-z_]+:`([^<`]+)\s*<[^>]+>`", r"\1"), (r":[a-z_:]+:`([^`]+)`", r"\1"), (r"<https?://[^>]+>", ""), (r"\|[^|]+\|", ""), (r"`([^`]+)`_+", r"\1")]


def rule_char(line: str) -> str:
    """The character of a heading rule, or an empty string."""
    m = RULE.fullmatch(line.rstrip())
    return m[1] if m else ""


def without_directives(lines: list[str], keep: frozenset[str] = frozenset()) -> Iterator[str]:
    """Lines outside directives and their bodies; of directives named in keep the body stays.

    A body reaches to the next line with words that is indented by no more than two places beyond the directive.
    """
    indent = [len(x) - len(x.lstrip()) if x.strip() else None for x in lines]
    at = 0
    while at < len(lines):
        body = lines[at].lstrip()
        at += 1
        if not DIRECTIVE.match(body):
            yield lines[at - 1]
        elif not ((name := NAME.match(body)) and name[1] in keep):
            margin = indent[at - 1] + 2
            at = next((i for i in range(at, len(lines)) if indent[i] is not None and indent[i] <= margin), len(lines))


#: Over two characters for each line, its kind and whether the line below underlines it: a title between equal rules, an underlined title, or any one line.
HEADING = re.compile("(?P<rule>[" + re.escape(RULE_CHARS) + r"]).[^ ].(?P=rule).|[^ ]u(?P<under>.).|..", re.DOTALL)


def headings(lines: list[str]) -> list[tuple[int, int, str, str]]:
    """(first row, row after, text, rule character) of each heading.

    Lines are classified first: blank, rule or other; headings are then patterns of kinds.
    """
    kinds = [rule_char(x) or (" " if not x.strip() else "x") for x in lines]
    lined = ["u" if k != " " and kinds[i + 1 : i + 2] not in ([" "], ["x"], []) and len(lines[i + 1].rstrip()) >= len(lines[i].rstrip()) - 2 else "-" for i, k in enumerate(kinds)]
    found = []
    for m in HEADING.finditer("".join(k + u for k, u in zip(kinds, lined, strict=True))):
        at = m.start() // 2
        if m["rule"]:
            found.append((at, at + 3, lines[at + 1].strip(), m["rule"]))
        elif m["under"]:
            over = at > 0 and kinds[at - 1] in RULE_CHARS  # another rule above belongs to the heading, not to the text before
            found.append((at - over, at + 2, lines[at].strip(), m["under"]))
    return found


def clean(text: str) -> str:
    for pattern, to in INLINE:
        text = re.sub(pattern, to, text)
    return text.strip()


def sections(text: str, stem: str, keep: frozenset[str] = frozenset()) -> Iterator[tuple[list[str], str]]:
    """(hierarchy, text); text before the first heading is dropped, a file without headings is one section."""
    lines = list(without_directives(text.splitlines(), keep))
    marks = headings(lines)
    if not marks:
        if body := clean("\n".join(lines)):
            yield [stem], body
        return
    levels = list(dict.fromkeys(c for *_, c in marks))
    path: list[tuple[int, str]] = []
    for k, (_, start, title, char) in enumerate(marks):
        level = levels.index(char)
        path = [*(p for p in path if p[0] < level), (level, title)]
        end = marks[k + 1][0] if k + 1 < len(marks) else len(lines)
        if body := clean("\n".join(lines[start:end])):
            yield [t for _, t in path], body


def heading_rows(rows: DataFrame) -> DataFrame:
    """Of rows (path, text): heading_no, title and rule character of each heading of each file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = headings((text or "").splitlines())
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(found), pa.string()), pa.array(range(len(found)), pa.int32()), pa.array([t for *_, t, _ in found], pa.string()), pa.array([c for *_, c in found], pa.string())], names=["path", "heading_no", "title", "rule"])

    return rows.select("path", "text").mapInArrow(run, "path string, heading_no int, title string, rule string")


SCHEMA = "original_path string, section_no int, text string, section_hierarchy array<string>"


def read_rst(spark: SparkSession, folder: str, source_name: str = "docs", keep: frozenset[str] = frozenset()) -> DataFrame:
    """Sections of all *.rst files below a folder; template folders and template-like files are passed over."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.rst").option("recursiveFileLookup", "true").load(folder)
    rows = files.select("path", F.col("content").alias("text"))
    parts = F.split("path", "/")
    rows = rows.filter(~F.exists(parts, lambda p: p.isin("_templates", "_static"))).filter(~(F.contains("text", F.lit(b"{{")) & F.contains("text", F.lit(b"}}")) & F.contains("text", F.lit(b"{%"))))
    return sectioned(rows, lambda text, stem: sections(text, stem, keep), "docs", source_name)


def sectioned(rows: DataFrame, cut, source_type: str, source_name: str) -> DataFrame:
    """Of rows (path, text): the sections of each file, in order.

    Bytes are read as UTF-8 with replacement characters; a file that can't be cut gives a warning and no sections.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                stem = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
                try:
                    found = list(cut(text.decode("utf-8", "replace") if isinstance(text, bytes) else text or "", stem))
                except (ValueError, AssertionError, RecursionError) as e:
                    warnings.warn(f"{path} is passed over: {e}", stacklevel=1)
                    continue
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(found)), pa.array(range(len(found)), pa.int32()), pa.array([t for _, t in found]), pa.array([h for h, _ in found], pa.list_(pa.string()))], names=["original_path", "section_no", "text", "section_hierarchy"])

    out = rows.select("path", "text").mapInArrow(run, SCHEMA)
    return out.select(F.struct("original_path", "section_no").alias("doc_ord"), "text", F.lit(source_type).alias("source_type"), F.lit(source_name).alias("source_name"), "original_path", "section_hierarchy")
