"""Sections of PDF files: a parser, which is a provider, gives characters and lines; the rest are tables of these."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fixed value: how a numbered heading begins.
NUMBERED = r"^(?:[A-Z]|\d+)(?:\.\d+)*\.?\s{1,4}[A-Z]"


CHARS = "file string, page int, char_no int, top double, size double, text string"
LINES = "file string, page int, line_no int, line string"
#: Of one file's bytes: pages, each with its characters (top, size, text) in order and its lines.
Parser = Callable[[bytes], Iterable[tuple[Iterable[tuple[float, float, str]], Iterable[str]]]]


def parsed(files: DataFrame, parser: Parser) -> tuple[DataFrame, DataFrame]:
    """Lines and characters of files (path, content); a file that the parser fails on gives none of either, and a warning.

    Both come from one map; persist it where both are read, or the files are parsed for each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("file", pa.string()), ("page", pa.int32()), ("no", pa.int32()), ("top", pa.float64()), ("size", pa.float64()), ("text", pa.string())])
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows, char_no, line_no = [], 0, 0
                try:
                    for page, (chars, lines) in enumerate(parser(content.as_py()), 1):
                        for top, size, text in chars:
                            rows.append((path, page, char_no, float(top), float(size), text))
                            char_no += 1
                        for line in lines:
                            rows.append((path, page, line_no, None, None, line))
                            line_no += 1
                except Exception as e:
                    warnings.warn(f"{path} is passed over: {e}", stacklevel=1)
                    continue
                for a in range(0, len(rows), 50_000):
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows[a : a + 50_000], strict=True), kinds, strict=True)], schema=kinds)

    both = files.select("path", "content").mapInArrow(run, "file string, page int, no int, top double, size double, text string").persist()
    lines = both.filter("size IS NULL").select("file", "page", F.col("no").alias("line_no"), F.col("text").alias("line"))
    return lines, both.filter("size IS NOT NULL").select("file", "page", F.col("no").alias("char_no"), "top", "size", "text")


def read_pdf(spark: SparkSession, folder: str, parser: Parser, source_name: str = "papers") -> DataFrame:
    """Sections of all *.pdf files of a folder, as those of read_rst."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(folder)
    rows = pdf_sections(*parsed(files, parser))
    return rows.select(F.struct(F.col("file").alias("original_path"), F.col("section_no").cast("int").alias("section_no")).alias("doc_ord"), "text", F.lit("paper").alias("source_type"), F.lit(source_name).alias("source_name"), F.col("file").alias("original_path"), "section_hierarchy")


def body_size(chars: DataFrame, pages: int = 5) -> DataFrame:
    """(file, body): the most frequent size of the first pages; of equals the one seen first."""
    sizes = chars.filter(F.col("page") <= pages).groupBy("file", F.bround("size", 1).alias("s")).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("page", "char_no")).alias("first"))
    w = Window.partitionBy("file").orderBy(F.desc("n"), "first")
    return sizes.withColumn("o", F.row_number().over(w)).filter("o = 1").select("file", F.col("s").alias("body"))


def line_sizes(lines: DataFrame, chars: DataFrame) -> DataFrame:
    """Lines with the largest size of the first group of equal tops whose first ten characters begin the line; else 0."""
    groups = chars.groupBy("file", "page", F.bround("top", 1).alias("g")).agg(
        F.min("char_no").alias("ord"), F.max(F.when(F.trim("text") != "", F.col("size"))).alias("size"), F.array_sort(F.collect_list(F.struct("char_no", "text"))).alias("cs")
    )
    groups = groups.select("file", "page", "ord", "size", F.left(F.trim(F.array_join(F.transform("cs", lambda c: c["text"]), "")), F.lit(10)).alias("head")).filter("head <> ''")
    # A line meets a group through one of its ten beginnings, not every group of its page.
    starts = F.transform(F.sequence(F.lit(1), F.least(F.lit(10), F.length(F.trim("line")))), lambda n: F.left(F.trim("line"), n))
    heads = lines.filter(F.trim("line") != "").select("file", "page", "line_no", F.explode(starts).alias("head"))
    found = heads.join(groups, ["file", "page", "head"]).groupBy("file", "line_no").agg(F.min_by("size", "ord").alias("line_size"))
    return lines.join(found, ["file", "line_no"], "left").withColumn("line_size", F.coalesce("line_size", F.lit(0.0)))


def is_heading(line, size, body):
    t = F.trim(line)
    return (F.length(t) >= 3) & ((size > body + 1.5) | t.rlike(NUMBERED))


def pdf_sections(lines: DataFrame, chars: DataFrame) -> DataFrame:
    """(file, section_no, text, section_hierarchy) of lines (file, page, line_no, line)."""
    rows = line_sizes(lines, chars).join(body_size(chars), "file").withColumn("h", F.coalesce(is_heading(F.col("line"), F.col("line_size"), F.col("body")), F.lit(False)))
    w = Window.partitionBy("file").orderBy("line_no")
    rows = rows.withColumn("section_no", F.sum(F.col("h").cast("int")).over(w))
    out = rows.groupBy("file", "section_no").agg(
        F.max(F.when(F.col("h"), F.trim("line"))).alias("heading"), F.array_sort(F.collect_list(F.when(~F.col("h"), F.struct("line_no", F.when(F.trim("line") == "", F.lit("")).otherwise(F.col("line")).alias("line"))))).alias("ls")
    )
    stem = F.regexp_extract("file", r"([^/]*?)(?:\.[^./]*)?$", 1)
    text = F.regexp_replace(F.regexp_replace(F.array_join(F.transform("ls", lambda x: x["line"]), "\n"), r"^\s+", ""), r"\s+$", "")
    return out.select("file", "section_no", text.alias("text"), F.array_compact(F.array(stem, F.col("heading"))).alias("section_hierarchy")).filter("text <> ''")
