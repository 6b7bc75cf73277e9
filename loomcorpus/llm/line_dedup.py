"""Line dedup by windows of two lines.

Lines are hashed; a rolling hash over the hashes of each two adjacent lines names that window, and a
line of more than `LONG_WORDS` words is a window of its own.  Windows whose hash occurs again, anywhere,
are compared byte by byte; all but the first (smallest id, then position) are repeats, and every line
that a repeat covers is removed.  So each passage of two lines or more that occurred before goes whole,
whatever stands around it, and the first occurrence of a line always stays.

Defined cases: a null text has no windows and stays null; an empty text stays as it is; windows without
a word are never removed; a window that overlaps its own first occurrence (three equal lines in a row) is
no second one; rows equal in id and text are one document: they keep or lose a passage together; other
columns are kept untouched; an empty table gives none.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomcorpus.llm.common import SPACE, WORD, arrow_map, dealt_join, discard, encode, row_key, written

LONG_WORDS = 50  # a line of more words is removed alone
MULTIPLIER = 31
WORDS = re.compile(WORD.encode())


def windows(text: str | None) -> list[tuple[int, int, int]]:
    """(first line, lines, hash) of each window with a word; lines are split at \\n alone."""
    if text is None:
        return []
    out, before, blank = [], 0, True
    for i, line in enumerate(encode(text).split(b"\n")):
        here, empty = int.from_bytes(hashlib.md5(line).digest()[:8], "big"), not line.strip(SPACE.encode())
        if i and not (blank and empty):
            out.append((i - 1, 2, _signed(before * MULTIPLIER + here)))
        if len(line) > 2 * LONG_WORDS and len(WORDS.findall(line)) > LONG_WORDS:
            out.append((i, 1, _signed(here)))
        before, blank = here, empty
    return out


def _signed(x: int) -> int:
    return (x + (1 << 63)) % (1 << 64) - (1 << 63)


def occurrences(keyed: DataFrame) -> DataFrame:
    """Of rows (row_key, text): the place and hash of each window; no text."""

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        row, first, count, code = [], [], [], []
        for i, text in enumerate(batch.column(1)):
            for at, n, h in windows(text.as_py()):
                row.append(i)
                first.append(at)
                count.append(n)
                code.append(h)
        pick = pa.array(row, pa.int64())
        cols = [batch.column(0).take(pick), *(pa.array(x, pa.int64()) for x in (first, count, code))]
        return pa.RecordBatch.from_arrays(cols, names=["row_key", "first_line", "n_lines", "hash"])

    return arrow_map(keyed, fn, f"row_key {keyed.schema['row_key'].dataType.simpleString()}, first_line long, n_lines long, hash long")


def joined_runs(found: list[dict]) -> list[dict]:
    """Repeated windows whose kept places go along with them, joined; runs inside another are left out."""
    runs: list[dict] = []
    last: dict[tuple, dict] = {}
    for x in sorted(found, key=lambda x: (x["first_line"], -x["n_lines"])):
        along = (x["kept_id"], x["kept_text"], x["kept_line"] - x["first_line"])
        run = last.get(along)
        if run and x["first_line"] <= run["first_line"] + run["n_lines"]:
            run["n_lines"] = max(run["n_lines"], x["first_line"] + x["n_lines"] - run["first_line"])
            run["copies"] = min(run["copies"], x["copies"])
        else:
            run = last[along] = {k: x[k] for k in ("first_line", "n_lines", "kept_id", "kept_line", "copies")}
            runs.append(run)
    out, end = [], 0
    for r in sorted(runs, key=lambda r: (r["first_line"], -r["n_lines"])):
        if r["first_line"] + r["n_lines"] > end:
            out.append(r)
            end = r["first_line"] + r["n_lines"]
    return out


def repeats(keyed: DataFrame) -> DataFrame:
    """(row_key, cut): the passages to remove, with first_line, n_lines, kept_id, kept_line and copies of each.

    Only hashes and places are shuffled for all windows; the bytes travel only for hashes found twice.  A hash that a
    large share of all windows has is dealt among tasks.
    """
    place = F.struct(F.col("row_key.id").alias("id"), "first_line", F.col("row_key.text").alias("text"))
    found = written(occurrences(keyed), "line_windows")
    many = written(found.groupBy("hash").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1"), "repeated_hashes")
    again = dealt_join(found, many, ["hash"], ["hash"], "row_key")
    wanted = again.groupBy("row_key").agg(F.collect_set(F.struct("first_line", "n_lines", "hash")).alias("want"))

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        row, at, n, code, window = [], [], [], [], []
        for i, (text, want) in enumerate(zip(batch.column(1), batch.column(2), strict=True)):
            lines = encode(text.as_py()).split(b"\n")
            for w in want.as_py():
                row.append(i)
                at.append(w["first_line"])
                n.append(w["n_lines"])
                code.append(w["hash"])
                window.append(b"\n".join(lines[w["first_line"] : w["first_line"] + w["n_lines"]]))
        pick = pa.array(row, pa.int64())
        cols = [batch.column(0).take(pick), *(pa.array(x, pa.int64()) for x in (at, n, code)), pa.array(window, pa.binary())]
        return pa.RecordBatch.from_arrays(cols, names=["row_key", "first_line", "n_lines", "hash", "window"])

    kind, id_type = (keyed.schema["row_key"].dataType.simpleString(), keyed.schema["row_key"].dataType["id"].dataType.simpleString())
    texts = keyed.join(wanted, "row_key").select("row_key", "text", "want")
    exact = written(arrow_map(texts, fn, f"row_key {kind}, first_line long, n_lines long, hash long, window binary"), "line_bytes")
    discard(found, many)
    # Grouping by the bytes themselves is the byte comparison; partial sums meet a hot window map-side.
    kept = written(exact.groupBy("hash", "n_lines", "window").agg(F.min(place).alias("kept"), F.count(F.lit(1)).alias("copies")).filter("copies > 1"), "repeated_windows")
    overlaps = (F.col("kept.id").eqNullSafe(F.col("row_key.id"))) & (F.col("kept.text") == F.col("row_key.text")) & (F.col("first_line") < F.col("kept.first_line") + F.col("n_lines"))
    gone = dealt_join(exact, kept, ["hash", "n_lines", "window"], ["hash", "n_lines"], "row_key").filter(~place.eqNullSafe(F.col("kept")) & ~overlaps)
    hit = F.struct("first_line", "n_lines", F.col("kept.id").alias("kept_id"), F.col("kept.first_line").alias("kept_line"), F.col("kept.text").alias("kept_text"), "copies")
    per = gone.groupBy("row_key").agg(F.collect_set(hit).alias("found"))

    def join(batch: pa.RecordBatch) -> pa.RecordBatch:
        item = batch.column(1).type.value_type
        fields = pa.struct([pa.field(k, item.field(k).type) for k in ("first_line", "n_lines", "kept_id", "kept_line", "copies")])
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([joined_runs(x.as_py()) for x in batch.column(1)], pa.list_(fields))], names=["row_key", "cut"])

    return arrow_map(per, join, f"row_key {kind}, cut array<struct<first_line: long, n_lines: long, kept_id: {id_type}, kept_line: long, copies: long>>")


def keyed_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (row_key, text).  Rows equal in id and text share their key, which changes nothing."""
    return docs.select(row_key(id_col, text_col).alias("row_key"), F.col(text_col).alias("text"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", drop_emptied: bool = True) -> DataFrame:
    """The documents with the repeated passages cut out; a document that loses its last word goes, if drop_emptied."""
    cut = repeats(keyed_rows(docs, id_col, text_col))
    keyed = docs.withColumn("__row_key", row_key(id_col, text_col))
    joined = keyed.join(cut.withColumnRenamed("row_key", "__row_key").withColumnRenamed("cut", "__cut"), "__row_key", "left")
    lines = F.split(F.col(text_col), "\n", -1)
    keep = F.filter(
        F.transform(lines, lambda x, i: F.struct(x.alias("line"), i.alias("i"))),
        lambda s: ~F.exists(F.col("__cut"), lambda c: (s["i"] >= c["first_line"]) & (s["i"] < c["first_line"] + c["n_lines"])),
    )
    text = F.when(F.col("__cut").isNull(), F.col(text_col)).otherwise(F.array_join(F.transform(keep, lambda s: s["line"]), "\n"))
    out = joined.withColumn(text_col, text)
    if drop_emptied:
        out = out.filter(F.col("__cut").isNull() | F.col(text_col).rlike(r"[^\x20\x09-\x0D]"))
    return out.select(*docs.columns)


def op6_line_dedup(docs: DataFrame) -> DataFrame:
    """One row per removed passage, with the document and place that keep it; copies is that of its rarest window."""
    keyed = keyed_rows(docs, "doc_id", "text")
    rows = keyed.join(repeats(keyed), "row_key").select("row_key.id", F.split("text", "\n", -1).alias("lines"), F.explode("cut").alias("c"))
    passage = F.array_join(F.slice("lines", (F.col("c.first_line") + 1).cast("int"), F.col("c.n_lines").cast("int")), "\n")
    return rows.select(F.col("id").alias("doc_id"), "c.first_line", "c.n_lines", F.md5(passage).alias("digest"), F.col("c.kept_id").alias("kept_doc_id"), "c.kept_line", "c.copies")


#: By DuckDB, over the view documents: windows of one long or two lines, their later occurrences, runs of these with one shift, and of the runs those not inside another.
OP6_SQL = r"""
WITH d AS (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM d),
n AS (SELECT *, lead(line) OVER (PARTITION BY doc_id ORDER BY i) AS next FROM l),
w AS (
  SELECT doc_id, i, 2 AS n, line || chr(10) || next AS w FROM n WHERE next IS NOT NULL AND regexp_matches(line || next, '[^\x20\x09-\x0D]')
  UNION ALL
  SELECT doc_id, i, 1, line FROM n WHERE len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) > 50),
k AS (SELECT n, w, count(*) AS copies, min(struct_pack(d := doc_id, i := i)) AS kept FROM w GROUP BY n, w HAVING count(*) > 1),
g AS (SELECT doc_id, i, n, kept.d AS kd, kept.i AS ki, copies FROM w JOIN k USING (n, w) WHERE NOT (doc_id = kept.d AND i < kept.i + n)),
a AS (SELECT *, max(i + n) OVER (PARTITION BY doc_id, kd, ki - i ORDER BY i, n DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM g),
b AS (SELECT *, count_if(reach IS NULL OR i > reach) OVER (PARTITION BY doc_id, kd, ki - i ORDER BY i, n DESC) AS run FROM a),
r AS (SELECT doc_id, kd, ki - i AS shift, run, min(i) AS i, max(i + n) - min(i) AS lines, min(copies) AS copies, max(n) FILTER (reach IS NULL OR i > reach) AS lead FROM b GROUP BY doc_id, kd, ki - i, run),
o AS (SELECT *, max(i + lines) OVER (PARTITION BY doc_id ORDER BY i, lines DESC, lead DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS covered FROM r)
SELECT doc_id, i::BIGINT AS first_line, lines::BIGINT AS n_lines, md5(array_to_string(list_slice(string_split(text, chr(10)), i + 1, i + lines), chr(10))) AS digest,
       kd AS kept_doc_id, (i + shift)::BIGINT AS kept_line, copies::BIGINT AS copies
FROM o JOIN d USING (doc_id) WHERE covered IS NULL OR i + lines > covered"""
