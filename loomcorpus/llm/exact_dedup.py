"""Exact dedup by recipes of content-defined chunks.  DataFrame functions only.

A text is cut into pieces at sentence and line ends, and after a piece whose hash is 0 modulo `one_in` (or after
`most_pieces`) a chunk ends, so boundaries depend on what stands beside them.  A document's recipe is the list of
its chunks' digests.  Recipes that occur once are of texts that occur once.  Of the others the chunks, each once
for a task however many documents hold it, are brought together by digest and bytes: a digest with one text is a
verified identifier, and where texts share a digest each gets a number beside it.  Documents are equal if their
lists of identifiers are; texts travel in chunks, once at most, and long documents never as a row.

Equal means identical after A-Z are lower-cased.  Defined cases: a null text is the empty one, and empty texts are
equal; the largest id of equal texts stays, a null id is smaller than all others; rows that repeat an id and its
text are one document, counted twice in group_size, and share their verdict; other columns are ignored, whatever
their names; an empty table gives no rows.  Texts are taken as valid UTF-8.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomcorpus.functions.text import bound
from loomcorpus.llm.common import dealt_join, discard, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Params:
    piece: int = 1023  # characters of a piece without a sentence or line end
    one_in: int = 8  # pieces that end a chunk
    most_pieces: int = 64  # of a chunk
    digest_bits: int = 64
    broadcast_keys: int = 250_000  # repeated recipes of 8 bytes that are broadcast; beyond, all chunks are compared


def normal(text: Column) -> Column:
    """A-Z in lower case; texts of ASCII alone take the function that is fast for them."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def chunks(text: Column, p: Params = Params()) -> Column:
    """The text's chunks in order; together they are the text."""
    pieces = F.regexp_extract_all(text, F.lit(rf"[^.!?\n]{{1,{p.piece}}}+[.!?\n]?|[.!?\n]"), F.lit(0))

    def before(e: Column, k: Column) -> Column:
        return F.when(k > 0, F.get(e, k - 1)).otherwise(F.lit(0))

    def capped(e: Column) -> Column:
        """The ends, and more of them where a chunk would have too many pieces."""
        more = lambda end, a: F.when(end - a > p.most_pieces, F.sequence(a + p.most_pieces, end - 1, F.lit(p.most_pieces))).otherwise(F.expr("cast(array() AS array<int>)"))
        return F.flatten(F.transform(e, lambda end, k: F.concat(more(end, before(e, k)), F.array(end))))

    def cut(x: Column) -> Column:
        ends = F.transform(x, lambda s, i: F.when((F.pmod(F.xxhash64(s), F.lit(p.one_in)) == 0) | (i + 1 == F.size(x)), i + 1))

        def slices(e: Column) -> Column:
            return F.transform(e, lambda end, k: bound(before(e, k), lambda a: F.array_join(F.slice(x, a + 1, end - a), "")))

        return bound(bound(F.filter(ends, lambda e: e.isNotNull()), capped), slices)

    return bound(pieces, cut)


def digest(chunk: Column, p: Params) -> Column:
    h = F.xxhash64(chunk)
    return h if p.digest_bits == 64 else F.shiftrightunsigned(h, 64 - p.digest_bits)


def _read(docs: DataFrame, id_col: str, text_col: str, p: Params) -> DataFrame:
    """id, text (normal) and chunks of each row."""
    rows = docs.select(F.col(id_col).alias("id"), normal(F.coalesce(F.col(text_col), F.lit(""))).alias("text"))
    return rows.withColumn("chunks", chunks(F.col("text"), p))


def _recipe(rows: DataFrame, p: Params, *more: str) -> DataFrame:
    return rows.withColumn("digests", F.transform("chunks", lambda c: digest(c, p))).select(*more, "digests", F.xxhash64("digests").alias("fold"))


def shared(rows: DataFrame) -> DataFrame:
    """Identifier lists that several rows have: copies and the largest id."""
    return rows.groupBy("fold", "digests", "numbers").agg(F.count(F.lit(1)).alias("copies"), F.max("id").alias("keep_id")).filter("copies > 1")


def clashes(rows: DataFrame, lists: DataFrame, p: Params) -> DataFrame:
    """Digests of different chunks among the rows (fold, digests, chunks) of the given lists, compared by their bytes."""
    folds = lists.select("fold").distinct()
    if folds.limit(p.broadcast_keys + 1).count() <= p.broadcast_keys:
        rows = rows.join(F.broadcast(folds), "fold", "left_semi")
    once = rows.select(F.explode(F.arrays_zip("digests", "chunks")).alias("c")).select("c.digests", "c.chunks").distinct()
    return once.groupBy("digests").count().filter("count > 1").select("digests")


def numbered(rows: DataFrame, clash: DataFrame) -> DataFrame:
    """Rows (row, id, text_sha256, fold, digests, chunks) with numbers: place and number of each chunk whose digest is another's too."""
    each = rows.select("row", F.posexplode(F.arrays_zip("digests", "chunks")).alias("place", "c")).select("row", "place", F.col("c.digests").alias("digest"), F.col("c.chunks").alias("chunk"))
    each = each.join(clash.withColumnRenamed("digests", "digest"), "digest", "left_semi")
    number = each.select("digest", "chunk").distinct().withColumn("number", F.row_number().over(Window.partitionBy("digest").orderBy("chunk")))
    marks = each.join(number, ["digest", "chunk"]).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("place", "number"))).alias("numbers"))
    return rows.drop("chunks").join(marks, "row", "left").withColumn("numbers", F.coalesce("numbers", F.expr(NONE))).drop("row")


NONE = "cast(array() AS array<struct<place: int, number: int>>)"


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", params: Params = Params()) -> DataFrame:
    """One row a document: id, keep_id (of the row that stays), group_size, kept, text_sha256, n_chunks."""
    read = _read(docs, id_col, text_col, params)
    own = ("id", F.sha2("text", 256).alias("text_sha256"))
    rows = written(_recipe(read, params, *own).withColumn("numbers", F.expr(NONE)), "recipes")
    lists = written(shared(rows), "lists")
    clash = written(clashes(_recipe(read, params, "chunks"), lists, params), "clashes")
    if not clash.isEmpty():
        stored = written(_recipe(read, params, *own, "chunks").withColumn("row", F.monotonically_increasing_id()), "stored")
        discard(rows, lists)
        rows = written(numbered(stored, clash), "recipes")
        lists = written(shared(rows), "lists")
        discard(stored)
    discard(clash)
    out = dealt_join(rows, lists, ["fold", "digests", "numbers"], ["fold"], "id", how="left")
    keep = F.when(F.col("copies").isNull(), F.col("id")).otherwise(F.col("keep_id"))
    return out.select(F.col("id").alias(id_col), keep.alias("keep_id"), F.coalesce("copies", F.lit(1)).cast("long").alias("group_size"), F.col("id").eqNullSafe(keep).alias("kept"), "text_sha256", F.size("digests").alias("n_chunks"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", params: Params = Params()) -> DataFrame:
    """The documents, in their own columns, of which the ids stay."""
    gone = written(classes(docs, id_col, text_col, params).filter("NOT kept").select(F.col(id_col).alias("__id"), F.col("text_sha256").alias("__text")).distinct(), "gone")
    if gone.limit(params.broadcast_keys + 1).count() <= params.broadcast_keys:
        gone = F.broadcast(gone)
    text = F.sha2(normal(F.coalesce(docs[text_col], F.lit(""))), 256)
    return docs.join(gone, docs[id_col].eqNullSafe(F.col("__id")) & (text == F.col("__text")), "left_anti")


def op12_exact_dedup(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    return classes(docs).drop("n_chunks")


OP12_SQL = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents),
e AS (SELECT doc_id, x, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size FROM d WINDOW w AS (PARTITION BY x))
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(x) AS text_sha256 FROM e"""
