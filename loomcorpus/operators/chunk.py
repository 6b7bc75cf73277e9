"""Sections to token-bounded chunks with stable ids."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomcorpus.functions.text import atoms, bound, slug, split_within_words, token_count
from loomcorpus.operators.ordered import crowded, running


def total(counts: Column) -> Column:
    return F.aggregate(counts, F.lit(0), lambda a, n: a + n)


def packed(parts: Column, most: int, overlap: int, counts: Column | None = None) -> Column:
    """The texts of packed_counts."""
    return F.transform(packed_counts(parts, most, overlap, counts), lambda c: c["text"])


def packed_counts(parts: Column, most: int, overlap: int, counts: Column | None = None) -> Column:
    """Greedy packing of atoms into chunks (text, tokens) of at most `most` tokens, carrying a suffix of at most `overlap`.

    counts: the atoms' tokens, if another counter than white space is wanted.  tokens: the sum of them, which of words is the
    chunk's own count.

    A fold over the counts of one section's atoms finds where chunks begin and end; texts are joined afterwards.
    Sections are independent, so nothing is shuffled.
    """

    def state(cuts: Column, begin: Column, tokens: Column, at: Column) -> Column:
        return F.struct(cuts.alias("cuts"), begin.alias("begin"), tokens.alias("t"), at.alias("at"))

    def cut(begin: Column, end: Column) -> Column:
        return F.array(F.struct(begin.alias("a"), end.alias("b")))

    def closed(s: Column) -> Column:
        return F.when(s["begin"] < s["at"], F.concat(s["cuts"], cut(s["begin"], s["at"]))).otherwise(s["cuts"])

    def carried(ns: Column, s: Column) -> Column:
        """How many of the open chunk's last atoms fit the overlap, and their tokens."""
        zero = F.struct(F.lit(0).alias("k"), F.lit(0).alias("t"), F.lit(False).alias("stop"))

        def step(c: Column, n: Column) -> Column:
            fits = ~c["stop"] & (c["t"] + n <= overlap)
            return F.when(fits, F.struct((c["k"] + 1).alias("k"), (c["t"] + n).alias("t"), F.lit(False).alias("stop"))).otherwise(F.struct(c["k"].alias("k"), c["t"].alias("t"), F.lit(True).alias("stop")))

        return F.aggregate(F.reverse(F.slice(ns, s["begin"] + 1, s["at"] - s["begin"])), zero, step)

    def chunks(x: Column) -> Column:
        def step(s: Column, n: Column) -> Column:
            after = s["at"] + 1
            alone = state(F.concat(closed(s), cut(s["at"], after)), after, F.lit(0), after)
            turn = bound(carried(x["n"], s), lambda c: state(closed(s), s["at"] - c["k"], c["t"] + n, after)) if overlap else state(closed(s), s["at"], n, after)
            return F.when(n > most, alone).when(s["t"] + n > most, turn).otherwise(state(s["cuts"], s["begin"], s["t"] + n, after))

        start = state(F.expr("cast(array() as array<struct<a:int,b:int>>)"), F.lit(0), F.lit(0), F.lit(0))
        def part(c: Column) -> Column:
            own = lambda name: F.slice(x[name], c["a"] + 1, c["b"] - c["a"])
            return F.struct(F.array_join(own("p"), " ").alias("text"), total(own("n")).alias("tokens"))

        return F.filter(F.transform(F.aggregate(x["n"], start, step, closed), part), lambda c: F.trim(c["text"]) != "")

    if counts is not None:
        return bound(F.struct(parts.alias("p"), counts.alias("n")), chunks)
    return bound(parts, lambda p: bound(F.struct(p.alias("p"), F.transform(p, token_count).alias("n")), chunks))


def section_path(hierarchy: Column, source_name: Column) -> Column:
    return F.coalesce(F.nullif(F.array_join(hierarchy, " > "), F.lit("")), source_name)


def occurrence(path: str = "original_path", section: str = "section_path", order: str = "doc_ord") -> Column:
    return (F.row_number().over(Window.partitionBy(path, section).orderBy(order)) - 1).alias("occurrence")


def with_occurrence(sections: DataFrame, path: str = "original_path", section: str = "section_path", order: str = "doc_ord") -> DataFrame:
    """Sections with their occurrence within path and heading.

    Where one of these has more than its share of the sections, they are numbered in ranges, without their texts, and
    joined by the order number, which is a section's own.
    """
    keys = [path, section]
    if not crowded(sections, keys):
        return sections.withColumn("occurrence", occurrence(path, section, order))
    names = sections.select(*keys, order).distinct()
    number = running(names, keys, [order], occurrence=F.lit(1)).withColumn("occurrence", (F.col("occurrence") - 1).cast("int"))
    return sections.alias("l").join(number.alias("r"), F.expr(" AND ".join(f"l.`{c}` <=> r.`{c}`" for c in (*keys, order)))).select("l.*", "r.occurrence")


def path_hash(path: Column, section: Column, number: Column) -> Column:
    return F.left(F.md5(F.concat_ws("::", F.coalesce(path, F.lit("")), section, number.cast("string"))), F.lit(8))


def cut_sections(sections: DataFrame, most: int = 1500, overlap: int = 100, counter: Callable[[Column], Column] | None = None) -> DataFrame:
    """Sections with section_path, slug and chunks, an array of (text, tokens), in place of the text.

    counter: from an array of texts to an array of their tokens (see functions.tokens); by default words.
    """
    rows = sections.withColumn("section_path", section_path(F.col("section_hierarchy"), F.col("source_name")))
    rows = rows.withColumn("slug", slug(F.coalesce(F.try_element_at("section_hierarchy", F.lit(-1)), F.col("source_name"))))
    text = F.col("text")
    if counter:
        rows = rows.withColumn("atoms", atoms(text)).withColumns({"atom_tokens": counter(F.col("atoms")), "text_tokens": counter(F.array("text"))[0]})
        return rows.withColumn("chunks", _cut(text, F.struct(F.col("atoms").alias("p"), F.col("atom_tokens").alias("n")), F.col("text_tokens"), most, overlap)).drop("text", "atoms", "atom_tokens", "text_tokens")
    counted = bound(atoms(text), lambda p: F.struct(p.alias("p"), F.transform(p, token_count).alias("n")))
    # Atoms end between words, but for fences: else words are counted once, those of the text and of its chunks by sums.
    size = lambda x: F.when(split_within_words(text), token_count(text)).otherwise(total(x["n"]))
    return rows.withColumn("chunks", bound(counted, lambda x: bound(size(x), lambda n: _cut(text, x, n, most, overlap)))).drop("text")


def _cut(text: Column, x: Column, size: Column, most: int, overlap: int) -> Column:
    """The chunks of a text of so many tokens; x: its atoms p and their tokens n."""
    whole = F.array(F.struct(text.alias("text"), size.alias("tokens")))
    parts = packed_counts(x["p"], most, overlap, x["n"])
    return bound(F.when(size <= most, whole).otherwise(parts), lambda c: F.when(F.size(c) > 0, c).otherwise(whole))


def chunk_id(source_name: Column, slug: Column, path: Column, section: Column, occurrence: Column, index: Column) -> Column:
    return F.concat_ws("::", source_name, slug, path_hash(path, section, occurrence), index.cast("string"))


def chunk_rows(cut: DataFrame, counter: Callable[[Column], Column] | None = None) -> DataFrame:
    """The chunks, with ids, of cut sections that have their occurrence."""
    # Outer, then filtered: before an inner one Spark filters by the array's size, and computes the array anew for that.
    out = cut.select("*", F.size("chunks").alias("total_chunks_in_section"), F.posexplode_outer("chunks").alias("chunk_index", "chunk")).filter("chunk_index IS NOT NULL")
    tokens = counter(F.array("chunk.text"))[0] if counter else F.col("chunk.tokens")  # tokens of a joined text by a counter aren't a sum
    name = chunk_id(F.col("source_name"), F.col("slug"), F.col("original_path"), F.col("section_path"), F.col("occurrence"), F.col("chunk_index"))
    return out.select(
        F.col("chunk.text").alias("text"), name.alias("chunk_id"), "source_type", "source_name", "section_path", F.coalesce("original_path", F.lit("")).alias("original_path"), "chunk_index", "total_chunks_in_section",
        tokens.alias("token_count"),
    )


def chunk_documents(sections: DataFrame, most: int = 1500, overlap: int = 100, counter: Callable[[Column], Column] | None = None) -> DataFrame:
    """Chunks of sections (doc_ord, text, source_type, source_name, original_path, section_hierarchy)."""
    named = sections.withColumn("section_path", section_path(F.col("section_hierarchy"), F.col("source_name")))
    return chunk_rows(cut_sections(with_occurrence(named), most, overlap, counter), counter)


def repeated_ids(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def assert_unique(chunks: DataFrame) -> None:
    bad = repeated_ids(chunks)
    first = [r["chunk_id"] for r in bad.limit(5).collect()]
    if first:
        raise ValueError(f"{bad.count()} chunk ids are repeated: {first}")
