"""Text functions as Column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from re import sub

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Phrases by which an answer declines (straight and curly apostrophe).
ABSTAIN = r"(?i)does not contain enough information|cannot answer|can['’]t answer|unable to answer|not enough information|insufficient (context|information)"
#: Fixed value: a mark that cites passages by number.
CITATION = r"\[(\d+(?:,\s*\d+)*)\]"


def stripped(c: Column) -> Column:
    return F.btrim(c, F.lit(" \t\n\x0b\f\r"))


def token_count(c: Column) -> Column:
    """Words separated by white space; the default counter."""
    blank = lambda w, i: F.when(F.get(w, i) == "", 1).otherwise(0)  # noqa: E731  only the first and the last piece can be empty
    return bound(F.split(c, r"\s+"), lambda w: F.size(w) - blank(w, F.lit(0)) - F.when(F.size(w) > 1, blank(w, F.size(w) - 1)).otherwise(0))


def sentences(c: Column) -> Column:
    """Split behind . ! or ? at white space; stripped, blanks dropped."""
    return F.filter(F.transform(F.split(c, r"(?<=[.!?])\s+"), stripped), lambda s: s != "")


def split_within_words(c: Column) -> Column:
    """Whether atoms may part a text where it has no white space."""
    return F.contains(c, F.lit("```")) | F.contains(c, F.lit("\u0001"))


def atoms(c: Column) -> Column:
    """Sentences, with fenced code blocks as atoms of their own."""
    fenced = F.split(F.regexp_replace(c, r"(```[\s\S]*?```)", "\u0001$1\u0001"), "\u0001")
    parts = F.when(split_within_words(c), fenced).otherwise(F.array(c))
    return F.flatten(F.transform(parts, lambda p: F.when(p.rlike(r"^```[\s\S]*```$"), F.array(p)).otherwise(sentences(p))))


def slug_ascii(c: Column) -> Column:
    """The slug of a text without accents, inside the JVM."""
    return F.left(F.regexp_replace(F.lower(stripped(F.regexp_replace(c, r"[^\w\s-]", ""))), r"[\s_-]+", "_"), F.lit(60))


@F.pandas_udf(StringType())
def slug(s: pd.Series) -> pd.Series:
    """The slug of any heading: compatibility decomposition, ASCII only, at most 60 characters."""

    def one(t: str | None) -> str | None:
        if t is None:
            return None
        t = unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode()
        return sub(r"[\s_-]+", "_", sub(r"[^\w\s-]", "", t).strip().lower())[:60]

    return s.map(one)


def abstained(c: Column) -> Column:
    return F.coalesce(c.rlike(ABSTAIN), F.lit(False))


def citations(c: Column) -> Column:
    """Distinct numbers of [n] and [n, m] marks, ascending; numbers beyond an int are passed over."""
    marks = F.flatten(F.transform(F.regexp_extract_all(c, F.lit(CITATION), 1), lambda m: F.split(m, r",\s*")))
    return F.array_sort(F.array_distinct(F.filter(F.transform(marks, lambda x: x.try_cast("int")), lambda x: x.isNotNull())))


def preview(c: Column, n: int, always: bool = False) -> Column:
    """The first n characters on one line; an ellipsis if more follow, or always."""
    flat = F.left(F.regexp_replace(c, "\n", " "), F.lit(n))
    return F.concat(flat, F.lit("...")) if always else F.when(F.length(c) > n, F.concat(flat, F.lit("..."))).otherwise(flat)


def quoted(c: Column) -> Column:
    """A Markdown block quote."""
    return F.regexp_replace(c, "(?m)^", "> ")


def band(score: Column, high: float, mid: float) -> Column:
    return F.when(score >= high, "high").when(score >= mid, "medium").otherwise("low")


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def judge_json(raw: Column) -> Column:
    """The object between the first { and the last }, fences removed; null if none parses."""

    def parsed(bare: Column) -> Column:
        inner = bound(F.regexp_extract(bare, r"(?s)\{.*\}", 0), lambda body: F.when(body != "", _alone(body)))
        return F.coalesce(inner, F.when(bare != "", _alone(bare)))

    return bound(stripped(F.regexp_replace(raw, r"```(?:json)?\s*", "")), parsed)


def _alone(text: Column) -> Column:
    """The one JSON value of a text; null if more follows, which the parser alone would pass over."""
    listed = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    return bound(listed, lambda v: F.when(F.try_variant_get(v, "$[1]", "variant").isNull(), F.try_variant_get(v, "$[0]", "variant")))


def judge_error(raw: Column) -> Column:
    """Null, or the first 200 characters of what can't be parsed."""
    return F.when(judge_json(raw).isNull(), F.left(raw, F.lit(200)))


def faith_score(value: Column) -> Column:
    """The nearest of 0, 0.5 and 1; midpoints go down; null if not numeric."""
    v = value.try_cast("double")
    return F.when(v.isNull() | F.isnan(v), None).when(v <= 0.25, 0.0).when(v <= 0.75, 0.5).otherwise(1.0)


def parse_ranks(text: Column, ids: Column) -> Column:
    """Ids at the ranks of "1,3"; anything but digits and ranks out of bounds are passed over, repeats stay."""
    ranks = F.transform(F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x.rlike(r"^\d+$")), lambda x: x.try_cast("int"))
    return F.transform(F.filter(ranks, lambda r: (r >= 1) & (r <= F.size(ids))), lambda r: F.get(ids, r - 1))
