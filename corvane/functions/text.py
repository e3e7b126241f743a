"""Text expressions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that are no key concepts.
STOP_WORDS = (
    "a an the is are was were be been being do does did have has had having i me my we our you your it its and or but if of at by for with to from in on up out off "
    "into onto about as that this these those what which who whom how when where why not no can could should would will shall may might must vs versus between compared"
).split()


def missing(c: Column) -> Column:
    """Null for a text of nothing but white space, else the text with white space collapsed."""
    return F.nullif(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")), F.lit(""))


def ascii_tokens(c: Column) -> Column:
    """Distinct runs of ``[a-z0-9]`` of the text in lower case."""
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0)))


def space_tokens(c: Column) -> Column:
    """Distinct words between white space, in lower case."""
    return F.array_distinct(F.filter(F.split(F.lower(c), r"(?U)\s+"), lambda w: w != ""))


def word_count(c: Column) -> Column:
    """Words between white space."""
    return F.size(F.filter(F.split(F.coalesce(c, F.lit("")), r"(?U)\s+"), lambda w: w != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Size of the intersection by size of the union of two arrays without repeats; 0 where either is empty or null."""
    same = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), same / (F.size(a) + F.size(b) - same)).otherwise(F.lit(0.0))


def key_concepts(query: Column, most: int = 6) -> Column:
    """The first distinct tokens of letters, digits, ``_``, ``.`` and ``-`` that are no stop words and longer than one character."""
    words = F.regexp_extract_all(F.lower(query), F.lit(r"\b[a-zA-Z0-9_.-]+\b"), F.lit(0))
    stop = F.array(*(F.lit(w) for w in STOP_WORDS))
    return F.slice(F.array_distinct(F.filter(words, lambda w: (F.length(w) > 1) & ~F.array_contains(stop, w))), 1, most)


def without_markup(c: Column) -> Column:
    """Tags as spaces, white space collapsed: how passages go to a reranker."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]+>", " "), r"(?U)\s+", " "))


def keeps_html(flag: str = "has_{}") -> Column:
    """Whether the HTML surface is worth keeping: any rich content but steps and images."""
    return F.coalesce(F.col("has_table") | F.col("has_code") | F.col("has_math") | F.col("has_definition_list") | F.col("has_admonition"), F.lit(False))


def token_span() -> Column:
    """Tokens of a chunk: its span, or its words where the span is missing."""
    return F.coalesce(F.col("token_end") - F.col("token_start"), word_count(F.col("chunk_text")))
