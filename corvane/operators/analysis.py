"""Query analysis: types, sub-queries, key concepts, constraints, as expressions over a table of queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.text import key_concepts

#: The patterns of questions in several parts, in the order in which they are tried.
VERSUS = r"(?i)(?:^|\s)(.+?)\s+(?:vs\.?|versus|compared?\s+to|difference\s+between)\s+(.+)"
PROS_CONS = r"(?i)(?:pros?\s+(?:and|&)\s+cons?|advantages?\s+(?:and|&)\s+disadvantages?)\s+(?:of\s+)?(.+)"
BOTH_FOR = r"(?i)^(.+?)\s+and\s+(.+?)\s+(?:for|in|with|of)\s+(.+)$"
TWO_QUESTIONS = r"(?i)(.+?)\s+and\s+((?:when|how|what|why|where)\s+.+)"


#: The words that tell a question's kind.
HOW_TO = ("how do", "how to", "how can", "how does")
COMPARISON = (" vs ", " versus ", "compare", "difference between")
FACTUAL = ("what is", "what are", "who is", "who are", "when", "where")


def query_type(query: Column) -> Column:
    """how_to, comparison, factual or exploratory, by question words."""
    q = F.trim(F.lower(query))
    starts = lambda *ws: F.greatest(*(q.startswith(w).cast("int") for w in ws)) == 1
    has = lambda *ws: F.greatest(*(q.contains(w).cast("int") for w in ws)) == 1
    return (
        F.when(starts(*HOW_TO), "how_to")
        .when(has(*COMPARISON), "comparison")
        .when(starts(*FACTUAL), "factual")
        .otherwise("exploratory")
    )


def decomposition(query: Column) -> Column:
    """struct(sub_queries, query_type) by the first pattern that holds; the query itself where none does."""
    part = lambda p, i: F.trim(F.regexp_extract(query, p, i))
    of = lambda kind, *qs: F.struct(F.array(*qs).alias("sub_queries"), F.lit(kind).alias("query_type"))
    topic, shared = part(PROS_CONS, 1), part(BOTH_FOR, 3)
    return (
        F.when(query.rlike(VERSUS), of("comparison", part(VERSUS, 1), part(VERSUS, 2)))
        .when(query.rlike(PROS_CONS), of("comparison", F.concat(F.lit("advantages of "), topic), F.concat(F.lit("disadvantages of "), topic)))
        .when(query.rlike(BOTH_FOR), of("exploratory", F.concat(part(BOTH_FOR, 1), F.lit(" for "), shared), F.concat(part(BOTH_FOR, 2), F.lit(" for "), shared)))
        .when(query.rlike(TWO_QUESTIONS), of("how_to", part(TWO_QUESTIONS, 1), part(TWO_QUESTIONS, 2)))
        .otherwise(F.struct(F.array(query).alias("sub_queries"), query_type(query).alias("query_type")))
    )


def analyze(queries: DataFrame, query: str = "query", intent: Column | None = None, constraints: list[str] | None = None, mode: str = "rule_based") -> DataFrame:
    """Queries with sub_queries, query_type, complexity and key_concepts; null queries are dropped.

    Modes: ``rule_based`` (also in place of ``llm`` where no decomposer is
    given), ``none`` keeps the query whole. An intent takes the type's place;
    constraints are appended to each sub-query.
    """
    q = F.col(query)
    whole = F.struct(F.array(q).alias("sub_queries"), query_type(q).alias("query_type"))
    rows = queries.where(q.isNotNull()).withColumn("_d", decomposition(q) if mode in ("rule_based", "llm") else whole)
    subs = F.col("_d.sub_queries")
    if constraints:
        subs = F.transform(subs, lambda s: F.concat(s, F.lit(" " + " ".join(constraints))))
    kind = F.col("_d.query_type") if intent is None else F.coalesce(intent, F.col("_d.query_type"))
    out = rows.withColumn("sub_queries", subs).withColumn("query_type", kind)
    return out.withColumn("complexity", F.when(F.size("sub_queries") == 1, "simple").otherwise("moderate")).withColumn("key_concepts", key_concepts(q)).drop("_d")
