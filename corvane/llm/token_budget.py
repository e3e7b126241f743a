"""Problem 6: how many tokens each language, site and domain provides.

A store keeps three tables between runs: the ledger (content_hash, tokenizer,
tokens), in which a content is encoded once per tokenizer, whatever number of
documents has it and however often they are fetched; the last state of the
corpus; and the cube of totals. A run encodes what the ledger lacks and changes
the cube by signed deltas between the kept state and the new one, removed
documents included. Tokens that the spans of chunks give need no encoding and
are counted from the spans.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.functions.urls import language_of, page_of, site_of
from corvane.llm.tokens import VOCABULARY, tokenizer_hash, with_tokens
from corvane.session import cut_lineage, shared_folder
from corvane.sources.store import Store

LEDGER = "content_hash string, tokenizer string, tokens bigint"
#: Token positions of one block; spans are cut at blocks, so that a document of any length is spread.
BLOCK = 8192


def span_tokens(chunks: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(document_id, tokens, encoded_tokens): the positions of a document's token stream that its chunks cover, each once.

    Parents and children of one text, overlapping chunks and chunks delivered
    twice count once. A reversed span is turned round. A chunk without a whole
    span counts by its parent's; only where that has none either its text is
    encoded, once for each content. Null document ids have no row.
    """
    c = chunks.where("document_id is not null")
    usable = F.col("token_start").isNotNull() & F.col("token_end").isNotNull()
    lo, hi = F.least("token_start", "token_end"), F.greatest("token_start", "token_end")
    span = c.where(usable).select("document_id", lo.alias("lo"), hi.alias("hi")).where("hi > lo").distinct()
    block = F.explode(F.sequence(F.floor(F.col("lo") / BLOCK), F.floor((F.col("hi") - 1) / BLOCK))).alias("block")
    cut = span.select("document_id", "lo", "hi", block).select("document_id", "block", F.greatest("lo", F.col("block") * BLOCK).cast("int").alias("lo"), F.least("hi", (F.col("block") + 1) * BLOCK).cast("int").alias("hi"))
    union = F.aggregate(
        F.array_sort(F.collect_set(F.struct("lo", "hi"))),
        F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-1).alias("end")),
        lambda s, x: F.struct((s["n"] + F.greatest(F.lit(0), x["hi"] - F.greatest(x["lo"], s["end"]))).cast("bigint").alias("n"), F.greatest(s["end"], x["hi"]).alias("end")),
        lambda s: s["n"],
    )
    covered = cut.groupBy("document_id", "block").agg(union.alias("tokens")).select("document_id", "tokens")
    spans_of = c.where(usable).select(F.col("document_id"), F.col("chunk_id").alias("parent_id")).distinct()
    bare = c.where(~usable & F.col("chunk_text").isNotNull()).select("document_id", "parent_id", "chunk_text")
    bare = bare.join(spans_of, ["document_id", "parent_id"], "left_anti").select("document_id", F.sha2("chunk_text", 256).alias("content_hash"), "chunk_text").dropDuplicates(["document_id", "content_hash"])
    encoded = with_tokens(bare.select("document_id", "chunk_text"), "chunk_text", vocabulary).select("document_id", F.lit(0).cast("bigint").alias("tokens"), F.col("tokens").alias("encoded_tokens"))
    both = covered.withColumn("encoded_tokens", F.lit(0).cast("bigint")).unionByName(encoded)
    return both.groupBy("document_id").agg(F.sum("tokens").alias("tokens"), F.sum("encoded_tokens").alias("encoded_tokens"))


def token_totals(chunks: DataFrame, documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(language, site, documents, tokens, encoded_tokens) from the spans of ``chunks`` and the metadata of indexed documents.

    Languages by two-letter code (``und`` where unknown), sites as host without
    ``www.`` and port. Documents without chunks count with 0 tokens; chunks of
    no listed document aren't counted. Counts are added per key before the
    shuffle, so a large site is no large group.
    """
    meta = documents.select("document_id", language_of(F.col("language")).alias("language"), site_of(page_of()).alias("site")).dropDuplicates(["document_id"])
    per = meta.join(span_tokens(chunks, vocabulary), "document_id", "left")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c)
    return per.groupBy("language", "site").agg(F.count("*").alias("documents"), total("tokens"), total("encoded_tokens"))


def update_ledger(ledger: DataFrame | None, contents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """The ledger's rows for this tokenizer that ``contents`` (content_hash, text) lacks: only unseen contents are encoded."""
    new = contents.where("content_hash is not null and text is not null").dropDuplicates(["content_hash"])
    name = tokenizer_hash(vocabulary)
    if ledger is not None:
        new = new.join(ledger.where(F.col("tokenizer") == name).select("content_hash"), "content_hash", "left_anti")
    return with_tokens(new.select("content_hash", "text"), "text", vocabulary).select("content_hash", F.lit(name).alias("tokenizer"), "tokens")


def deltas(before: DataFrame, after: DataFrame, ledger: DataFrame, cells: list[str], vocabulary: str = VOCABULARY) -> DataFrame:
    """Signed changes (cells..., documents, tokens) between two states (key, content_hash, cells...).

    A key that only ``before`` has is removed, one that only ``after`` has is
    new, one whose content or cell changed counts with both signs; others move
    nothing and aren't looked up. Null contents have 0 tokens.
    """
    row = F.struct("content_hash", *cells)
    b, a = before.select("key", row.alias("b")).dropDuplicates(["key"]), after.select("key", row.alias("a")).dropDuplicates(["key"])
    moved = b.join(a, "key", "full").where(~F.col("b").eqNullSafe(F.col("a")))
    signed = moved.select(F.explode(F.array(F.struct(F.lit(-1).alias("sign"), F.col("b").alias("r")), F.struct(F.lit(1).alias("sign"), F.col("a").alias("r")))).alias("x")).where("x.r is not null").select("x.sign", "x.r.*")
    known = ledger.where(F.col("tokenizer") == tokenizer_hash(vocabulary)).select("content_hash", "tokens")
    out = signed.join(known, "content_hash", "left").groupBy(*cells).agg(F.sum("sign").alias("documents"), F.coalesce(F.sum(F.col("sign") * F.col("tokens")), F.lit(0)).alias("tokens"))
    return out.where("documents <> 0 or tokens <> 0")


def apply_deltas(cube: DataFrame, change: DataFrame, cells: list[str]) -> DataFrame:
    """The cube after the change; cells without documents disappear."""
    both = cube.select(*cells, "documents", "tokens").unionByName(change.select(*cells, "documents", "tokens"))
    return both.groupBy(*cells).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens")).where("documents <> 0")


def domain_of(site: Column) -> Column:
    """The last two labels of a host."""
    return F.regexp_extract(site, r"([^.]+(?:\.[^.]+)?)$", 1)


def newest(fetches: DataFrame, until: F.Column | None = None) -> DataFrame:
    """(key, content_hash, language, site, domain, text): each page's newest fetch up to a time; pages whose newest fetch has no markdown are gone.

    Two fetches of one time: the larger ``fetch_id``.
    """
    f = fetches.where(until) if until is not None else fetches
    last = f.withColumn("key", page_of()).where("key is not null").groupBy("key").agg(F.max_by(F.struct("language", "markdown"), F.struct("fetched_at", "fetch_id")).alias("r"))
    return last.where("r.markdown is not null").select("key", F.sha2("r.markdown", 256).alias("content_hash"), language_of(F.col("r.language")).alias("language"), site_of(F.col("key")).alias("site"), domain_of(site_of(F.col("key"))).alias("domain"), F.col("r.markdown").alias("text"))


CELLS = ["language", "site", "domain"]


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


class Budget(Store):
    """The ledger, the last state and the cube, kept between runs under one shared folder."""

    tables = {
        "ledger": _schema(content_hash=T.StringType(), tokenizer=T.StringType(), tokens=T.LongType()),
        "state": _schema(key=T.StringType(), content_hash=T.StringType(), **{c: T.StringType() for c in CELLS}),
        "cube": _schema(**{c: T.StringType() for c in CELLS}, documents=T.LongType(), tokens=T.LongType()),
    }
    owner = {"ledger": "content_hash", "state": "key", "cube": "site"}

    def update(self, corpus: DataFrame, vocabulary: str = VOCABULARY) -> dict[str, int]:
        """Brings all three up to date with a corpus (key, content_hash, cells..., text), in one write.

        Gives how many contents were encoded and how many cells changed. Keys
        the corpus no longer has are taken out of the cube; a run that finds no
        change writes nothing.
        """
        ledger, state = self.read("ledger"), self.read("state")
        after = cut_lineage(corpus.select("key", "content_hash", *CELLS))
        new = cut_lineage(update_ledger(ledger, corpus.select("content_hash", "text"), vocabulary))
        change = cut_lineage(deltas(state, after, ledger.unionByName(new), CELLS, vocabulary))
        done = {"encoded": new.count(), "cells": change.count()}
        moved = state.exceptAll(after.select(state.columns)).limit(1).count() or after.select(state.columns).exceptAll(state).limit(1).count()
        if done["encoded"] or done["cells"] or moved:
            self.write({"ledger": new, "state": after, "cube": apply_deltas(self.read("cube"), change, CELLS)}, append=("ledger",))
        return done


def fetched_budget(fetches: DataFrame, at: str, vocabulary: str = VOCABULARY, root: str | None = None) -> DataFrame:
    """(language, site, domain, documents, tokens): the kept cube after two runs, for the corpus at time ``at`` and for all of it.

    The first run encodes every content, the second only unseen ones. ``root``
    is the store's folder; without one a new folder beside the checkpoints.
    """
    spark = fetches.sparkSession
    kept = Budget(spark, root or f"{shared_folder(spark)}/budget-{uuid.uuid4().hex[:12]}")
    kept.update(newest(fetches, F.col("fetched_at") <= F.lit(at).cast("timestamp")), vocabulary)
    kept.update(newest(fetches), vocabulary)
    return kept.read("cube")
