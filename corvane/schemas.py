"""Schemas of the corpus tables."""

from __future__ import annotations

from pyspark.sql import types as T

IMAGE_REFS = T.ArrayType(T.StructType([T.StructField(f, T.StringType()) for f in ("url", "alt", "title", "caption")]))
FLAGS = ("has_table", "has_code", "has_math", "has_definition_list", "has_admonition", "has_steps")
_KINDS = {"string": T.StringType(), "int": T.IntegerType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType(), "strings": T.ArrayType(T.StringType()), "vector": T.ArrayType(T.FloatType()), "images": IMAGE_REFS}


def _schema(text: str) -> T.StructType:
    """``name kind`` pairs, separated by commas."""
    return T.StructType([T.StructField(n, _KINDS[k]) for n, k in (p.split() for p in text.split(","))])


NORMALIZED = _schema(
    "url string, source_url string, title string, description string, language string, status_code int, published_time string, modified_time string, "
    "markdown string, html string, links strings, fetched_at timestamp, content_hash string, doc_type string"
)
DOCUMENTS = _schema(
    "document_id string, url string, source_url string, title string, description string, language string, status_code int, published_time string, "
    "modified_time string, doc_type string, content_hash string, fetched_at timestamp, indexed_at timestamp, depth int"
)
CHUNKS = _schema(
    "chunk_id string, document_id string, parent_id string, chunk_level string, chunk_index int, section_heading string, chunk_text string, html_text string, "
    + ", ".join(f"{f} boolean" for f in FLAGS)
    + ", has_image boolean, image_context_text string, image_refs images, char_start int, char_end int, token_start int, token_end int, "
    "embedding vector, source_url string, fetched_at timestamp, depth int, title string"
)
LINKS = _schema("id string, source_document_id string, source_url string, target_url string, title string, description string, discovered_at timestamp, enriched_at timestamp, depth int")
