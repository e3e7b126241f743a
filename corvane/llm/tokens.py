"""Counting tokens with a public tokenizer, whose vocabulary is a file that is never copied here."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary lies on every machine; a parameter of all operators here.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how byte-level BPE vocabularies of this kind cut a text before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=4)
def encoding(vocabulary: str):
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=4)
def tokenizer_hash(vocabulary: str) -> str:
    """Names the tokenizer: a hash of its vocabulary and of the pattern."""
    return hashlib.sha256(Path(vocabulary).read_bytes() + PATTERN.encode()).hexdigest()[:16]


def count_tokens(text: str | None, vocabulary: str = VOCABULARY) -> int:
    return len(encoding(vocabulary).encode_ordinary(text)) if text else 0


def with_tokens(df: DataFrame, text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """``df`` with ``text`` replaced by ``tokens``; null and empty texts have 0 tokens."""
    rest = [c for c in df.columns if c not in (text, "tokens")]
    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = pa.array([count_tokens(x, vocabulary) for x in b.column(len(rest)).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(rest)], n], [*rest, "tokens"])

    return df.select(*rest, F.col(text).cast("string").alias(text)).mapInArrow(run, f"{fields}, tokens bigint")
