"""What a deployment may replace: tokenizer, embedder, reranker, decomposer, page source. The defaults need no network."""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections.abc import Callable, Sequence
from typing import Protocol


class Tokenizer(Protocol):
    def count(self, text: str) -> int: ...

    def ends(self, text: str) -> list[int]:
        """Ascending character positions at which a token ends."""


class WordTokenizer:
    """Words between white space; a text has at least one."""

    _word = re.compile(r"\S+")

    def count(self, text: str) -> int:
        return max(1, len(text.split()))

    def ends(self, text: str) -> list[int]:
        return [m.end() for m in self._word.finditer(text)]


class BytePairTokenizer:
    """A public byte-level vocabulary from a file; needs ``tiktoken``."""

    pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, vocabulary: str) -> None:
        self.vocabulary, self._enc = vocabulary, None

    def _encoding(self):
        if self._enc is None:
            import base64

            import tiktoken

            with open(self.vocabulary, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self._enc = tiktoken.Encoding("public", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={})
        return self._enc

    def __getstate__(self) -> dict:
        return {"vocabulary": self.vocabulary, "_enc": None}

    def count(self, text: str) -> int:
        return len(self._encoding().encode_ordinary(text))

    def ends(self, text: str) -> list[int]:
        enc = self._encoding()
        parts = enc.decode_tokens_bytes(enc.encode_ordinary(text))
        if b"".join(parts) != text.encode():
            raise ValueError("the tokens don't give the text back")
        out, pos = [], 0
        for p in parts:  # a token ends where its last byte's character begins, if that goes on in the next token
            pos += sum((c & 0xC0) != 0x80 for c in p)
            out.append(pos)
        return out


def token_offsets(ends: Sequence[int], start: int, end: int) -> tuple[int, int]:
    """Token span of a character span: tokens that end at or before each side; the end is never before the start."""
    limit = ends[-1] if ends else 0
    a, b = (bisect_right(ends, min(max(0, x), limit)) for x in (start, end))
    return a, max(a, b)


class Embedder(Protocol):
    dims: int

    def embed(self, texts: Sequence[str]) -> list[list[float]]: ...


class HashingEmbedder:
    """A bag of words and word pairs hashed into signed dimensions, of length 1; the same text has the same vector everywhere."""

    def __init__(self, dims: int = 64) -> None:
        self.dims = dims

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        return [self._one(t) for t in texts]

    def _one(self, text: str) -> list[float]:
        words = re.findall(r"\w+", text.lower())
        v = [0.0] * self.dims
        for gram in (*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))):
            h = int.from_bytes(hashlib.blake2b(gram.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big")
            v[(h >> 1) % self.dims] += 1.0 if h & 1 else -1.0
        norm = math.sqrt(sum(x * x for x in v))
        return [x / norm for x in v] if norm else [1.0] + [0.0] * (self.dims - 1)


def checked_embeddings(embedder: Embedder, texts: Sequence[str], batch: int = 256) -> list[list[float]]:
    """Vectors of texts in batches; a wrong number or length of vectors fails as a whole."""
    out: list[list[float]] = []
    for lo in range(0, len(texts), batch):
        part = list(texts[lo : lo + batch])
        got = embedder.embed(part)
        if len(got) != len(part):
            raise ValueError(f"{len(part)} texts, but {len(got)} vectors")
        if any(len(v) != embedder.dims for v in got):
            raise ValueError(f"a vector hasn't {embedder.dims} dimensions")
        out += got
    return out


class Reranker(Protocol):
    def rerank(self, query: str, passages: Sequence[str]) -> list[tuple[int, float, float | None]]:
        """(index, score, confidence) of passages."""


class OverlapReranker:
    """Share of the query's words that a passage has; a stand-in for a remote cross-encoder."""

    def rerank(self, query: str, passages: Sequence[str]) -> list[tuple[int, float, float | None]]:
        q = set(re.findall(r"\w+", query.lower()))
        return [(i, len(q & set(re.findall(r"\w+", p.lower()))) / max(1, len(q)), None) for i, p in enumerate(passages)]


class RemoteReranker:
    """A cross-encoder behind a function ``post(query, passages) -> [(index, score)]``, which does the request.

    Some services take an instruction: it stands before the query, a full stop
    between them. Indices outside the passages are an error, so that the
    caller falls back to the order given.
    """

    def __init__(self, post: Callable[[str, list[str]], Sequence[tuple[int, float]]], instruction: str | None = None) -> None:
        self.post, self.instruction = post, instruction

    def rerank(self, query: str, passages: Sequence[str]) -> list[tuple[int, float, float | None]]:
        got = self.post(f"{self.instruction}. {query}" if self.instruction else query, list(passages))
        if any(not 0 <= i < len(passages) for i, _ in got):
            raise ValueError("the service named a passage that wasn't sent")
        return [(int(i), float(s), float(s)) for i, s in got]
