"""Pluggable embedders and rerankers, with offline defaults that need no network."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkseek.functions import columns as C


class Embedder(Protocol):
    """Turns texts into vectors of ``dim`` numbers; ``mode`` is document or query."""

    dim: int

    def embed(self, texts: list[str], mode: str) -> np.ndarray: ...


class HashingEmbedder:
    """Feature hashing of identifier parts and words, signed and scaled to unit length."""

    def __init__(self, dim: int = 64) -> None:
        self.dim = dim
        self._known: dict[str, tuple[int, float]] = {}

    def embed(self, texts: list[str], mode: str = "document") -> np.ndarray:
        import re

        out = np.zeros((len(texts), self.dim))
        for row, text in enumerate(texts):
            for word in re.findall(r"[a-z0-9]+|[^\W\d_a-z]", re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", text or "").lower()):
                if word not in self._known:
                    d = hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest()
                    self._known[word] = int.from_bytes(d[:4], "big") % self.dim, 1.0 if d[4] & 1 else -1.0
                at, sign = self._known[word]
                out[row, at] += sign
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm == 0, 1, norm)


def embedded(rows: DataFrame, text: Column, embedder: Embedder, mode: str = "document", column: str = "embedding") -> DataFrame:
    """``rows`` with the vector of ``text``; the embedder is set up once per worker and works on Arrow batches."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            vectors = np.asarray(embedder.embed(["" if t is None else t for t in texts], mode), dtype=np.float32)
            if vectors.shape != (len(texts), embedder.dim):
                raise ValueError(f"{len(texts)} texts of {embedder.dim} numbers were asked for, the embedder gave {vectors.shape}")
            yield pd.Series(list(vectors))

    return rows.withColumn(column, run(text))


class Reranker(Protocol):
    """Scores texts against a query, higher is better; batches are tasks' own."""

    def scores(self, pairs: list[tuple[str, str]]) -> list[float]: ...


#: Adds to rows the score of a text column against a query column: (rows, query column, text column, score column) -> rows.
Rerank = Callable[[DataFrame, str, str, str], DataFrame]


def overlap_rerank(rows: DataFrame, query: str, text: str, score: str) -> DataFrame:
    """The offline reranker: the share of a query's index tokens that a text holds."""
    return rows.withColumn(score, token_overlap(F.col(query), F.col(text)))


def batched_rerank(reranker: Reranker) -> Rerank:
    """A reranker that works on Arrow batches; pairs of a batch that it fails on have no score, so that fused scores stay."""

    def run(rows: DataFrame, query: str, text: str, score: str) -> DataFrame:
        @F.pandas_udf("double")
        def scores(queries: pd.Series, texts: pd.Series) -> pd.Series:
            try:
                return pd.Series(reranker.scores(list(zip(queries, texts, strict=True))), dtype="float64")
            except Exception:  # a search without the reranker is better than none
                return pd.Series([None] * len(queries), dtype="float64")

        return rows.withColumn(score, scores(F.col(query), F.col(text)))

    return run


def token_overlap(query: Column, text: Column) -> Column:
    """The offline reranker: the share of a query's index tokens that a text holds."""
    asked = F.array_distinct(C.word_tokens(query))
    return F.size(F.array_intersect(asked, F.array_distinct(C.word_tokens(text)))) / F.greatest(F.size(asked), F.lit(1))
