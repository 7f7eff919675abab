"""Slots for models that the engine does not bundle: embedders, scorers, paraphrasers, extractors.

A model is a plain callable over a batch; it runs on executors, Arrow batches at a
time. The stand-ins here are named as such and claim no model quality.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.chunking import sentences_with_marks


class Retriever(Protocol):
    """Anything that answers queries (query_id, text) with (query_id, id, rank, score)."""

    def __call__(self, queries: DataFrame, k: int) -> DataFrame: ...


def hashed_embedder(size: int = 64) -> Callable[[list[str]], np.ndarray]:
    """Stand-in embedder: counts of hashed words, of unit length."""

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), size))
        for row, text in zip(out, texts, strict=True):
            for w in (text or "").lower().split():
                row[crc32(w.encode()) % size] += 1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norm, out=out, where=norm > 0)

    return embed


def overlap_scorer(questions: list[str], texts: list[str]) -> list[float]:
    """Stand-in cross-encoder: share of the question's words in the text."""
    out = []
    for q, t in zip(questions, texts, strict=True):
        words, found = set((q or "").lower().split()), set((t or "").lower().split())
        out.append(len(words & found) / len(words) if words else 0.0)
    return out


def embed(df: DataFrame, embedder: Callable[[list[str]], np.ndarray]) -> DataFrame:
    """``df`` (id, text) as (id, vector)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"id": f["id"], "vector": list(embedder(f["text"].tolist()))})

    return df.select("id", "text").mapInPandas(run, f"id {df.schema['id'].dataType.simpleString()}, vector array<double>")


def score_pairs(pairs: DataFrame, scorer: Callable[[list[str], list[str]], list[float]]) -> DataFrame:
    """``pairs`` (query_id, id, question, text) as (query_id, id, score)."""
    kinds = pairs.schema

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"query_id": f["query_id"], "id": f["id"], "score": scorer(f["question"].tolist(), f["text"].tolist())})

    return pairs.select("query_id", "id", "question", "text").mapInPandas(run, f"query_id {kinds['query_id'].dataType.simpleString()}, id {kinds['id'].dataType.simpleString()}, score double")


def expand_queries(queries: DataFrame, paraphrase: Callable[[str], list[str]]) -> DataFrame:
    """(query_id, variant, text): every query and its paraphrases."""
    more = F.udf(lambda t: [t, *paraphrase(t or "")], "array<string>", useArrow=True)
    return queries.select("query_id", F.posexplode(more("text")).alias("variant", "text"))


def compress(pairs: DataFrame, extract: Callable[[str, str], str]) -> DataFrame:
    """(query_id, id, passage): the part of each text that an extractor picks for its question."""
    pick = F.udf(lambda q, t: extract(q or "", t or ""), "string", useArrow=True)
    return pairs.select("query_id", "id", pick("question", "text").alias("passage"))


def best_sentence(question: Column, text: Column) -> Column:
    """The first of the text's sentences that hold the most distinct words of the question (four letters or more); null if none holds one.

    Built of Column expressions: whole texts, no Python worker.
    """
    known = F.array_distinct(F.filter(F.split(F.lower(question), "[^a-z]+"), lambda w: F.length(w) > 3))
    scored = F.transform(sentences_with_marks(text), lambda s, i: F.struct((-F.size(F.array_intersect(known, F.split(F.lower(s), "[^a-z]+")))).alias("n"), i.alias("i"), s.alias("s")))
    best = F.array_min(scored)
    return F.when(best["n"] < 0, best["s"])


class Processors:
    """File processors by priority: (name, predicate over file columns); the first that fits takes a file."""

    def __init__(self):
        self.known: list[tuple[str, object]] = []

    def register(self, name: str, accepts) -> None:
        self.known.append((name, accepts))

    def route(self) -> Column:
        out = None
        for name, accepts in self.known:
            out = F.when(accepts, F.lit(name)) if out is None else out.when(accepts, F.lit(name))
        return F.lit(None).cast("string") if out is None else out
