"""Maximal marginal relevance over each query's bounded candidate list."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def select(vectors: np.ndarray, query: np.ndarray, scores: np.ndarray, k: int, trade: float = 0.7, digits: int = 9) -> list[int]:
    """Indices picked greedily: the best score, then relevance less likeness to what is picked, ties by place."""
    n = len(vectors)
    if k >= n:
        return list(range(n))
    unit = vectors / (np.linalg.norm(vectors, axis=1, keepdims=True) + 1e-8)
    relevance = unit @ (query / (np.linalg.norm(query) + 1e-8))
    picked = [int(np.argmax(scores))]
    closest = unit @ unit[picked[0]]
    while len(picked) < k:
        value = np.round(trade * relevance - (1 - trade) * closest, digits)
        value[picked] = -np.inf
        picked.append(int(np.argmax(value)))
        closest = np.maximum(closest, unit @ unit[picked[-1]])
    return picked


def rerank(candidates: DataFrame, k: int, trade: float = 0.7) -> DataFrame:
    """(query_id, id, rank) from (query_id, id, rank, score, vector, query_vector).

    Candidates are the bounded top list of a search, so a group fits a task. A
    candidate without a vector is like nothing.
    """

    def one(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("rank")
        query = np.asarray(group["query_vector"].iloc[0], float)
        rows = np.stack([np.zeros_like(query) if v is None else np.asarray(v, float) for v in group["vector"]])
        order = select(rows, query, group["score"].to_numpy(), k, trade)
        picked = group.iloc[order]
        return pd.DataFrame({"query_id": picked["query_id"], "id": picked["id"], "rank": np.arange(1, len(picked) + 1)})

    kinds = candidates.schema
    return candidates.groupBy("query_id").applyInPandas(one, f"query_id {kinds['query_id'].dataType.simpleString()}, id {kinds['id'].dataType.simpleString()}, rank int")
