"""Vector search: exact top-k and pairs, in blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: Query vectors and vectors that one task holds at once.
QUERY_BLOCK = 16_384
VECTOR_BLOCK = 8192
#: Scores that a task holds at once, about.
CELLS = 2_000_000
#: Rows of a block that are held against all of another at once.
PAIR_ROWS = 512


def _unit(rows: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, norm, out=np.zeros_like(rows), where=norm > 0)


def _matrix(column: pa.Array) -> np.ndarray:
    if not len(column):
        return np.zeros((0, 0))
    flat = column.flatten()
    if flat.null_count or len(flat) % len(column):
        return np.array(column.to_pylist(), np.float64).reshape(len(column), -1)
    return flat.to_numpy().astype(np.float64).reshape(len(column), -1)


def _dealt(df: DataFrame, own: str, own_blocks: int, met: str, met_blocks: int, key: str) -> DataFrame:
    """``df`` dealt into blocks by a hash of its key, each row once for every block of the other side."""
    block = F.pmod(F.xxhash64(key), F.lit(own_blocks)).cast("int")
    return df.select("*", block.alias(own), F.explode(F.sequence(F.lit(0), F.lit(met_blocks - 1))).alias(met))


def vector_top_k(vectors: DataFrame, queries: DataFrame, k: int, digits: int = 6, within: str | None = None) -> DataFrame:
    """(query_id, id, rank, score): the ``k`` rows of highest cosine for every query.

    ``vectors`` has (id, vector), ``queries`` (query_id, vector). Both are dealt into
    blocks, ``VECTOR_BLOCK`` and ``QUERY_BLOCK`` rows large; a block of queries and a
    block of vectors meet in one task, as matrix products of ``CELLS`` scores, and the
    task passes on its own best k per query, of which a window keeps the best. Only two
    counts reach the driver. ``within`` names a column of both sides, which must be equal for a row to
    be found (the search inside one file); a null there finds nothing. Zero vectors
    score 0; rows without a vector are left out; ties go to the lower id.
    """
    columns = ["vector"] if within is None else ["vector", within]
    vectors, queries = vectors.where("vector is not null").select("id", *columns), queries.where("vector is not null").select("query_id", *columns)
    sizes = vectors.agg(F.count(F.lit(1))).first()[0], queries.agg(F.count(F.lit(1))).first()[0]
    vector_blocks, query_blocks = max(1, -(-sizes[0] // VECTOR_BLOCK)), max(1, -(-sizes[1] // QUERY_BLOCK))
    one = _dealt(vectors, "vb", vector_blocks, "qb", query_blocks, "id").groupBy("vb", "qb")
    two = _dealt(queries, "qb", query_blocks, "vb", vector_blocks, "query_id").groupBy("vb", "qb")
    kinds = vectors.schema["id"].dataType, queries.schema["query_id"].dataType
    id_kind, query_kind = to_arrow_type(kinds[0]), to_arrow_type(kinds[1])

    def best(found: pa.Table, asked: pa.Table) -> pa.Table:
        if not found.num_rows or not asked.num_rows:
            return pa.table({"query_id": pa.array([], query_kind), "id": pa.array([], id_kind), "score": pa.array([], pa.float64())})
        found = found.sort_by("id")
        rows, cols = found.column("vector").combine_chunks(), asked.column("vector").combine_chunks()
        left, right = _unit(_matrix(rows)), _unit(_matrix(cols)).T
        if within is not None:
            own, wanted = np.array(found.column(within).to_pylist(), object), np.array(asked.column(within).to_pylist(), object)
        ids, names, parts = found.column("id").combine_chunks(), asked.column("query_id").combine_chunks(), []
        step = max(1, CELLS // found.num_rows)
        for low in range(0, asked.num_rows, step):
            scores = np.round(left @ right[:, low : low + step], digits)
            if within is not None:
                scores[(own[:, None] != wanted[None, low : low + step]) | (own == None)[:, None]] = -np.inf  # noqa: E711
            top = np.argsort(-scores, axis=0, kind="stable")[:k]
            kept = np.take_along_axis(scores, top, 0).ravel()
            some = np.flatnonzero(np.isfinite(kept))
            named = np.tile(np.arange(low, low + scores.shape[1]), len(top))[some]
            parts.append(pa.table({"query_id": names.take(pa.array(named)), "id": ids.take(pa.array(top.ravel()[some])), "score": pa.array(kept[some])}))
        return pa.concat_tables(parts)

    out = one.cogroup(two).applyInArrow(best, f"query_id {kinds[1].simpleString()}, id {kinds[0].simpleString()}, score double")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "id", "rank", "score")


def similar_pairs(vectors: DataFrame, threshold: float, digits: int = 6) -> DataFrame:
    """(a, b, score) of all pairs a < b with cosine above ``threshold``, by blocked products.

    Vectors are dealt into blocks by a hash of their id, about ``VECTOR_BLOCK`` in
    each; every two blocks meet in one task, ``PAIR_ROWS`` rows at a time. Nothing passes through the driver but
    the number of vectors.
    """
    kind = vectors.schema["id"].dataType.simpleString()
    blocks = max(1, -(-vectors.count() // VECTOR_BLOCK))
    own = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    dealt = vectors.select("id", "vector", own.alias("own"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("met"))
    dealt = dealt.select("id", "vector", "own", F.least("own", "met").alias("low"), F.greatest("own", "met").alias("high"))

    def near(table: pa.Table) -> pa.Table:
        ids, own = table.column("id").combine_chunks(), table.column("own").to_numpy()
        rows = _unit(_matrix(table.column("vector").combine_chunks()))
        low, high = table.column("low")[0].as_py(), table.column("high")[0].as_py()
        one, two = np.flatnonzero(own == low), np.flatnonzero(own == high)
        names, other = ids.to_pylist(), rows[two].T
        keep = []
        for first in range(0, len(one), PAIR_ROWS):
            some = one[first : first + PAIR_ROWS]
            scores = rows[some] @ other
            i, j = np.nonzero(scores > threshold)
            keep += [(names[some[x]], names[two[y]], float(scores[x, y])) for x, y in zip(i.tolist(), j.tolist(), strict=True)]
        keep = [(a, b, s) if a < b else (b, a, s) for a, b, s in keep if a < b or low != high and a != b]
        return pa.table({"a": pa.array([a for a, _, _ in keep], ids.type), "b": pa.array([b for _, b, _ in keep], ids.type), "score": pa.array([s for _, _, s in keep], pa.float64())})

    return dealt.groupBy("low", "high").applyInArrow(near, f"a {kind}, b {kind}, score double").withColumn("score", F.round("score", digits))
