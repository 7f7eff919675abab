"""A written BM25 index: built once, appended to, asked by any number of queries.

Documents are dealt into blocks of at most ``BLOCK_DOCS``; a row of ``postings`` has
one block's documents with one term, as places in the block, and one row of each
block, without a term, has the block's ids and lengths. They are written by the task
that reads the texts, without a shuffle; each file is sorted by term, so a scan for
asked terms skips row groups that hold none of them. A query's terms meet the rows of
their postings by broadcast, and all rows of one block are scored together against at
most ``BLOCK_QUERIES`` queries in numpy. What leaves a block is its best k a query.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .graph import shared_folder, written

BLOCK_DOCS, BLOCK_QUERIES = 2048, 256

#: Asked terms that a scan is filtered by; more are joined alone.
FILTER_TERMS = 1000
#: Terms of a block that are multiplied at once.
CHUNK_TERMS = 512


def _postings(kind: pa.DataType, increment: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), 0
        for batch in batches:
            for low in range(0, batch.num_rows, BLOCK_DOCS):
                part = batch.slice(low, BLOCK_DOCS)
                words = pc.ascii_split_whitespace(part.column("text"))
                owner, flat = pc.list_parent_indices(words).to_numpy(), pc.list_flatten(words)
                real = pc.not_equal(flat, "")
                owner, coded = owner[real.to_numpy(zero_copy_only=False)], flat.filter(real).dictionary_encode()
                order = pc.sort_indices(coded.dictionary)
                place = np.empty(len(order), np.int64)
                place[order.to_numpy()] = np.arange(len(order))
                # One number for a term and a document, so that sorting them counts the occurrences.
                found, tf = np.unique(place[coded.indices.to_numpy()] * BLOCK_DOCS + owner, return_counts=True)
                starts = np.searchsorted(found, np.arange(len(order) + 1) * BLOCK_DOCS).astype(np.int32)
                lists = lambda values, kind: pa.ListArray.from_arrays(pa.array(starts), pa.array(values, kind))  # noqa: B023, E731
                # A task that runs again gives its blocks the same numbers.
                number = int.from_bytes(hashlib.sha256(f"{increment}:{task}:{made}".encode()).digest()[:8], "big", signed=True)
                made += 1
                none, lengths = pa.nulls(len(order), pa.list_(kind)), np.bincount(owner, minlength=part.num_rows)
                names = ["block", "term", "docs", "tfs", "ids", "lengths"]
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.nulls(1, pa.string()), pa.nulls(1, pa.list_(pa.int16())), pa.nulls(1, pa.list_(pa.int32())), pa.array([part.column("id").cast(kind)], pa.list_(kind)), pa.array([lengths], pa.list_(pa.int32()))], names)
                if len(order):
                    block = pa.array(np.full(len(order), number), pa.int64())
                    yield pa.RecordBatch.from_arrays([block, coded.dictionary.take(order), lists(found % BLOCK_DOCS, pa.int16()), lists(tf, pa.int32()), none, pa.nulls(len(order), pa.list_(pa.int32()))], names)

    return run


@dataclass
class KeywordIndex:
    """Where the tables of an index are. ``postings`` and ``terms`` grow by appended files, ``totals`` by rows."""

    spark: SparkSession
    path: str

    @classmethod
    def build(cls, docs: DataFrame) -> KeywordIndex:
        """An index of ``docs`` (id, text) in the folder that all executors share; null texts have no terms."""
        made = cls(docs.sparkSession, f"{shared_folder(docs.sparkSession)}/quillmere/keywords-{uuid.uuid4().hex}")
        return made.append(docs)

    def append(self, docs: DataFrame) -> KeywordIndex:
        """Add documents; ids are not checked against those already there."""
        kind = docs.schema["id"].dataType
        rows = docs.select("id", F.col("text").cast("string").alias("text"))
        conf = self.spark.conf
        if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BLOCK_DOCS:
            conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BLOCK_DOCS))
        name = uuid.uuid4().hex
        found = rows.mapInArrow(_postings(to_arrow_type(kind), name), f"block long, term string, docs array<short>, tfs array<int>, ids array<{kind.simpleString()}>, lengths array<int>")
        increment = f"{self.path}/postings/increment={name}"
        found.sortWithinPartitions("term", "block").write.parquet(increment)
        postings = self.spark.read.parquet(increment)
        postings.where("term is not null").groupBy("term").agg(F.sum(F.size("docs")).alias("df")).write.mode("append").parquet(f"{self.path}/terms")
        words = F.aggregate("lengths", F.lit(0).cast("long"), lambda x, y: x + y)
        totals = postings.where("term is null").agg(F.coalesce(F.sum(F.size("ids")), F.lit(0)).alias("n"), F.sum(words).alias("words"))
        totals.write.mode("append").parquet(f"{self.path}/totals")
        return self

    def postings(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/postings").drop("increment")

    def frequencies(self) -> tuple[DataFrame, float, int]:
        """(term, df) of the whole index, the mean length of its documents and their number."""
        totals = self.spark.read.parquet(f"{self.path}/totals")
        total = totals.agg(F.sum("n").alias("n"), F.sum("words").alias("words"), F.count(F.lit(1)).alias("increments")).first()
        terms = self.spark.read.parquet(f"{self.path}/terms")
        if total.increments > 1:  # one increment has each term once
            terms = terms.groupBy("term").agg(F.sum("df").alias("df"))
        return terms, float(total.words or 0) / max(total.n or 0, 1), total.n or 0

    def top_k(self, queries: DataFrame, k: int, k1: float = 1.5, b: float = 0.75, floor: float = 0.25, digits: int = 6) -> DataFrame:
        """(query_id, id, rank, score): Okapi BM25 over white-space terms, the best ``k`` of each query (query_id, text).

        A negative idf becomes ``floor`` times the mean idf of all terms; repeated
        query terms count each time. Ties go to the lower id. Queries without a
        known term have no rows.
        """
        terms, mean_length, n = self.frequencies()
        idf = terms.select("term", (F.log(F.lit(n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("idf"))
        mean = idf.agg(F.avg("idf")).first()[0] or 0.0
        asked = queries.select("query_id", F.explode(F.array_remove(F.split("text", r"[ \t\n\x0b\f\r]+"), "")).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times"))
        weight = F.col("times") * F.when(F.col("idf") < 0, floor * mean).otherwise(F.col("idf"))
        blocks = max(1, -(-queries.count() // BLOCK_QUERIES))
        part = F.pmod(F.xxhash64("query_id"), F.lit(blocks))
        weights = idf.join(F.broadcast(asked), "term").select("term", "query_id", weight.alias("weight"), part.alias("part"))
        lists = weights.groupBy("term", "part").agg(F.collect_list(F.struct("query_id", "weight")).alias("l"))  # a block of queries at most
        lists = written(lists.select("term", "part", F.col("l.query_id").alias("queries"), F.col("l.weight").alias("weights")))
        every = self.postings()
        postings = every.where("term is not null").select("block", "term", "docs", "tfs")
        some = [r.term for r in asked.select("term").distinct().limit(FILTER_TERMS + 1).collect()]
        if len(some) <= FILTER_TERMS:
            postings = postings.where(F.col("term").isin(some))
        id_type, query_type = every.schema["ids"].dataType.elementType, queries.schema["query_id"].dataType
        id_kind, query_kind = to_arrow_type(id_type), to_arrow_type(query_type)

        def score(table: pa.Table) -> pa.Table:
            flat = lambda c: table.column(c).combine_chunks()
            empty = pa.table({"query_id": pa.array([], query_kind), "id": pa.array([], id_kind), "score": pa.array([], pa.float64())})
            head = table.filter(pc.is_valid(table.column("ids")))
            table = table.filter(pc.is_valid(table.column("docs")))
            if not table.num_rows:
                return empty
            ids, length = head.column("ids").combine_chunks().flatten(), head.column("lengths").combine_chunks().flatten().to_numpy().astype(float)
            order = pc.sort_indices(ids).to_numpy()
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            docs, queries = flat("docs"), flat("queries")
            asking = queries.flatten().unique()
            to, query, weight = np.diff(queries.offsets.to_numpy()), pc.index_in(queries.flatten(), asking).to_numpy(), flat("weights").flatten().to_numpy()
            at, doc = np.diff(docs.offsets.to_numpy()), docs.flatten().to_numpy().astype(np.int64)
            tf = flat("tfs").flatten().to_numpy().astype(float)
            value = tf * (k1 + 1) / (tf + k1 * (1 - b + b * length[doc] / mean_length))
            of_query, of_doc = np.repeat(np.arange(len(to)), to), np.repeat(np.arange(len(at)), at)
            scores = np.zeros((len(asking), len(order)))
            hit = np.zeros(scores.shape, bool)
            for low in range(0, len(to), CHUNK_TERMS):
                q, d = slice(*np.searchsorted(of_query, [low, low + CHUNK_TERMS])), slice(*np.searchsorted(of_doc, [low, low + CHUNK_TERMS]))
                n = min(CHUNK_TERMS, len(to) - low)
                left, right = np.zeros((len(asking), n)), np.zeros((n, len(order)))
                left[query[q], of_query[q] - low] = weight[q]
                right[of_doc[d] - low, place[doc[d]]] = value[d]
                scores += left @ right
                left[query[q], of_query[q] - low] = 1
                hit |= left.astype(np.float32) @ (right > 0).astype(np.float32) > 0
            scores = np.where(hit, np.round(scores, digits), -np.inf)
            best = np.argsort(-scores, axis=1, kind="stable")[:, :k]
            chosen = np.take_along_axis(hit, best, 1)
            rows, _ = np.nonzero(chosen)
            named = ids.take(pa.array(order[best[chosen]]))
            return pa.table({"query_id": asking.take(pa.array(rows)).cast(query_kind), "id": named.cast(id_kind), "score": scores[rows, best[chosen]]})

        matched = postings.join(F.broadcast(lists), "term").select("block", "part", "docs", "tfs", "queries", "weights")
        heads = every.where("term is null").select("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("part"), "ids", "lengths")
        scored = matched.unionByName(heads, allowMissingColumns=True).groupBy("block", "part").applyInArrow(score, f"query_id {query_type.simpleString()}, id {id_type.simpleString()}, score double")
        ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")))
        return ranked.where(F.col("rank") <= k).select("query_id", "id", "rank", "score")


_built: dict[tuple, KeywordIndex] = {}


def index_of(docs: DataFrame) -> KeywordIndex:
    """The index of ``docs`` (id, text), built at the first call for these files in this application."""
    key = (docs.sparkSession.sparkContext.applicationId, *sorted(docs.inputFiles()))
    if key not in _built:
        _built[key] = KeywordIndex.build(docs)
    return _built[key]
