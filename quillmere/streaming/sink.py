"""Events of answers that are being written, given out once each whatever is restarted.

A streaming query hands its batches over with their numbers. What a batch gives is
written into a folder of that number, whole or not at all: a batch that runs again
after a crash overwrites its own folder, so readers see every event once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Kinds of events in the order in which an answer gives them.
KINDS = ("status", "citations", "token", "done", "error")


def answer_events(tokens: DataFrame) -> DataFrame:
    """(stream_id, seq, kind, payload) from (stream_id, seq, token, citations, last, failed).

    The first token of an answer is led by a status and, if there are any, its
    citations; each token that shows something is an event; the last is followed by
    ``done`` with the answer's number of tokens, a failed one by ``error`` instead.
    Rows are turned into their events one by one, so this works on a stream too.
    """
    event = lambda when, place, kind, payload: F.when(when, F.struct((F.col("seq") * 4 + place).alias("seq"), F.lit(kind).alias("kind"), payload.cast("string").alias("payload")))
    first, failed = F.col("seq") == 0, F.coalesce("failed", F.lit(False))
    shown = F.coalesce("token", F.lit("")) != ""
    events = F.array(
        event(first, 0, "status", F.lit("generating")),
        event(first & (F.size("citations") > 0), 1, "citations", F.to_json("citations")),
        event(shown & ~failed, 2, "token", F.col("token")),
        event(failed, 3, "error", F.col("token")),
        event(F.coalesce("last", F.lit(False)) & ~failed, 3, "done", F.col("seq") + 1),
    )
    return tokens.select("stream_id", F.explode(F.filter(events, lambda e: e.isNotNull())).alias("e")).select("stream_id", "e.seq", "e.kind", "e.payload")


def _folder(path: str, batch: int) -> str:
    return f"{path}/batch={batch:012d}"


def to_log(path: str, after: Callable[[int], None] | None = None) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: events into ``path``, a folder for each batch. ``after`` is called when one is written."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(_folder(path, number))
        if after:
            after(number)

    return write


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All events that were given out."""
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(path)


def latest_state(path: str, key: str, order: list[str], schema: str, after: Callable[[int], None] | None = None) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: the last row of every ``key`` so far, a table for each batch, made from the one before.

    Batches have consecutive numbers from 0. A batch that runs again makes its table
    again from the same predecessor, so nothing counts twice; older tables than that
    may go. What is fanned out to many readers is the table of the last batch.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.select(*spark.createDataFrame([], schema).columns)
        if number > 0:
            rows = rows.unionByName(spark.read.schema(schema).parquet(_folder(path, number - 1)))
        last = F.row_number().over(Window.partitionBy(key).orderBy(*[F.col(c).desc() for c in order]))
        rows.withColumn("place_", last).where("place_ = 1").drop("place_").write.mode("overwrite").parquet(_folder(path, number))
        if after:
            after(number)

    return write
