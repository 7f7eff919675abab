"""Work that may fail, tried again after growing pauses, and what is left over.

A failure is a value, not an exception: the step returns an error beside its result,
so one bad row neither ends a job nor makes Spark repeat a whole task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.graph import written

#: Attempts after the first, and the base of the pause in seconds before each.
RETRIES, BASE = 3, 2.0


def attempted(rows: DataFrame, step: Callable[[DataFrame], DataFrame], retries: int = RETRIES, base: float = BASE) -> tuple[DataFrame, DataFrame]:
    """(done, dead) of a step over a table, in at most ``retries`` + 1 rounds.

    ``step`` takes rows with a column ``attempt`` (from 0) and returns them with
    ``error``, null if the row is done. Rows that fail go into the next round,
    ``base`` to the power of the attempt later. ``done`` has ``attempts`` and ``waited``, the seconds
    of pauses before; ``dead`` has them too, and the last error.
    """
    left, done, waited = rows, None, 0.0
    for attempt in range(retries + 1):
        tried = written(step(left.withColumn("attempt", F.lit(attempt))))
        counted = tried.drop("attempt").withColumns({"attempts": F.lit(attempt + 1), "waited": F.lit(waited)})
        good = counted.where("error is null").drop("error")
        done = good if done is None else done.unionByName(good)
        failed = counted.where("error is not null")
        if attempt == retries or failed.isEmpty():
            return done, failed
        left = failed.select(*rows.columns)
        waited += base**attempt
    raise AssertionError("unreachable")


class RetryProcessor(StatefulProcessor):
    """Failing rows of a stream wait in state for a timer; those beyond their last attempt come out as dead."""

    def __init__(self, step: Callable[[str, int], str | None], key: str, retries: int = RETRIES, base: float = BASE):
        #: ``step`` takes the payload and the attempt and returns an error or None.
        self.step, self.key, self.retries, self.base = step, key, retries, base

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "due long, n int", "payload string, attempt int")

    def _try(self, payload: str, attempt: int, now: int) -> tuple[str, str, int, str | None] | None:
        error = self.step(payload, attempt)
        if error is None:
            return payload, "done", attempt + 1, None
        if attempt == self.retries:
            return payload, "dead", attempt + 1, error
        due, n = now + int(self.base**attempt * 1000), 0
        while self.waiting.containsKey((due, n)):
            n += 1
        self.waiting.updateValue((due, n), (payload, attempt + 1))
        self.handle.registerTimer(due)
        return None

    def _out(self, key, results) -> pd.DataFrame:
        kept = [r for r in results if r]
        texts = lambda n: pd.Series([r[n] for r in kept], dtype=object)
        return pd.DataFrame({self.key: [key[0]] * len(kept), "payload": texts(0), "state": texts(1), "attempts": [r[2] for r in kept], "error": texts(3)})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentProcessingTimeInMs()
        yield self._out(key, [self._try(p, 0, now) for frame in rows for p in frame["payload"]])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentProcessingTimeInMs()
        due = [(k, v) for k, v in list(self.waiting.iterator()) if k[0] <= now]
        for k, _ in due:
            self.waiting.removeKey(k)
        yield self._out(key, [self._try(payload, attempt, now) for _, (payload, attempt) in due])

    def close(self) -> None:
        pass


def attempted_stream(rows: DataFrame, step: Callable[[str, int], str | None], key: str, retries: int = RETRIES, base: float = BASE) -> DataFrame:
    """(key, payload, state, attempts, error) of a stream of (key, payload): ``done`` or ``dead``, each row once."""
    schema = f"{key} {rows.schema[key].dataType.simpleString()}, payload string, state string, attempts int, error string"
    return rows.select(key, "payload").groupBy(key).transformWithStateInPandas(RetryProcessor(step, key, retries, base), schema, "Append", "ProcessingTime")
