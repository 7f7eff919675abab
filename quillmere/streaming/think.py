"""Removal of thinking regions from token streams, tags split over tokens included."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

# The tags.
OPEN = ("<think>", "<thinking>")
CLOSE = ("</think>", "</thinking>")
PREFACE = 512


def _first(text: str, tags: tuple[str, ...]) -> tuple[int, int] | None:
    found = [(i, i + len(t)) for t in tags if (i := text.find(t)) >= 0]
    return min(found) if found else None


def _held(text: str, tags: tuple[str, ...]) -> int:
    """Length of the longest ending that may grow into a tag."""
    return max((k for t in tags for k in range(1, len(t)) if text.endswith(t[:k])), default=0)


class ThinkFilter:
    """Feed tokens, get what may be shown. State is (buffer, inside, preface)."""

    def __init__(self, buffer: str = "", inside: bool = False, preface: bool = True, limit: int = PREFACE):
        self.buffer, self.inside, self.preface, self.limit = buffer, inside, preface, limit

    def feed(self, token: str | None) -> str:
        self.buffer += token or ""
        if self.preface:
            tag = _first(self.buffer, OPEN)
            if tag:
                self.buffer, self.preface = self.buffer[tag[0] :], False
            elif len(self.buffer) >= self.limit:
                self.preface = False
            else:
                return ""
        out = []
        while self.buffer:
            tag = _first(self.buffer, CLOSE if self.inside else OPEN + CLOSE)
            if tag:
                if not self.inside:
                    out.append(self.buffer[: tag[0]])
                    self.inside = self.buffer[tag[0] : tag[1]] in OPEN
                else:
                    self.inside = False
                self.buffer = self.buffer[tag[1] :]
                continue
            keep = _held(self.buffer, CLOSE if self.inside else OPEN + CLOSE)
            if not self.inside:
                out.append(self.buffer[: len(self.buffer) - keep])
            self.buffer = self.buffer[len(self.buffer) - keep :]
            break
        return "".join(out)

    def flush(self) -> str:
        """What is left when the stream ends; an unclosed region is dropped."""
        text = "" if self.inside else self.buffer
        for tag in CLOSE:
            text = text.replace(tag, "")
        self.buffer, self.preface = "", False
        return text


def _fed(f: ThinkFilter, tokens: pa.Array) -> str:
    """What ``f`` shows of ``tokens``: one by one while it may still be in a preface, then as one, as tags decide the same."""
    out, at = [], 0
    while f.preface and at < len(tokens):
        out.append(f.feed(tokens[at].as_py()))
        at += 1
    rest = tokens.slice(at).drop_null()
    if len(rest):
        out.append(f.feed("".join(rest.to_pylist())))
    return "".join(out)


def filter_batch(tokens: DataFrame) -> DataFrame:
    """(stream_id, shown) from finished streams of (stream_id, seq, token), which follow each other in a task in order."""
    kind = tokens.schema["stream_id"].dataType
    ids = to_arrow_type(kind)

    def shown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, f, parts = None, None, []
        for batch in batches:
            column, said, done = batch.column("stream_id"), batch.column("token"), []
            one, two = column.slice(1), column.slice(0, max(len(column) - 1, 0))
            other = pc.if_else(pc.and_(pc.is_null(one), pc.is_null(two)), False, pc.fill_null(pc.not_equal(one, two), True))
            ends = np.flatnonzero(other.to_numpy(zero_copy_only=False)) + 1
            for low, high in zip([0, *ends.tolist()], [*ends.tolist(), len(column)], strict=True):
                if low == high:
                    continue
                if f is None or column[low].as_py() != own:
                    if f is not None:
                        done.append((own, "".join(parts) + f.flush()))
                    own, f, parts = column[low].as_py(), ThinkFilter(), []
                parts.append(_fed(f, said.slice(low, high - low)))
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], ids), pa.array([t for _, t in done], pa.string())], ["stream_id", "shown"])
        if f is not None:
            yield pa.RecordBatch.from_arrays([pa.array([own], ids), pa.array(["".join(parts) + f.flush()], pa.string())], ["stream_id", "shown"])

    tasks = int(tokens.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a number, as few bytes are much work
    ordered = tokens.select("stream_id", "seq", "token").repartition(tasks, "stream_id").sortWithinPartitions("stream_id", "seq")
    return ordered.mapInArrow(shown, f"stream_id {kind.simpleString()}, shown string")


class ThinkProcessor(StatefulProcessor):
    """The same filter for ``transformWithStateInPandas`` over a live stream."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("filter", "buffer string, inside boolean, preface boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        known = self.state.get() if self.state.exists() else None
        f = ThinkFilter(*known) if known else ThinkFilter()
        shown = "".join(f.feed(t) for frame in rows for t in frame.sort_values("seq")["token"])
        self.state.update((f.buffer, f.inside, f.preface))
        if shown:
            yield pd.DataFrame({"stream_id": [key[0]], "shown": [shown]})

    def close(self) -> None:
        pass


def filter_stream(tokens: DataFrame) -> DataFrame:
    """(stream_id, shown) increments of a streaming table of (stream_id, seq, token)."""
    return tokens.groupBy("stream_id").transformWithStateInPandas(ThinkProcessor(), f"stream_id {tokens.schema['stream_id'].dataType.simpleString()}, shown string", "Append", "None")
