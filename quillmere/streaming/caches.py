"""Caches with a time to live and a size, as state of a stream or replayed over a table.

A request looks its key up; a miss fills the entry. Each scope (a user, a folder)
has a cache of its own: its entries are MapState of the stream, timers drop what has
expired, and the least recently used entry goes when a cache is full, so the state
of a scope never holds more than ``size`` entries. A replay sorts the requests of
all scopes and runs through them in Arrow batches; no scope is held in memory.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle


@dataclass(frozen=True)
class Rules:
    """How long entries live (seconds), how many there are (None: any number), and whether one lives through its last second."""

    ttl: float
    size: int | None = None
    inclusive: bool = False
    #: Whether a hit makes an entry the youngest in the order of eviction.
    touch: bool = True


#: Results of a search, by folder; answers and vectors of a chain; results in a chain; prompts.
RETRIEVAL = Rules(600, 1000, inclusive=True)
CHAIN = Rules(3600)
CHAIN_RETRIEVAL = Rules(1800)
PROMPTS = Rules(3600, 100, inclusive=True)


def retrieval_key(question: Column, folder: Column) -> Column:
    """Key of a search's results: its question within its folder, case and outer white space aside."""
    text = F.coalesce(F.concat(folder.cast("string"), F.lit(":"), question), question)
    return F.concat(F.lit("ret:"), F.sha2(F.trim(F.lower(text)), 256))


def prompt_key(kind: Column, folder: Column) -> Column:
    """Key of a prompt: sixteen digits of its kind's and folder's digest."""
    return F.substring(F.md5(F.concat_ws(":", kind, folder.cast("string")).cast("binary")), 1, 16)


class Cache:
    """Entries of one scope in the order of eviction: key to the time it was filled."""

    def __init__(self, rules: Rules, entries: OrderedDict[str, float] | None = None):
        self.rules, self.entries = rules, entries if entries is not None else OrderedDict()

    def alive(self, filled: float, now: float) -> bool:
        age = now - filled
        return age <= self.rules.ttl if self.rules.inclusive else age < self.rules.ttl

    def ask(self, key: str, now: float) -> bool:
        """Whether ``key`` hits; a miss fills it, which drops the next entry to go if the cache is full."""
        filled = self.entries.get(key)
        if filled is not None and self.alive(filled, now):
            if self.rules.touch:
                self.entries.move_to_end(key)
            return True
        self.entries.pop(key, None)
        if self.rules.size is not None and len(self.entries) >= self.rules.size:
            self.entries.popitem(last=False)
        self.entries[key] = now
        return False

    def expire(self, now: float) -> None:
        for key in [k for k, filled in self.entries.items() if not self.alive(filled, now)]:
            del self.entries[key]


def replayed(requests: DataFrame, rules: Rules, scope: str, key: str, time: str, ident: str) -> DataFrame:
    """``requests`` with ``hit``; ``time`` in seconds, equal times in order of ``ident``, which tells requests apart.

    Requests without a scope share one cache; those without a time or key come
    first, null counting as time 0 and as a key of its own. A scope's requests are
    one task's, in order, as they depend on one another.
    """
    from itertools import groupby

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache, last = Cache(rules), object()
        for frame in frames:
            hits = []
            scopes = [None if pd.isna(s) else s for s in frame[scope]]
            rows = zip(scopes, frame[key], frame[time], strict=True)
            for own, group in groupby(rows, lambda r: r[0]):
                if own != last:
                    cache, last = Cache(rules), own
                hits += [cache.ask(k, 0.0 if pd.isna(t) else float(t)) for _, k, t in group]
            yield frame.assign(hit=hits)

    dealt = requests.repartition(scope).sortWithinPartitions(F.col(scope).asc_nulls_first(), F.col(time).asc_nulls_first(), ident)
    return dealt.mapInPandas(run, requests.withColumn("hit", F.lit(True)).schema)


class CacheProcessor(StatefulProcessor):
    """The same cache as state: entries, their order, and timers at the end of their lives."""

    def __init__(self, rules: Rules, scope: str, key: str, time: str, ident: str):
        self.rules, self.names = rules, (scope, key, time, ident)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entries = handle.getMapState("entries", "key string", "filled double, turn long")
        self.turn = handle.getValueState("turn", "turn long")

    def _loaded(self) -> tuple[Cache, dict[str, tuple[float, int]]]:
        stored = {k[0]: (v[0], v[1]) for k, v in self.entries.iterator()}
        ordered = OrderedDict((k, filled) for k, (filled, _) in sorted(stored.items(), key=lambda x: x[1][1]))
        return Cache(self.rules, ordered), stored

    def _store(self, cache: Cache, stored: dict[str, tuple[float, int]]) -> None:
        """Write what has changed: entries that went, new ones, and the order."""
        for k in stored.keys() - cache.entries.keys():
            self.entries.removeKey((k,))
        turn = self.turn.get()[0] if self.turn.exists() else 0
        before = [k for k, _ in sorted(stored.items(), key=lambda x: x[1][1]) if k in cache.entries]
        same = 0
        for a, b in zip(before, cache.entries, strict=False):
            if a != b or stored[a][0] != cache.entries[b]:
                break
            same += 1
        for k in [*cache.entries][same:]:
            turn += 1
            self.entries.updateValue((k,), (cache.entries[k], turn))
        self.turn.update((turn,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        scope, name, time, ident = self.names
        frame = pd.concat(list(rows)).sort_values([time, ident], kind="stable")
        cache, stored = self._loaded()
        hits = []
        for k, t in zip(frame[name], frame[time], strict=True):
            hits.append(cache.ask(k, float(t)))
            if not hits[-1]:
                self.handle.registerTimer(int((float(t) + self.rules.ttl) * 1000) + 1)
        self._store(cache, stored)
        yield pd.DataFrame({scope: frame[scope].to_numpy(), ident: frame[ident].to_numpy(), "hit": hits})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        cache, stored = self._loaded()
        cache.expire(expiredTimerInfo.getExpiryTimeInMs() / 1000)
        self._store(cache, stored)
        yield pd.DataFrame({self.names[0]: [], self.names[3]: [], "hit": []})

    def close(self) -> None:
        pass


def cached_stream(requests: DataFrame, rules: Rules, scope: str, key: str, time: str, ident: str, event_time: str) -> DataFrame:
    """(scope, ident, hit) of a stream with a watermark on ``event_time``, the timestamp of ``time``.

    Requests of one trigger are taken in order of time; what comes in a later
    trigger comes later. Timers drop entries once the watermark is past their lives.
    """
    kinds = {c: requests.schema[c].dataType.simpleString() for c in (scope, ident)}
    schema = f"{scope} {kinds[scope]}, {ident} {kinds[ident]}, hit boolean"
    return requests.select(scope, key, time, ident, event_time).groupBy(scope).transformWithStateInPandas(CacheProcessor(rules, scope, key, time, ident), schema, "Append", "EventTime")
