"""Rate limits and caches replayed over event tables: a fold per key, in event order."""

from __future__ import annotations

from collections import OrderedDict

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def token_bucket(events: DataFrame, key: str, seconds: Column, ident: str, rate: float, capacity: float) -> DataFrame:
    """(key, allowed, refused, left) per key: tokens refill at ``rate`` a second up to ``capacity``, one per event."""
    ordered = F.array_sort(F.collect_list(F.struct(seconds.cast("double").alias("t"), F.col(ident).alias("i"))))
    start = F.struct(F.lit(None).cast("double").alias("t"), F.lit(float(capacity)).alias("have"), F.lit(0).cast("long").alias("allowed"), F.lit(0).cast("long").alias("refused"))

    def step(a: Column, e: Column) -> Column:
        have = F.least(F.lit(float(capacity)), a["have"] + F.coalesce(e["t"] - a["t"], F.lit(0.0)) * rate)
        ok = have >= 1
        return F.struct(e["t"].alias("t"), F.when(ok, have - 1).otherwise(have).alias("have"), (a["allowed"] + ok.cast("long")).alias("allowed"), (a["refused"] + (~ok).cast("long")).alias("refused"))

    folded = events.groupBy(key).agg(F.aggregate(ordered, start, step).alias("b"))
    return folded.select(key, F.col("b.allowed").alias("allowed"), F.col("b.refused").alias("refused"), F.round("b.have", 6).alias("left"))


def adaptive_rates(outcomes: list[str], rate: float = 10.0, low: float = 1.0, high: float = 50.0) -> list[float]:
    """The rate after each outcome: up a tenth after ten successes, halved on a limit or three errors."""
    out, good, bad = [], 0, 0
    for o in outcomes:
        if o == "ok":
            good, bad = good + 1, 0
            if good == 10:
                rate, good = min(high, rate * 1.1), 0
        else:
            good, bad = 0, bad + 1
            if o == "limited" or bad >= 3:
                rate, bad = max(low, rate * 0.5), 0
        out.append(rate)
    return out


def lru_replay(keys: list[tuple[float, str]], size: int, ttl: float) -> list[bool]:
    """Whether each (time, key) hits a cache of ``size`` entries that live ``ttl`` seconds."""
    cache: OrderedDict[str, float] = OrderedDict()
    out = []
    for t, k in keys:
        hit = k in cache and t - cache[k] < ttl
        out.append(hit)
        if hit:
            cache.move_to_end(k)
            continue
        cache.pop(k, None)
        cache[k] = t
        if len(cache) > size:
            cache.popitem(last=False)
    return out


def per_key(events: DataFrame, key: str, fold, schema: str) -> DataFrame:
    """Apply a fold of sorted pandas groups; a key's events fit one task."""

    def one(group: pd.DataFrame) -> pd.DataFrame:
        return fold(group.sort_values(["ts", "event_id"]))

    return events.groupBy(key).applyInPandas(one, schema)
