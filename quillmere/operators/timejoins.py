"""Joins along an order: the row before, the last row as of a time, points inside intervals.

A key's rows may be most of the table, and an order may have no key at all, so rows
are dealt out by ranges of (key, order), not by key: inside a range a window finds
what precedes, and what a range takes over from the ranges before it comes from one
row for each range and key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .graph import written

#: Points that one part of a (key, bin) holds before it is split.
PART_ROWS = 100_000


def _ranged(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``rows`` with ``range_``, rising along (keys, order); durable, so that it stays the same."""
    return written(rows.repartitionByRange(*keys, *order).withColumn("range_", F.spark_partition_id()))


def _with_last(ranged: DataFrame, keys: list[str], order: list[str], value: str, within: tuple[int, int], known: Column) -> DataFrame:
    """``value`` becomes its last one (where ``known``) up to ``within`` rows from the own, across ranges."""
    place = Window.partitionBy("range_", *keys).orderBy(*order)
    held = F.when(known, F.struct(F.col(value).alias("v")))
    inner = F.last(held, ignorenulls=True).over(place.rowsBetween(*within))
    ends = ranged.groupBy(*keys, "range_").agg(F.max_by(held, F.when(known, F.struct(*order))).alias("last_"))
    before = F.last("last_", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("range_").rowsBetween(Window.unboundedPreceding, -1))
    taken = ends.select(*[F.col(k).alias(f"{k}_of") for k in keys], F.col("range_").alias("range_of"), before.alias("carried_"))
    same = [ranged[k].eqNullSafe(F.col(f"{k}_of")) for k in keys]
    own = ranged.withColumn("inner_", inner).join(taken, [F.col("range_") == F.col("range_of"), *[F.col(k).eqNullSafe(F.col(f"{k}_of")) for k in keys]] if same else F.col("range_") == F.col("range_of"), "left")
    return own.withColumn(value, F.coalesce("inner_", "carried_")["v"]).select(*ranged.columns)


def previous_rows(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``rows`` with ``before``, the struct of the row before it in its key's order (null for the first); no keys: in the whole table's.

    ``order`` must end in a column that tells rows apart. Nulls come first.
    """
    if keys:
        wide = rows.withColumn("before", F.struct(*rows.columns))
        return _with_last(_ranged(wide, keys, order), keys, order, "before", (Window.unboundedPreceding, -1), F.lit(True))
    one = rows.withColumn("all_", F.lit(0)).withColumn("before", F.struct(*rows.columns))
    return _with_last(_ranged(one, ["all_"], order), ["all_"], order, "before", (Window.unboundedPreceding, -1), F.lit(True)).drop("all_")


def as_of(left: DataFrame, right: DataFrame, key: str, time: str, ident: str, strict: bool = False) -> DataFrame:
    """``left`` with ``matched``, the struct of the last row of ``right`` with the same key at or before its time (null: none).

    Both have ``key`` and ``time`` (of one type) and ``ident``; rows of ``right`` at
    one time are taken in order of ``ident``. ``strict`` leaves out equal times. A
    null time of a left row matches nothing; right rows without a time are left
    out; null keys match each other. Repeated left rows are matched each.
    """
    rows = right.where(F.col(time).isNotNull()).select(key, time, F.lit(1 if strict else 0).alias("side_"), F.col(ident).cast("string").alias("tie_"), F.struct(*right.columns).alias("matched"), F.lit(None).cast(left.select(F.struct(*left.columns).alias("s")).schema["s"].dataType).alias("own_"))
    asked = left.where(F.col(time).isNotNull()).select(key, time, F.lit(0 if strict else 1).alias("side_"), F.col(ident).cast("string").alias("tie_"), F.lit(None).cast(rows.schema["matched"].dataType).alias("matched"), F.struct(*left.columns).alias("own_"))
    order = [time, "side_", "tie_"]
    # Ties of right rows are in order of the identifier itself, which a string would not keep.
    rows = rows.withColumn("tie_", F.lpad(F.col("tie_"), 40, "0"))
    found = _with_last(_ranged(rows.unionByName(asked), [key], order), [key], order, "matched", (Window.unboundedPreceding, 0), F.col("matched").isNotNull())
    kept = found.where(F.col("own_").isNotNull()).select("own_.*", "matched")
    return kept.unionByName(left.where(F.col(time).isNull()).withColumn("matched", F.lit(None).cast(kept.schema["matched"].dataType)))


def points_in_intervals(intervals: DataFrame, points: DataFrame, key: str, start: str, end: str, time: str, width: float, part_rows: int = PART_ROWS) -> DataFrame:
    """(columns of ``intervals``, ``point`` struct) of every point of the same key with start <= time <= end.

    Times are numbers. Time is cut into bins of ``width``; a point lies in one bin
    and an interval meets all bins it touches, so ``width`` should be about the
    usual length. A bin of a key with more than ``part_rows`` points is dealt into
    parts, and its intervals meet every part, so no task holds a hot key. Nulls
    match nothing; the result is complete whatever the width.
    """
    bin_of = lambda c: F.floor(F.col(c) / F.lit(width)).cast("long")
    held = points.where(F.col(time).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("key_"), bin_of(time).alias("bin_"), F.col(time).alias("time_"), F.struct(*points.columns).alias("point"))
    parts = held.groupBy("key_", "bin_").agg(F.ceil(F.count(F.lit(1)) / F.lit(part_rows)).cast("int").alias("parts_"))
    crowded = F.broadcast(written(parts.where("parts_ > 1")))  # one row for every ``part_rows`` points at most
    dealt = held.join(crowded, ["key_", "bin_"], "left").withColumn("part_", F.pmod(F.xxhash64("point"), F.coalesce("parts_", F.lit(1))).cast("int")).drop("parts_")
    asked = intervals.where(F.col(start) <= F.col(end)).select(F.struct(*intervals.columns).alias("own_"), F.col(key).alias("key_"), F.col(start).alias("start_"), F.col(end).alias("end_"), F.explode(F.sequence(bin_of(start), bin_of(end))).alias("bin_"))
    asked = asked.join(crowded, ["key_", "bin_"], "left").withColumn("part_", F.explode(F.sequence(F.lit(0), F.coalesce("parts_", F.lit(1)) - 1))).drop("parts_")
    return asked.join(dealt, ["key_", "bin_", "part_"]).where("start_ <= time_ and time_ <= end_").select("own_.*", "point")


def totals_in_intervals(intervals: DataFrame, points: DataFrame, key: str, start: str, end: str, time: str, ident: str, width: float, part_rows: int = PART_ROWS) -> DataFrame:
    """(key, start, end, n, last) of every distinct interval that holds points: their number and their greatest ``ident``, a long.

    The same bins and parts as in ``points_in_intervals``, but intervals that are
    equal are asked once, and inside a part the points are sorted: a count is the
    distance of two places, a maximum that of two overlapping runs of a power of two.
    So the work grows with the rows, not with the pairs.
    """
    bin_of = lambda c: F.floor(F.col(c) / F.lit(width)).cast("long")
    held = points.where(F.col(time).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("key_"), bin_of(time).alias("bin_"), F.col(time).alias("start_"), F.col(ident).alias("ident_"))
    parts = held.groupBy("key_", "bin_").agg(F.ceil(F.count(F.lit(1)) / F.lit(part_rows)).cast("int").alias("parts_"))
    crowded = F.broadcast(written(parts.where("parts_ > 1")))  # one row for every ``part_rows`` points at most
    dealt = held.join(crowded, ["key_", "bin_"], "left").withColumn("part_", F.pmod(F.xxhash64("start_", "ident_"), F.coalesce("parts_", F.lit(1))).cast("int")).drop("parts_")
    asked = intervals.where((F.col(start) <= F.col(end)) & F.col(key).isNotNull()).select(F.col(key).alias("key_"), F.col(start).alias("start_"), F.col(end).alias("end_")).distinct()
    asked = asked.withColumn("bin_", F.explode(F.sequence(bin_of("start_"), bin_of("end_")))).join(crowded, ["key_", "bin_"], "left")
    asked = asked.withColumn("part_", F.explode(F.sequence(F.lit(0), F.coalesce("parts_", F.lit(1)) - 1))).drop("parts_")
    kinds = [asked.schema[c].dataType for c in ("key_", "start_")]
    name, at = map(to_arrow_type, kinds)

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches)
        is_point = table.column("end_").is_null().to_numpy()
        low, high = table.filter(pa.array(~is_point)), table.filter(pa.array(is_point))
        if not low.num_rows or not high.num_rows:
            return
        times, ids = high.column("start_").to_numpy(), high.column("ident_").fill_null(np.iinfo(np.int64).min).to_numpy()
        order = np.argsort(times, kind="stable")
        times, runs = times[order], [ids[order]]
        while 2 ** len(runs) <= len(times):
            half = 2 ** (len(runs) - 1)
            runs.append(np.maximum(runs[-1][:-half], runs[-1][half:]))
        first, last = np.searchsorted(times, low.column("start_").to_numpy(), "left"), np.searchsorted(times, low.column("end_").to_numpy(), "right")
        some = np.flatnonzero(last > first)
        first, last = first[some], last[some]
        level = np.frexp((last - first).astype(float))[1] - 1
        most = np.empty(len(some), np.int64)
        for k in np.unique(level):
            of = level == k
            most[of] = np.maximum(runs[k][first[of]], runs[k][last[of] - 2**k])
        found = low.take(pa.array(some)).combine_chunks()
        greatest = pa.array(most, pa.int64(), mask=most == np.iinfo(np.int64).min)
        columns = [found.column("key_").combine_chunks(), found.column("start_").combine_chunks(), found.column("end_").combine_chunks(), pa.array(last - first, pa.int64()), greatest]
        yield pa.RecordBatch.from_arrays([columns[0].cast(name), columns[1].cast(at), columns[2].cast(at), *columns[3:]], ["key_", "start_", "end_", "n", "last"])

    rows = asked.unionByName(dealt, allowMissingColumns=True)
    out = rows.groupBy("key_", "bin_", "part_").applyInArrow(within, f"key_ {kinds[0].simpleString()}, start_ {kinds[1].simpleString()}, end_ {kinds[1].simpleString()}, n long, last long")
    totals = out.groupBy("key_", "start_", "end_").agg(F.sum("n").alias("n"), F.max("last").alias("last"))
    return totals.select(F.col("key_").alias(key), F.col("start_").alias(start), F.col("end_").alias(end), "n", "last")
