"""Column expressions over long arrays and texts that take about linear time.

Spark's array and string functions copy their input: appending to an array inside
``aggregate`` costs its length each time, ``substring`` walks from the text's
start. Working chunk by chunk keeps such costs to the chunk.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements in a chunk of an array, code points in a chunk of a text.
CHUNK, TEXT_CHUNK = 256, 1 << 16


def bind(value: Column, function: Callable[[Column], Column]) -> Column:
    """``function`` of a value that is evaluated once, however often the function uses it."""
    return F.transform(F.array(value), function)[0]


def chunks(values: Column, size: int = CHUNK) -> Column:
    """An array, not null, in pieces of ``size`` elements; an empty one has none."""
    count = F.ceil(F.size(values) / size).cast("int")
    return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.slice(values, i * size + 1, F.lit(size)))).otherwise(F.array_repeat(values, 0))


def running(values: Column, join: Callable[[Column, Column], Column], start: Column) -> Column:
    """For each element: the elements before it folded by ``join`` from ``start`` (associative, ``start`` neutral)."""
    scan = lambda xs: F.aggregate(
        xs,
        F.struct(start.alias("at"), F.array_repeat(start, 0).alias("out")),
        lambda a, x: F.struct(join(a["at"], x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")),
    )
    within = lambda parts: F.zip_with(parts, scan(F.transform(parts, lambda p: p["at"]))["out"], lambda p, before: F.transform(p["out"], lambda x: join(before, x)))
    return F.flatten(bind(F.transform(chunks(values), scan), within))


def fold(values: Column, state: Column, step: Callable[[Column, Column], Column], kind: str) -> Column:
    """The array that ``step`` builds: it maps (state, element) to struct<state, out array of ``kind``>."""
    some = lambda at, xs: F.aggregate(
        xs,
        F.struct(at.alias("state"), F.expr(f"cast(array() as array<{kind}>)").alias("out")),
        lambda a, x: bind(step(a["state"], x), lambda made: F.struct(made["state"].alias("state"), F.concat(a["out"], made["out"]).alias("out"))),
    )
    whole = F.aggregate(
        chunks(values),
        F.struct(state.alias("state"), F.expr(f"cast(array() as array<array<{kind}>>)").alias("out")),
        lambda a, xs: bind(some(a["state"], xs), lambda made: F.struct(made["state"].alias("state"), F.concat(a["out"], F.array(made["out"])).alias("out"))),
    )
    return F.flatten(whole["out"])


def cut(text: Column, spans: Column) -> Column:
    """The pieces [start, end) of ``text``, in code points, for an array of structs of ``start`` and ``end``."""
    count = F.greatest(F.lit(1), F.ceil(F.length(text) / TEXT_CHUNK)).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring(text, i * TEXT_CHUNK + 1, F.lit(TEXT_CHUNK)))

    def piece(parts: Column, s: Column) -> Column:
        first = F.floor(s["start"] / TEXT_CHUNK).cast("int")
        last = F.greatest(first, F.floor((s["end"] - 1) / TEXT_CHUNK).cast("int"))
        return F.substring(F.array_join(F.slice(parts, first + 1, last - first + 1), ""), s["start"] - first * TEXT_CHUNK + 1, s["end"] - s["start"])

    return bind(pieces, lambda parts: F.transform(spans, lambda s: piece(parts, s)))
