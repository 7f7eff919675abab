"""Mixing sources to target weights by capped water-filling, in Spark SQL alone.

Sources may be many (hosts) and one may hold most of the rows, so nothing here
puts all sources, or all documents of one, into one task: sources are numbered by
ranges, the fill is found by aggregates, and where a source's last, partial
repetition ends is searched for digit by digit of the seeded order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, discard, fresh_name, hot_keys, materialise, spread_join

#: The seeded order of documents has this many bits; a step of the search looks at so many of them.
ORDER_BITS, STEP_BITS = 60, 10


def _in_order(sizes: DataFrame) -> DataFrame:
    """``sizes`` with ``turn``, the number of the source in code-point order, null last, from 0."""
    by = F.col("source").asc_nulls_last()
    ranged = materialise(sizes.repartitionByRange(by).withColumn("range", F.spark_partition_id()), "ranged")
    counts = ranged.groupBy("range").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col("range").alias("of_range"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    place = F.row_number().over(Window.partitionBy("range").orderBy(by)) - 1
    return ranged.join(starts, F.col("range") == F.col("of_range")).select("source", "source_size", (F.col("start") + place).alias("turn"))


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, max_epochs: float) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row per source.

    Sources in code-point order, null last, take ``weights`` in turn. All targets
    together are ``share`` of all sizes, dealt by weight. Sources that this would
    fill beyond ``max_epochs`` times their size are clamped there, and what they
    leave is dealt to the others by weight, until none is above.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("turn") % len(weights) + 1).cast("int"))
    weighed = materialise(_in_order(sizes).select("source", "source_size", weight.alias("w"), (F.col("source_size") * F.lit(float(max_epochs))).alias("cap")), "weighed")
    everything = weighed.agg(F.sum("source_size"), F.sum("w")).first()
    to_deal, fill, before = float(everything[0] or 0) * share, 0.0, -1
    if everything[1]:
        fill = to_deal / everything[1]
    while everything[1]:
        clamped = F.col("cap") <= F.col("w") * F.lit(fill)
        count, caps, open_weight = weighed.agg(F.count_if(clamped), F.sum(F.when(clamped, F.col("cap"))), F.sum(F.when(~clamped, F.col("w")))).first()
        if count == before or not open_weight:
            break
        before, fill = count, (to_deal - (caps or 0.0)) / open_weight
    return weighed.select("source", "source_size", F.least("cap", F.col("w") * F.lit(fill)).alias("target"))


def _keys(source: Column) -> tuple[Column, Column]:
    """A source, null or not, as two keys that plain equality can join."""
    return F.coalesce(source.cast("string"), F.lit("")), source.isNull()


def _cuts(rows: DataFrame, rests: DataFrame, hot: DataFrame) -> DataFrame:
    """(named, none, cut, at): where the taken part of each source ends in the order.

    ``rows`` (named, none, order, size) are all documents, ``rests`` (named, none,
    room) the words to take of each source, ``hot`` the sources that hold much. Documents before ``cut`` are taken
    wholly, those at it with ``at`` words each, later ones not. Sources that are
    taken wholly have no row. Each step sums the words by the next bits of the
    order and goes on inside the part that holds the end.
    """
    keys, cuts = ["named", "none"], materialise(rests.withColumn("prefix", F.lit(0).cast("long")), "cuts")
    shift = ORDER_BITS
    while shift > 0:
        ends = cuts.select(*keys, F.struct("room", "prefix").alias("end"))
        inside = spread_join(rows, ends, keys, hot, "end").where(F.shiftright("order", shift) == F.col("end.prefix")).select(*keys, "end.room", "size", "order")
        shift -= STEP_BITS
        parts = inside.groupBy(*keys, "room", F.shiftright("order", shift).alias("prefix")).agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n"), F.min("order").alias("low"), F.max("order").alias("high"))
        ahead = F.coalesce(F.sum("words").over(Window.partitionBy(*keys).orderBy("prefix").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        ends = parts.withColumn("ahead", ahead).where("ahead <= room and room < ahead + words")
        before, cuts = cuts, materialise(ends.select(*keys, (F.col("room") - F.col("ahead")).alias("room"), "prefix", "n", "low", "high"), "cuts")
        discard(before)
        if not cuts.where("low <> high").limit(1).count():
            break
    return cuts.select(*keys, F.col("low").alias("cut"), F.floor(F.col("room") / F.col("n")).alias("at"))


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = (5, 2, 1),
    share: float = 1.5,
    max_epochs: float = 2.0,
    seed: int = 11,
) -> DataFrame:
    """``docs`` with size, source_size, target and taken (names are lengthened if they clash).

    A document's size is its number of words (null text: none). Every document is
    taken wholly as often as its source's target holds the source; what remains
    is taken in a seeded order of documents, the last of them in part, so that a
    source's taken words differ from its target by less than one word. A null
    source is a source of its own, last. Rows of equal id and text share one place
    in the order; if the end falls on such rows, each gets the same words, and up to
    one word fewer than there are such rows is left over. An empty table gives no
    rows.
    """
    size, source_size, target, taken = (fresh_name(docs, n) for n in ("size", "source_size", "target", "taken"))
    order, named, none, of_source = (fresh_name(docs, f"mix_{n}") for n in ("order", "named", "none", "of"))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.md5(text.cast("binary"))).cast("binary"))
    is_named, is_none = _keys(F.col(source_col))
    words = F.regexp_count(text, F.lit(WORD + "+")).cast("long")
    sized = docs.withColumns({size: words, order: F.conv(F.substring(digest, 1, ORDER_BITS // 4), 16, 10).cast("long"), named: is_named, none: is_none})
    rows = materialise(sized.select(F.col(source_col).alias("source"), F.col(named).alias("named"), F.col(none).alias("none"), F.col(order).alias("order"), F.col(size).alias("size")), "sizes")
    plan = source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, max_epochs)
    plan = plan.withColumn("times", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    key, is_null = _keys(F.col("source"))
    plan = materialise(plan.select(key.alias("named"), is_null.alias("none"), "source_size", "target", "times", (F.floor(F.col("target") + F.lit(0.5)).cast("long") - F.col("times") * F.col("source_size")).alias("room")), "plan")
    hot = materialise(hot_keys(rows, ["named", "none"]), "hot")
    cuts = _cuts(rows, plan.select("named", "none", "room"), hot)
    known = plan.join(cuts, ["named", "none"], "left").select(F.col("named").alias(named), F.col("none").alias(none), F.struct("source_size", "target", "times", "cut", "at").alias(of_source))
    known = materialise(known, "known")
    discard(rows)
    joined = spread_join(sized, known, [named, none], hot.withColumnsRenamed({"named": named, "none": none}), of_source)
    of = lambda name: F.col(of_source)[name]
    extra = F.when(of("cut").isNull() | (F.col(order) < of("cut")), F.col(size)).when(F.col(order) == of("cut"), F.least(F.col(size), of("at"))).otherwise(F.lit(0))
    result = (of("times") * F.col(size) + extra).cast("long")
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns], F.col(size), of("source_size").alias(source_size), of("target").alias(target), result.alias(taken))
