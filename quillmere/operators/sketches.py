"""Stored sketches that merge: distinct counts and quantiles of any grouping from one pass over the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Buckets of the distinct sketch, as a power of two: a standard error of about 1.3 %.
BUCKETS = 14


def sketched(rows: DataFrame, keys: list[str], value: Column, number: Column) -> DataFrame:
    """(keys, n, distinct_sketch, quantile_sketch): a row for every finest group, to be written and added to.

    Null values are not counted by the sketches; ``n`` counts rows.
    """
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.hll_sketch_agg(value, BUCKETS).alias("distinct_sketch"), F.kll_sketch_agg_bigint(number.cast("long")).alias("quantile_sketch"))


def rolled_up(sketches: DataFrame, keys: list[str], quantiles: list[float]) -> DataFrame:
    """(keys, grouping, n, distinct, quantiles) for every subset of ``keys``, from the sketches alone.

    ``grouping`` tells a key that is null in the data from one summed over. Without rows
    with a number the quantiles are null.
    """
    merged = sketches.cube(*keys).agg(F.grouping_id().alias("grouping"), F.sum("n").alias("n"), F.hll_union_agg("distinct_sketch").alias("d"), F.kll_merge_agg_bigint("quantile_sketch").alias("q"))
    at = F.array(*[F.kll_sketch_get_quantile_bigint("q", F.lit(x)) for x in quantiles])
    return merged.select(*keys, "grouping", "n", F.hll_sketch_estimate("d").alias("distinct"), F.when(F.kll_sketch_get_n_bigint("q") > 0, at).alias("quantiles"))
