"""Algebra of ranked lists: (query_id, id, file_key, rank, score), ranks from 1."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RRF_CONSTANT = 60


def _by(*keys: str) -> Window:
    return Window.partitionBy("query_id", *keys)


def renumber(hits: DataFrame, *order: Column | str) -> DataFrame:
    return hits.withColumn("rank", F.row_number().over(_by().orderBy(*order)))


def min_max(hits: DataFrame) -> DataFrame:
    """Scores spread to [0, 1] within a query; equal scores become 0."""
    low, high = F.min("score").over(_by()), F.max("score").over(_by())
    return hits.withColumn("score", (F.col("score") - low) / F.when(high == low, 1.0).otherwise(high - low))


def reciprocal_rank_fusion(lists: list[DataFrame], weights: list[float] | None = None, first_rank: int = 0, constant: int = RRF_CONSTANT, digits: int = 9) -> DataFrame:
    """Fuse lists: sum of weight / (constant + rank), ranks counted from ``first_rank``.

    Ties go to the earlier list, then the better rank there.
    """
    weights = weights or [1.0] * len(lists)
    parts = [h.select("query_id", "id", F.lit(i).alias("list"), "rank", (F.lit(w) / (constant + F.col("rank") - 1 + first_rank)).alias("part")) for i, (h, w) in enumerate(zip(lists, weights, strict=True))]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    fused = both.groupBy("query_id", "id").agg(F.round(F.sum("part"), digits).alias("score"), F.min(F.struct("list", "rank")).alias("first"))
    return renumber(fused, F.col("score").desc(), "first").select("query_id", "id", "rank", "score")


def cap_per_file(hits: DataFrame, per_file: int, target: int) -> DataFrame:
    """The first ``per_file`` of every file in rank order, ``target`` in all."""
    kept = hits.withColumn("turn", F.row_number().over(_by("file_key").orderBy("rank"))).where(F.col("turn") <= per_file).drop("turn")
    return renumber(kept, "rank").where(F.col("rank") <= target)


def overview_cap(hits: DataFrame, most: int, target: int) -> DataFrame:
    """One of every file whatever the target, then more, up to ``most`` a file, while below it."""
    turn = F.row_number().over(_by("file_key").orderBy("rank"))
    kept = hits.withColumn("turn", turn).where(F.col("turn") <= most)
    kept = kept.withColumn("place", F.row_number().over(_by().orderBy(F.col("turn") > 1, "rank")))
    return renumber(kept.where((F.col("turn") == 1) | (F.col("place") <= target)), "place").drop("turn", "place")


def diversify(hits: DataFrame, least: int, total: int) -> DataFrame:
    """Fair slots for each file, the rest filled by rank, in the original order.

    A file's slots are ``least``, or total // files (one at least) if that is less room.
    Files take their slots in order of their key while room is left.
    """
    files = F.size(F.collect_set("file_key").over(_by()))
    turn = F.row_number().over(_by("file_key").orderBy("rank"))
    h = hits.withColumn("slots", F.when(files * least <= total, F.lit(least)).otherwise(F.greatest(F.lit(1), F.floor(F.lit(total) / files)))).withColumn("turn", turn)
    h = h.withColumn("fair", F.col("turn") <= F.col("slots")).withColumn("place", F.row_number().over(_by().orderBy(F.col("fair").desc(), F.when(F.col("fair"), F.col("file_key")), "rank")))
    return renumber(h.where(F.col("place") <= total), "rank").drop("slots", "turn", "fair", "place")


def rebalance(hits: DataFrame, exponent: float = 0.5, per_file: int = 5, digits: int = 9) -> DataFrame:
    """Scores divided by a power of the file's count; the best ``per_file`` of each, by score."""
    count = F.count(F.lit(1)).over(_by("file_key"))
    h = hits.withColumn("score", F.round(F.when(count > 1, F.col("score") / F.pow(count, F.lit(exponent))).otherwise(F.col("score")), digits))
    h = h.withColumn("turn", F.row_number().over(_by("file_key").orderBy(F.col("score").desc(), "rank"))).where(F.col("turn") <= per_file).drop("turn")
    return renumber(h, F.col("score").desc(), "id")


def rebalance_unscored(hits: DataFrame, per_file: int) -> DataFrame:
    """The first ``per_file`` of every file, grouped by file, files by first appearance."""
    h = hits.withColumn("turn", F.row_number().over(_by("file_key").orderBy("rank"))).withColumn("seen", F.min("rank").over(_by("file_key"))).where(F.col("turn") <= per_file)
    return renumber(h, "seen", "turn").drop("turn", "seen")


def diversity_rerank(hits: DataFrame, weight: float = 0.3, digits: int = 9) -> DataFrame:
    """Scores lowered for later rows of often-hit files; the first row of a file counts as place 1."""
    count = F.count(F.lit(1)).over(_by("file_key"))
    place = F.row_number().over(_by("file_key").orderBy("rank"))
    h = hits.withColumn("n", count).withColumn("place", place)
    penalty = (F.col("n") / F.max("n").over(_by())) * (F.col("place") / F.col("n")) * weight
    return renumber(h.withColumn("score", F.round(F.col("score") * (1 - penalty), digits)).drop("n", "place"), F.col("score").desc(), "id")


def interleave(one: DataFrame, two: DataFrame) -> DataFrame:
    """one's first, two's first, one's second, ... then the longer list's tail."""
    both = one.withColumn("side", F.lit(0)).unionByName(two.withColumn("side", F.lit(1)))
    return both.withColumn("rank", F.row_number().over(_by().orderBy("rank", "side"))).drop("side")


def recency_rerank(hits: DataFrame, age_days: Column, weight: float = 0.2, digits: int = 9) -> DataFrame:
    """score * (1 + weight / (days + 1)); an unknown age leaves the score."""
    factor = F.coalesce(1 + weight / (age_days + 1), F.lit(1.0))
    return renumber(hits.withColumn("score", F.round(F.col("score") * factor, digits)), F.col("score").desc(), "id")


def boost(hits: DataFrame, condition: Column, factor: float = 1.3, digits: int = 9) -> DataFrame:
    return renumber(hits.withColumn("score", F.round(F.when(condition, F.col("score") * factor).otherwise(F.col("score")), digits)), F.col("score").desc(), "id")


def threshold_top(hits: DataFrame, least: float, k: int) -> DataFrame:
    """Rows scoring at least ``least``, the first ``k`` of them."""
    return renumber(hits.where(F.col("score") >= least), "rank").where(F.col("rank") <= k)


def keyword_score(question: Column, text: Column, phrase_bonus: float = 0.3) -> Column:
    """Share of the question's distinct words that occur in the text, plus a bonus for the whole phrase (so up to 1.3)."""
    q, t = F.lower(question), F.lower(text)
    words = F.array_distinct(F.filter(F.split(q, r"\s+"), lambda w: w != ""))
    found = F.size(F.filter(words, lambda w: F.contains(t, w)))
    share = F.when(F.size(words) > 0, found / F.size(words)).otherwise(F.lit(0.0))
    return share + F.when(F.contains(t, q), phrase_bonus).otherwise(0.0)


def with_texts(hits: DataFrame, texts: DataFrame) -> DataFrame:
    """``hits`` with the columns of ``texts`` (id, ...). The hits, some for each question, go to the texts; no text is shuffled."""
    return texts.join(F.broadcast(hits), "id")


def first_of(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the first by ``order``."""
    turn = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("turn_", turn).where("turn_ = 1").drop("turn_")
