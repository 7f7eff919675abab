"""Exact copies of texts, by skew-safe combining.

Texts that differ in white space alone are copies. Copies are combined inside each
task, then inside the salted parts of a digest's group, then across the salts; each
time the whole contents are grouping keys, so a digest only brings rows together
and never decides. Digests that hold so many rows that one task would feel it are
few (see ``hot_keys``), and only they are salted and only theirs travel twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, hot_keys, materialise, partitions, spread_join

#: The characters that do not count.
WHITE = "\x20\x09\x0a\x0b\x0c\x0d"


def content(text: Column) -> Column:
    """What texts are compared by: without white space, null as empty."""
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), WHITE, "")


def mark_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_chars: int = 64) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256), one row per document.

    Of equal texts the row with the most code points stays, then that of the least
    id, null ids last. ``text_sha256`` is of the text without white space. Null and
    empty texts, and texts of white space alone, are one group. Rows that repeat
    another's id and text are marked alike, all kept or none; ``group_size`` counts
    each of them. An empty table gives no rows; other columns are not touched.

    ``digest_chars`` leading hex digits of the SHA-256 bring rows together. If
    different contents share them, their rows are joined by content.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    whole = F.sha2(content(F.col(text_col)), 256)
    slim = materialise(docs.select(F.col(id_col).alias("id"), F.char_length(text).alias("chars"), whole.alias("sha"), F.substring(whole, 1, digest_chars).alias("digest")), "digests")
    hot = materialise(hot_keys(slim, ["digest"]), "hot")
    known = F.broadcast(hot.withColumn("hot", F.lit(True)))

    best = F.min(F.struct((-F.col("chars")).alias("less"), F.col("id").isNull().alias("none"), F.col("id").alias("id"))).alias("best")
    rows = docs.select(F.col(id_col).alias("id"), F.char_length(text).alias("chars"), content(F.col(text_col)).alias("content"), F.substring(whole, 1, digest_chars).alias("digest"))
    salt = F.when(F.col("hot"), F.spark_partition_id() % partitions(docs.sparkSession)).otherwise(F.lit(0))
    local = rows.join(known, "digest", "left").withColumn("salt", salt)
    # Partial aggregation combines in the task, the exchange brings the salted groups together.
    merged = local.groupBy("digest", "salt", "content", "hot").agg(F.count(F.lit(1)).alias("n"), best)
    salted = materialise(merged.select("digest", "hot", F.when(F.col("hot"), F.col("content")).alias("content"), "n", "best"), "salted")
    winners = salted.where("hot").groupBy("digest", "content").agg(F.sum("n").alias("n"), F.min("best").alias("best"))
    classes = salted.where("hot is null").select("digest", "n", "best").unionByName(winners.select("digest", "n", "best"))
    groups = classes.groupBy("digest").agg(F.count(F.lit(1)).alias("contents"), F.min("best").alias("best"), F.sum("n").alias("n"))
    groups = materialise(groups, "groups")
    discard(salted)

    plain = groups.where("contents = 1").select("digest", F.struct("best", "n").alias("group"))
    found = spread_join(slim, plain, ["digest"], hot, "group").where("group is not null").select("digest", "id", "chars", "sha", "group.best", "group.n")
    clashing = groups.where("contents > 1").select("digest")
    if clashing.limit(1).count():
        apart = rows.join(clashing, "digest", "left_semi")
        settled = apart.groupBy("digest", "content").agg(F.count(F.lit(1)).alias("n"), best)
        by_content = apart.join(settled, ["digest", "content"]).select("digest", "id", "chars", F.sha2("content", 256).alias("sha"), "best", "n")
        found = found.unionByName(by_content)
    kept = F.col("id").eqNullSafe(F.col("best.id")) & (F.col("chars") == -F.col("best.less"))
    return found.select("id", F.col("best.id").alias("keep_id"), F.col("n").alias("group_size"), kept.alias("kept"), F.col("sha").alias("text_sha256"))
