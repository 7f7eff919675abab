"""Shared plumbing of the training-data operators: scratch tables, Arrow maps, keys."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: One word of the contracts: anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows in one Arrow batch. Documents are a few KB, so a batch stays within a few MB.
BATCH_ROWS = 512


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it.

    Where ``spark.checkpoint.dir`` is unset, a local temporary folder is chosen, once
    per application, if the master is local (tests, a laptop); a cluster must name one.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = f"file://{tempfile.mkdtemp(prefix='quillmere-')}"
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage durably."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quillmere/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._quillmere_path = path
    return back


def discard(df: DataFrame) -> None:
    """Delete a table that ``materialise`` wrote and nothing needs any more."""
    path = getattr(df, "_quillmere_path", None)
    if path:
        spark = df.sparkSession
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of steps that are written already."""
    spark.sparkContext._jvm.System.gc()


def arrow_map(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` with batches small enough for long documents."""
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df.mapInArrow(function, schema)


def type_of(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def id_remainder(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)


def fresh_name(df: DataFrame, wanted: str) -> str:
    """A column name that does not clash with one of ``df``."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


#: A key is hot if it has more than this share of a shuffle partition's fair share of rows.
HOT_SHARE = 0.25


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def hot_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The keys with more than a quarter of a shuffle partition's fair share of ``rows``.

    There are fewer than four times as many of them as shuffle partitions, so the
    table, and what has one row for each of them, may be broadcast at any size.
    """
    most = rows.count() * HOT_SHARE / partitions(rows.sparkSession)
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("held")).where((F.col("held") > F.lit(most)) & (F.col("held") > 1)).select(*keys)


def spread_join(rows: DataFrame, table: DataFrame, keys: list[str], hot: DataFrame, values: str) -> DataFrame:
    """``rows`` with ``values`` of their key's row in ``table`` (null if it has none), whatever share of them a key has.

    ``table`` has one row for each key (no nulls), ``hot`` the hot keys of ``rows``.
    Hot keys' values are broadcast; all other rows are joined by key, the hot ones
    being spread over keys that match nothing.
    """
    spread, early, late = (fresh_name(rows, n) for n in ("spread", "early", "late"))
    of_hot = table.join(F.broadcast(hot), keys, "left_semi").select(*[F.col(k).alias(f"{k}_hot") for k in keys], F.struct(F.col(values)).alias(early))
    of_all = table.select(*[F.col(k).alias(f"{k}_all") for k in keys], F.lit(0).cast("long").alias(f"{spread}_all"), F.col(values).alias(late))
    found = rows.join(F.broadcast(of_hot), [F.col(k) == F.col(f"{k}_hot") for k in keys], "left").drop(*[f"{k}_hot" for k in keys])
    away = F.when(F.col(early).isNull(), F.lit(0)).otherwise(F.monotonically_increasing_id() + 1).cast("long")
    found = found.withColumn(spread, away)
    joined = found.join(of_all, [*[F.col(k) == F.col(f"{k}_all") for k in keys], F.col(spread) == F.col(f"{spread}_all")], "left")
    value = F.when(F.col(early).isNotNull(), F.col(early)[values]).otherwise(F.col(late))
    return joined.select(*[F.col(f"`{c}`") for c in rows.columns], value.alias(values))
