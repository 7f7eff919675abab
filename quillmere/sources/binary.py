"""Files of a folder as rows, and text decoding with fallbacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Encodings tried after UTF-8.
FALLBACKS = ("ISO-8859-1",)


def list_files(spark: SparkSession, folder: str, recursive: bool = False, pattern: str | None = None) -> DataFrame:
    """(path, modificationTime, length, content) of a folder's files."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", recursive)
    return (reader.option("pathGlobFilter", pattern) if pattern else reader).load(folder)


def decoded(content: Column) -> Column:
    """Text of bytes: UTF-8, without a byte-order mark, else Latin-1."""
    utf8 = F.regexp_replace(F.try_validate_utf8(content.cast("string")), "^﻿", "")
    return F.coalesce(utf8, *[F.decode(content, e) for e in FALLBACKS])
