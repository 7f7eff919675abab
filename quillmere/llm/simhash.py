"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints within ``radius`` bits have a common variant within half the
radius of both. So every distinct fingerprint emits its ball of variants, one
shuffle brings equal variants together, and what meets is verified. A variant's
bucket holds distinct fingerprints only, of which at most a ball's worth exist,
so copies however many never make a large group.

``keep_one_of_similar`` is the near-duplicate filter on shingle sets (``similar``).
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, materialise, type_of
from .components import connected_components

_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.float32)


def majority_bits(hashes: np.ndarray) -> np.ndarray:
    """The 64 bits per column that over half of the 64-bit ``hashes`` (n, columns) have set."""
    n, columns = hashes.shape
    flat = np.ascontiguousarray(hashes, "<u8").view(np.uint8).reshape(n, columns * 8)
    spread = flat.astype(np.int32) + np.arange(columns * 8, dtype=np.int32) * 256
    seen = np.bincount(spread.ravel(), minlength=columns * 8 * 256).reshape(columns * 8, 256)
    ones = seen.astype(np.float32) @ _BYTE_BITS if n < 1 << 24 else seen.astype(np.float64) @ _BYTE_BITS
    return np.packbits((2 * ones > n).astype(np.uint8), axis=1, bitorder="little").reshape(columns, 8).copy().view("<u8")[:, 0]


def text_fingerprint(text: bytes, shingle_words: int, seed: int) -> int:
    """SimHash of one text: XXH64 of its lower-cased word shingles, repeats included."""
    words = text.lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) < shingle_words:
        hashes = [digest(b" ".join(words), seed)]
    else:
        hashes = [digest(b" ".join(s), seed) for s in zip(*(words[k:] for k in range(shingle_words)), strict=False)]
    return int(majority_bits(np.array(hashes, np.uint64)[:, None])[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3, seed: int = 42) -> DataFrame:
    """(id, fp): the 64-bit SimHash of every whole text, as a signed long; no word gives 0."""

    def run(batches):
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            values = np.array([text_fingerprint(t or b"", shingle_words, seed) for t in texts], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))], names=["id", "fp"])

    return arrow_map(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), run, f"id {type_of(docs, id_col)}, fp long")


def ball_masks(bits: int, radius: int) -> list[int]:
    """Every change of at most ``radius`` of ``bits`` bits, as signed 64-bit masks."""
    masks = [sum(1 << b for b in chosen) for r in range(radius + 1) for chosen in combinations(range(bits), r)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def ball_variants(nodes: DataFrame, value: str, bits: int, radius: int) -> DataFrame:
    """``nodes`` with one row for every variant of ``value`` within ``radius // 2`` bits."""
    masks = F.array(*[F.lit(m).cast("long") for m in ball_masks(bits, radius // 2)])
    return nodes.withColumn("variant", F.explode(F.transform(masks, lambda m: F.col(value).bitwiseXOR(m))))


def fingerprint_links(distinct: DataFrame, value: str, bits: int = 64, radius: int = 2) -> DataFrame:
    """(a, b) pairs of distinct fingerprints that connect all that are within ``radius``.

    ``radius`` is even: what shares a variant is then within it, so a bucket's
    members are linked to its least one, which keeps every link's connection.
    """
    if radius % 2:
        raise ValueError("the radius must be even")
    met = ball_variants(distinct.select(F.col(value).alias("a")), "a", bits, radius)
    least = met.withColumn("b", F.min("a").over(Window.partitionBy("variant"))).where("a <> b").select("a", "b").distinct()
    return least.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3, radius: int = 2, seed: int = 42) -> DataFrame:
    """One row per input row: (id, fp, component_id).

    Fingerprints link at ``radius`` or fewer differing bits; ``component_id`` is
    the least id that links reach, the row's own included (null only if all ids
    there are null). Null or empty texts have fingerprint zero and link like any
    other; repeated rows stay repeated; an empty table gives no rows; columns
    besides the id and the text are ignored.
    """
    found = materialise(fingerprints(docs, id_col, text_col, shingle_words, seed), "fingerprints")
    nodes = materialise(found.groupBy("fp").agg(F.min("id").alias("least_id")), "nodes")
    roots = connected_components(fingerprint_links(nodes, "fp", 64, radius), "a", "b")
    named = materialise(nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root")), "roots")
    least = materialise(named.groupBy("root").agg(F.min("least_id").alias("component_id")), "least")
    classes = materialise(named.join(least, "root").select(F.col("fp").alias("known"), "component_id"), "classes")
    return found.join(classes, found.fp == classes.known).select("id", "fp", "component_id")
