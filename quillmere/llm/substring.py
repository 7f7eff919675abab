"""Removal of passages that repeat word for word, by level-wise doubling.

A window that repeats contains, at either place, the same least-hashed short
seed. So level one counts only these sampled seeds; windows around seeds that
repeat are extended to twice the seed's length (to the full window at most),
hashed and counted again, until the length asked for is reached or no candidate
survives. Counts combine on the map side, so a passage in a third of all
documents is one row per task.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, discard, free_shuffles, materialise, type_of
from .textscan import SpanHasher, Words, pieces, sliding_minimum, window_hashes


def levels(window: int, seed_words: int | None = None) -> list[int]:
    """Window lengths level by level: each at most twice the one before."""
    out = [min(window, seed_words or -(-window // 2))]
    while out[-1] < window:
        out.append(min(window, 2 * out[-1]))
    return out


class _Text:
    """Hashes of one piece's words, and where windows of a length may start."""

    def __init__(self, data, offsets):
        self.words = Words(data, offsets)
        self.single = SpanHasher(data)(self.words.start, self.words.end)

    def windows(self, length: int):
        """(hashes, inside): of every run of words, and whether one document holds it."""
        hashes = window_hashes(self.single, length)
        doc = self.words.doc
        return hashes, doc[: len(hashes)] == doc[len(doc) - len(hashes) :]


def _least_in_windows(seeds: np.ndarray, seed_words: int, window: int) -> np.ndarray:
    """The least seed hash of every window, by the window's first word."""
    return sliding_minimum(seeds, window - seed_words + 1)


def _chosen(text: _Text, seed_words: int, window: int):
    """Indices and hashes of the seeds that are the least of some window."""
    seeds, _ = text.windows(seed_words)
    full, inside = text.windows(window)
    if not len(full):
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    least = np.where(inside, _least_in_windows(seeds, seed_words, window), np.uint64(0))
    width = window - seed_words + 1
    # A seed is chosen if a window over it has it as its least: the greatest least of those windows.
    padded = np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)])
    greatest = ~sliding_minimum(~padded, width)
    at = np.flatnonzero((greatest[: len(seeds)] == seeds) & (seeds > 0))
    return at, seeds[at]


def _row_key(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The text under a key that equal rows alone share: the id and a hash of the text."""
    ident = F.coalesce(F.col(id_col), F.lit(0)) if type_of(docs, id_col) in ("bigint", "int", "smallint", "tinyint") else F.xxhash64(id_col)
    check = F.hash(F.col(id_col).isNull(), F.xxhash64(F.col(text_col)))
    return docs.select(F.col(id_col).alias("id"), ident.cast("long").alias("k1"), check.alias("k2"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def _batch(names, *columns):
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=list(names))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35, seed_words: int | None = None) -> DataFrame:
    """One row per input row: (id, n_words, n_removed, kept_text).

    Words are runs without ASCII white space, unchanged. A word goes if some
    window of ``window`` words over it also starts anywhere else in the table,
    the same document included; all occurrences go, and windows are judged on the
    input. The kept words are joined by one space. Null and empty texts have no
    word and keep an empty text; equal rows are copies of each other; an empty
    table gives no rows; other columns are ignored. Window hashes have 64 bits.
    """
    spark = docs.sparkSession
    steps = levels(window, seed_words)
    base = _row_key(docs, id_col, text_col)

    # Whole copies first: the longest repeat there is, for which no window need be looked up.
    def sequences(batches):
        for batch in batches:
            texts = batch.column(2).cast(pa.binary()).to_pylist()
            keep, digests = [], []
            for i, t in enumerate(texts):
                words = t.split()
                if len(words) >= window:
                    keep.append(i)
                    digests.append(xxhash.xxh3_128_digest(b" ".join(words)))
            some = pa.array(keep, pa.int64())
            yield _batch(("k1", "k2", "seq"), batch.column(0).take(some), batch.column(1).take(some), pa.array(digests, pa.binary()))

    seqs = materialise(arrow_map(base.select("k1", "k2", "text"), sequences, "k1 long, k2 int, seq binary"), "sequences")
    copied = seqs.groupBy("seq").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("seq")
    copies = materialise(seqs.join(materialise(copied, "copied"), "seq", "left_semi").select("k1", "k2").distinct(), "copies")

    def seeds(batches):
        for batch in batches:
            for low, _, data, offsets in pieces(batch.column(2)):
                text = _Text(data, offsets)
                at, hashes = _chosen(text, steps[0], window)
                row = pa.array(text.words.doc[at] + low)
                yield _batch(("h", "k1", "k2", "at"), hashes.view(np.int64), batch.column(0).take(row), batch.column(1).take(row), (at - text.words.first[text.words.doc[at]]).astype(np.int32))

    def counted(name):
        """Combine equal hashes of a batch before the JVM sees them."""

        def run(batches):
            for batch in batches:
                values, n = np.unique(batch.column(name).to_numpy(zero_copy_only=False), return_counts=True)
                yield _batch(("h", "n"), values, n.astype(np.int64))

        return run

    where = "h long, k1 long, k2 int, at int"
    found = arrow_map(base.select("k1", "k2", "text"), seeds, where)
    often = materialise(arrow_map(found.select("h"), counted("h"), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h"), "seeds")
    hits = materialise(found.join(often, "h", "left_semi").select("k1", "k2", "at"), "hits")
    free_shuffles(spark)

    for level, length in enumerate(steps[1:] if len(steps) > 1 else steps):
        if hits.isEmpty():
            break
        first = level == 0
        marks = hits.groupBy("k1", "k2").agg(F.collect_list("at").alias("ats")).join(copies.withColumn("copy", F.lit(True)), ["k1", "k2"], "left")
        joined = base.select("k1", "k2", "text").join(marks, ["k1", "k2"]).select("k1", "k2", "text", "ats", F.coalesce("copy", F.lit(False)).alias("copy"))

        def windows(batches, length=length, first=first, shorter=steps[level]):
            for batch in batches:
                lists = batch.column(3)
                for low, high, data, offsets in pieces(batch.column(2)):
                    text = _Text(data, offsets)
                    full, inside = text.windows(length)
                    if not len(full):
                        continue
                    mine = lists.slice(low, high - low)
                    at = mine.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                    owner = np.repeat(np.arange(high - low), np.diff(mine.offsets.to_numpy()))
                    marked = np.zeros(len(text.single) + 1, bool)
                    marked[text.words.first[owner] + at] = True
                    if first:  # a window survives if its least seed repeats
                        seeds, _ = text.windows(shorter)
                        least = _least_in_windows(seeds, shorter, window)
                        repeated = np.unique(seeds[np.flatnonzero(marked[: len(seeds)])])
                        ok = np.zeros(len(full), bool)
                        good = np.isin(least, repeated) & text.windows(window)[1]
                        for shift in range(window - length + 1):
                            ok[shift : shift + len(good)] |= good[: len(ok) - shift]
                        ok &= inside
                    else:  # a window survives if it is made of two shorter ones that repeat
                        gap = length - shorter
                        ok = marked[: len(full)] & marked[gap : gap + len(full)] & inside
                    start = np.flatnonzero(ok)
                    row = pa.array(text.words.doc[start] + low)
                    yield _batch(("h", "k1", "k2", "at", "copy"), full[start].view(np.int64), batch.column(0).take(row), batch.column(1).take(row), (start - text.words.first[text.words.doc[start]]).astype(np.int32), batch.column(4).take(row))

        found = arrow_map(joined, windows, where + ", copy boolean")
        often = materialise(arrow_map(found.select("h"), counted("h"), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h"), "windows")
        last = length == window
        after = materialise((found.where("not copy") if last else found).join(often, "h", "left_semi").select("k1", "k2", "at"), "hits")
        discard(hits)
        hits = after
        free_shuffles(spark)

    marks = hits.groupBy("k1", "k2").agg(F.collect_list("at").alias("ats")).select("k1", "k2", "ats", F.lit(False).alias("copy"))
    marks = marks.unionByName(copies.select("k1", "k2", F.expr("cast(array() as array<int>)").alias("ats"), F.lit(True).alias("copy")))
    whole = base.join(marks, ["k1", "k2"], "left").select("id", "text", F.coalesce("ats", F.expr("cast(array() as array<int>)")).alias("ats"), F.coalesce("copy", F.lit(False)).alias("copy"))

    def cut(batches):
        for batch in batches:
            total, gone, kept = [], [], []
            lists = batch.column(2)
            bounds = lists.offsets.to_numpy()
            at = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            at_bounds = bounds - bounds[0]
            for i, (t, copy) in enumerate(zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                words = t.split()
                n = len(words)
                starts = at[at_bounds[i] : at_bounds[i + 1]]
                if copy:
                    words = []
                elif len(starts):
                    edge = np.zeros(n + 1, np.int64)
                    np.add.at(edge, starts, 1)
                    np.add.at(edge, starts + window, -1)
                    stays = np.cumsum(edge[:n]) == 0
                    words = [w for w, s in zip(words, stays, strict=True) if s]
                total.append(n)
                gone.append(n - len(words))
                kept.append(b" ".join(words))
            yield _batch(("id", "n_words", "n_removed", "kept_text"), batch.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()))

    return arrow_map(whole, cut, f"id {type_of(docs, id_col)}, n_words long, n_removed long, kept_text string")
