"""Aligning two tokenizers' tokens of the same bytes, by diagonal run skipping.

Both sequences of tokens cut the same bytes. As long as tokens end at the same
bytes one by one, their indices differ by a constant shift; stretches of that kind
are jumped over by comparing ever longer slices of the two end arrays at the
current shift. What lies between is resolved token by token and changes the shift.

Counts of id pairs over the whole corpus come from Spark. The commonest pairs, at
most ``HEAD`` whatever the corpus, go to every task as sorted arrays; links of all
other pairs, of which none has more than two in ``HEAD`` of all links, are joined.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, discard, materialise

#: Where the tokenizers' files are, and which cut the texts.
TOKENIZERS = "/opt/tokenizers"
BYTE_BPE, PIECE_BPE = "byte_bpe_50k.json", "piece_bpe_32k.model"

#: The most pairs of ids whose counts every task holds: 16 MB.
HEAD = 1 << 20

#: Links that a task counts before it hands the distinct ones on.
HELD = 1 << 22


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it prints, else the next free one from 256."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteTokens:
    """Ids of a byte-level BPE vocabulary, and the bytes of each id.

    The file's own library gives the ids. Where the file's merges are in order of
    ids, as in all vocabularies of this kind that number tokens as they were learnt,
    ids are ranks, and a faster library gives the same ones.
    """

    #: How byte-level vocabularies of this kind part a text before merging (fixed value).
    PARTS = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        letters, vocabulary = byte_letters(), file["model"]["vocab"]
        special = {t["content"] for t in file.get("added_tokens", ()) if t.get("special")}
        spelled = lambda token: token.encode() if token in special else bytes(map(letters.__getitem__, token))
        self.bytes = [b""] * (max([*vocabulary.values(), *(t["id"] for t in file.get("added_tokens", ()))]) + 1)
        for token, i in vocabulary.items():
            self.bytes[i] = spelled(token)
        self.sizes, self.barred = np.array([*map(len, self.bytes)]), [f"{i}|" for i in range(len(self.bytes))]
        self.quick = None
        merges = [m.split(" ") if isinstance(m, str) else m for m in file["model"]["merges"]]
        steps = file.get("pre_tokenizer") or {}
        if file.get("normalizer") is None and steps.get("type") == "ByteLevel" and steps.get("use_regex", True) and not steps.get("add_prefix_space") and all(vocabulary.get(a + b) == 256 + k for k, (a, b) in enumerate(merges)):
            import tiktoken

            ranks = {spelled(t): i for t, i in vocabulary.items() if t not in special}
            self.quick = tiktoken.Encoding("bytes", pat_str=self.PARTS, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> list[int]:
        if self.quick is not None:
            try:
                return self.quick.encode_ordinary(text)
            except BaseException as e:  # its matcher gives up on some very long runs of one character
                if isinstance(e, (KeyboardInterrupt, SystemExit)):
                    raise
        return self.library.encode(text, add_special_tokens=False).ids


class PieceTokens:
    """Ids of a sentence-piece vocabulary, and the bytes of each id."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = []
        for i in range(self.library.get_piece_size()):
            piece = self.library.id_to_piece(i)
            self.bytes.append(bytes([int(piece[3:5], 16)]) if self.library.is_byte(i) else piece.replace("▁", " ").encode())
        self.sizes, self.closed = np.array([*map(len, self.bytes)]), [f"{i};" for i in range(len(self.bytes))]

    def ids(self, text: str) -> list[int]:
        return self.library.encode(text, num_threads=1)


@lru_cache(maxsize=4)
def byte_tokens(path: str) -> ByteTokens:
    """Loaded once in each worker."""
    return ByteTokens(path)


@lru_cache(maxsize=4)
def piece_tokens(path: str) -> PieceTokens:
    return PieceTokens(path)


def align(ends: list[int], others: list[int]) -> Iterator[tuple[bool, int, int, int, int]]:
    """(one to one?, first and end index here, first and end index there) of stretches and irregular groups, in order.

    Both arrays rise strictly and end at the same byte. A stretch is one group for
    each of its tokens, an irregular group has several tokens on a side.
    """
    i = j = 0
    n = len(ends)
    while i < n:
        low, there, width = i, j, 4
        while i < n and ends[i : i + width] == others[j : j + width]:
            i += width
            j += width
            width *= 2
        if i >= n:
            yield True, low, n, there, len(others)
            return
        while width > 1:
            width //= 2
            if ends[i : i + width] == others[j : j + width]:
                i += width
                j += width
        if i > low:
            yield True, low, i, there, j
        low, there = i, j
        a, b = ends[i], others[j]
        while a != b:
            if a < b:
                i += 1
                a = ends[i]
            else:
                j += 1
                b = others[j]
        i += 1
        j += 1
        yield False, low, i, there, j


def links(ends: list[int], others: list[int], group: tuple[bool, int, int, int, int]) -> Iterator[tuple[int, int]]:
    """Index pairs of the tokens of an irregular group whose bytes overlap."""
    _, i, last, j, _ = group
    while True:
        yield i, j
        a, b = ends[i], others[j]
        if a == b:
            return
        if a < b:
            i += 1
        else:
            j += 1


def pack(codes: np.ndarray) -> bytes:
    """Sorted codes, small: differences byte by byte of significance, compressed behind their width."""
    if not len(codes):
        return b""
    width = 4 if codes[-1] < 1 << 32 else 8
    planes = np.diff(codes, prepend=0).astype(f"<u{width}").view(np.uint8).reshape(-1, width).T
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(packed: bytes) -> np.ndarray:
    if not packed:
        return np.empty(0, np.int64)
    width = packed[0]
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed[1:]), np.uint8).reshape(width, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(f"<u{width}").ravel().astype(np.int64))


class Aligned:
    """One text: its tokens by both tokenizers, groups and links."""

    def __init__(self, text: str | None, one: ByteTokens, other: PieceTokens):
        #: Every link as a code, a id times the number of b ids plus b id, sorted.
        self.groups, self.codes = "", np.empty(0, np.int64)
        self.n_here = self.n_there = self.n_groups = self.n_links = 0
        if not text:
            return
        whole = " " + text
        data, here, there = whole.encode(), one.ids(whole), other.ids(text)
        if b"".join(map(other.bytes.__getitem__, there)) != data or b"".join(map(one.bytes.__getitem__, here)) != data:
            return
        a_ids, b_ids = np.array(here, np.int64), np.array(there, np.int64)
        sizes, other_sizes = one.sizes[a_ids], other.sizes[b_ids]
        if not (sizes.all() and other_sizes.all()):
            return
        self.n_here, self.n_there = len(here), len(there)
        ends, others = np.cumsum(sizes).tolist(), np.cumsum(other_sizes).tolist()
        barred, closed = [*map(one.barred.__getitem__, here)], [*map(other.closed.__getitem__, there)]
        shown: list[str] = []  # of groups, each ending in a semicolon
        #: Links in runs: first index here and there, whether it moves on, and how many links.
        runs: list[int] = []
        for group in align(ends, others):
            regular, a, b, c, d = group
            if regular:
                pairs = barred[a:b] * 2
                pairs[::2], pairs[1::2] = barred[a:b], closed[c:d]
                shown += pairs
                self.n_groups += b - a
                runs += (a, 1, c, 1, b - a)
                continue
            self.n_groups += 1
            shown.append(f"{','.join(map(str, here[a:b]))}|{','.join(map(str, there[c:d]))};")
            if b - a == 1:  # one token overlaps all of the others
                runs += (a, 0, c, 1, d - c)
            elif d - c == 1:
                runs += (a, 1, c, 0, b - a)
            else:
                for i, j in links(ends, others, group):
                    runs += (i, 0, j, 0, 1)
        a, a_moves, c, c_moves, n = np.array(runs, np.int64).reshape(-1, 5).T
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        at, to = np.repeat(a, n) + np.repeat(a_moves, n) * step, np.repeat(c, n) + np.repeat(c_moves, n) * step
        self.n_links, self.groups = len(at), "".join(shown)[:-1]
        self.codes = a_ids[at] * len(other.bytes) + b_ids[to]
        self.codes.sort()


def _aligner(folder: str, one: str, other: str, digest: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = byte_tokens(os.path.join(folder, one)), piece_tokens(os.path.join(folder, other))
        for batch in batches:
            columns: list[list] = [[] for _ in range(6)]
            for text in batch.column("text"):
                found = Aligned(text.as_py(), *both)
                groups = hashlib.sha256(found.groups.encode()).hexdigest() if digest and found.n_here else found.groups
                for column, value in zip(columns, (found.n_here, found.n_there, found.n_groups, found.n_links, groups, pack(found.codes))):
                    column.append(value)
            arrays = [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.large_string(), pa.large_binary()))]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("id"), *arrays], ["row", "id", "n_a", "n_b", "n_groups", "n_links", "groups", "links"])

    return run


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct codes and how often they are there, over as many documents as fit."""
    codes, size = [], 0

    def flushed() -> pa.RecordBatch:
        every, times = np.unique(np.concatenate(codes), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(every), pa.array(times)], ["code", "n"])

    for batch in batches:
        for packed in batch.column("links"):
            codes.append(unpack(packed.as_py()))
            size += len(codes[-1])
            if size >= HELD:
                yield flushed()
                codes, size = [], 0
    if size:
        yield flushed()


def _scorer(head) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts, best = head.value
        for batch in batches:
            sums, bests, rest = [], [], []
            for packed in batch.column("links"):
                codes = unpack(packed.as_py())
                at = np.minimum(np.searchsorted(known, codes), max(len(known) - 1, 0))
                in_head = known[at] == codes if len(known) else np.zeros(len(codes), bool)
                at = at[in_head]
                sums.append(int(counts[at].sum()) if len(at) else 0)
                bests.append(int(best[at].sum()) if len(at) else 0)
                rest.append(codes[~in_head])
            lists = [pa.array(rest, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("row", "id", "n_a", "n_b", "n_groups", "n_links", "groups")], pa.array(bests, pa.int64()), pa.array(sums, pa.int64()), *lists], ["row", "id", "n_a", "n_b", "n_groups", "n_links", "groups", "n_best", "count_sum", "codes"])

    return run


def _split(counts: DataFrame, most: int) -> int:
    """The least power of two such that at most ``most`` codes have as many links or more."""
    sizes = {r.power: r["count"] for r in counts.groupBy(F.floor(F.log2("n")).cast("int").alias("power")).count().collect()}  # at most 63 rows
    power, total = 63, 0
    while power and total + sizes.get(power - 1, 0) <= most:
        power -= 1
        total += sizes.get(power, 0)
    return 1 << power


def align_texts(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    folder: str = TOKENIZERS,
    one: str = BYTE_BPE,
    other: str = PIECE_BPE,
    digest: bool = False,
    head: int = HEAD,
) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, groups, n_best, count_sum), one row per document.

    Tokens of a space and the text, by the byte-level tokenizer ``one`` (a) and the
    sentence-piece tokenizer ``other`` (b), are cut into ``groups``, ``a1,a2|b1;...``,
    at every byte where both have an end; with ``digest`` the column holds the
    SHA-256 instead, which keeps a string longer than the text out of the tables.
    Links are pairs of tokens that overlap. ``count_sum`` adds up, over links, how
    many links of the whole table pair these two ids, ``n_best`` counts the links
    whose pair has the most of its b id, ties included.

    Texts that are null, empty or not spelled by their tokens' bytes have no tokens:
    zeros and an empty string. Repeated rows count each. Very long texts are one
    task's work, in memory linear in their length. An empty table gives no rows.
    """
    spark = docs.sparkSession
    width = len(piece_tokens(os.path.join(folder, other)).bytes)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    stats = f"row long, id {kind}, n_a long, n_b long, n_groups long, n_links long, groups string"
    aligned = materialise(arrow_map(rows, _aligner(folder, one, other, digest), f"{stats}, links binary"), "aligned")
    counts = materialise(arrow_map(aligned.select("links"), _counted, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")), "pairs")
    least = _split(counts, head)
    table = counts.where(F.col("n") >= F.lit(least)).toArrow()  # at most ``head`` rows
    codes, n = (table.column(c).to_numpy() for c in ("code", "n"))
    order = np.argsort(codes)
    codes, n = codes[order], n[order]
    top = np.zeros(width, np.int64)
    np.maximum.at(top, codes % width, n)  # a b id with a pair here has its best one here
    held = spark.sparkContext.broadcast((codes, n, n == top[codes % width]))
    scored = materialise(arrow_map(aligned, _scorer(held), f"{stats}, n_best long, count_sum long, codes array<long>"), "scored")
    discard(aligned)
    tops = F.broadcast(counts.groupBy((F.col("code") % width).alias("b")).agg(F.max("n").alias("top")))  # one row for each id of a vocabulary
    rest = scored.select("row", F.explode("codes").alias("code")).groupBy("row", "code").agg(F.count(F.lit(1)).alias("times"))
    rest = rest.join(counts.where(F.col("n") < F.lit(least)), "code").join(tops, F.col("code") % width == F.col("b"))
    rest = rest.groupBy("row").agg(F.sum(F.col("times") * F.col("n")).alias("more"), F.sum(F.when(F.col("n") == F.col("top"), F.col("times"))).alias("more_best"))
    plus = lambda a, b: (F.col(a) + F.coalesce(F.col(b), F.lit(0))).alias(a)
    return scored.drop("codes").join(rest, "row", "left").select("id", "n_a", "n_b", "n_groups", "n_links", "groups", plus("n_best", "more_best"), plus("count_sum", "more"))
