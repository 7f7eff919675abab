"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

An item of m characters that occurs in a text with at most k edits shares at
least m - q + 1 - k q of its q-grams with the occurrence, on diagonals (text
position minus item position) within k of each other. Shared q-grams are counted
in diagonal bands that overlap by half, so one band holds them all; bands that
reach the bound are verified by alignment inside the band.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, fresh_name, type_of
from .textscan import mix

#: Share of an item's characters that may be edited, and the length of the grams.
EDIT_RATE = 0.08
GRAM = 8
#: Benchmark characters that tasks hold at once; a larger benchmark is worked off in blocks.
BLOCK_CHARS = 4_000_000
#: Postings expanded at once, and candidates aligned side by side.
_POSTINGS, _ALIGNED = 4_000_000, 4096
_TABLE_BITS = 22
_PIECE_CHARS = 1 << 20


def normalised(text: str) -> str:
    """Lower case, every run of white space as one space."""
    return " ".join(text.lower().split())


def edit_budget(length: int, rate: float = EDIT_RATE, gram: int = GRAM) -> int:
    """Edits allowed: the rate's, but few enough that the lemma demands a shared gram."""
    return max(0, min(int(rate * length), (length - gram) // gram))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def _grams(codes: np.ndarray, gram: int) -> np.ndarray:
    """Hash of every run of ``gram`` characters, by doubling."""
    if len(codes) < gram:
        return np.empty(0, np.uint64)
    have, current = 1, codes.astype(np.uint64) + np.uint64(1)
    while have < gram:
        step = min(have, gram - have)
        scale = np.uint64(pow(0xD6E8FEB86659FD93, step, 1 << 64))
        # Windows of have + step characters: the first have, and the last have of them.
        current = mix(current[: len(current) - step] * scale + current[step:]) if step < have else current[:-have] * scale + current[have:]
        have += step
    return mix(current)


class Items:
    """A block of benchmark items, indexed by gram, in classes of similar length."""

    def __init__(self, items: list[tuple[object, str]], rate: float = EDIT_RATE, gram: int = GRAM):
        self.gram = gram
        self.ids = [i for i, _ in items]
        self.texts = [normalised(t or "") for _, t in items]
        self.budget = np.array([edit_budget(len(t), rate, gram) for t in self.texts], np.int64)
        self.length = np.array([len(t) for t in self.texts], np.int64)
        self.need = np.maximum(1, self.length - gram + 1 - self.budget * gram)
        # An item shorter than a gram counts only as a whole text.
        self.short: dict[str, list[int]] = {}
        for i, t in enumerate(self.texts):
            if 0 < len(t) < gram:
                self.short.setdefault(t, []).append(i)
        kinds = np.where(self.length >= gram, (np.log2(np.maximum(self.length, 1)) * 2).astype(np.int64), -1)
        self.classes = []
        for number, kind in enumerate(sorted(set(kinds[kinds >= 0].tolist()))):
            members = np.flatnonzero(kinds == kind)
            self.classes.append((number, int(self.need[members].min()), int((self.length + self.budget)[members].max()), set(members.tolist())))
        self.kind_number = {k: n for n, k in enumerate(sorted(set(kinds[kinds >= 0].tolist())))}
        hashes, item, place = [], [], []
        self.table = np.zeros(1 << _TABLE_BITS, np.uint32)
        for i, t in enumerate(self.texts):
            if len(t) >= gram:
                own = _grams(_codes(t), gram)
                hashes.append(own)
                item.append(np.full(len(own), i))
                place.append(np.arange(len(own)))
                np.bitwise_or.at(self.table, (own >> np.uint64(64 - _TABLE_BITS)).astype(np.int64), np.uint32(1 << (self.kind_number[int(kinds[i])] % 32)))
        flat = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        self.item = np.concatenate(item)[order] if hashes else np.empty(0, np.int64)
        self.place = np.concatenate(place)[order] if hashes else np.empty(0, np.int64)
        self.hashes, self.first, self.times = np.unique(flat[order], return_index=True, return_counts=True)
        # Alignment begins at the end whose grams fewer items share, where a false candidate fails soonest.
        self.codes = [_codes(t).astype(np.int64) for t in self.texts]
        shared = np.repeat(self.times, self.times) if hashes else np.empty(0, np.int64)
        late = np.zeros(len(self.texts))
        np.add.at(late, self.item, shared * np.where(self.place * 2 < np.maximum(self.length - gram, 1)[self.item], 1.0, -1.0))
        self.backward = late > 0
        self.kind_of = np.array([self.kind_number.get(int(k), -1) for k in kinds], np.int64)

    def search(self, texts: list[str]) -> Iterator[tuple[int, int, int, int, int]]:
        """(text, item, start, end, edits) of every text that holds an item; best edits each."""
        for d, t in enumerate(texts):
            for i in self.short.get(t, ()):
                yield d, i, 0, len(t), 0
        if not len(self.hashes):
            return
        codes = _codes("\0".join(texts))
        starts = np.cumsum([0] + [len(t) + 1 for t in texts])
        grams = _grams(codes, self.gram)
        if not len(grams):
            return
        flags = self.table[(grams >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)]
        for number, need, span, _ in self.classes:
            hit = (flags >> np.uint32(number % 32)) & np.uint32(1)
            total = np.zeros(len(hit) + 1, np.int32)
            np.cumsum(hit, out=total[1:])
            span = min(span, len(hit))
            dense = np.flatnonzero(total[span:] - total[:-span] >= need)
            if not len(dense):
                continue
            edge = np.zeros(len(hit) + 1, np.int32)
            np.add.at(edge, dense, 1)
            np.add.at(edge, dense + span, -1)
            at = np.flatnonzero((np.cumsum(edge[:-1]) > 0) & (hit > 0))
            yield from self._bands(number, texts, starts, grams, at)

    def _bands(self, number, texts, starts, grams, at):
        found = np.minimum(np.searchsorted(self.hashes, grams[at]), len(self.hashes) - 1)
        real = self.hashes[found] == grams[at]
        at, found = at[real], found[real]
        sizes = np.cumsum(self.times[found])
        mine = self.kind_of == number
        reach = int((self.length + 2 * self.budget)[mine].max())
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        low = 0
        while low < len(at):
            # A run of positions with few postings, and after it as much as an occurrence may reach.
            before = sizes[low - 1] if low else 0
            high = max(low + 1, int(np.searchsorted(sizes, before + _POSTINGS, "right")))
            stop = int(np.searchsorted(at, at[high - 1] + reach, "right")) if high < len(at) else len(at)
            self._block(number, texts, starts, at[low:stop], found[low:stop], best)
            low = high
        for (d, i), (edits, start, end) in best.items():
            yield d, i, start, end, edits

    def _block(self, number, texts, starts, at, found, best):
        times = self.times[found]
        post = np.repeat(self.first[found] - np.cumsum(times) + times, times) + np.arange(times.sum())
        at = np.repeat(at, times)
        item = self.item[post]
        mine = self.kind_of[item] == number
        at, item, place = at[mine], item[mine], self.place[post][mine]
        if not len(at):
            return
        doc = np.searchsorted(starts, at, "right") - 1
        width = self.budget[item] + 1
        # Shifted by the item's length, as an occurrence may begin before the text's first character does.
        band = (at - starts[doc] - place + self.length[item]) // width
        doc, item, band = np.concatenate([doc, doc]), np.concatenate([item, item]), np.concatenate([band, band - 1])
        order = np.lexsort((band, item, doc))
        doc, item, band = doc[order], item[order], band[order]
        first = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (band[1:] != band[:-1])]))
        count = np.diff(np.append(first, len(doc)))
        first = first[count >= self.need[item[first]]]
        lows = band[first] * (self.budget[item[first]] + 1) - self.length[item[first]]
        for k in self._plausible(texts, doc[first], item[first], lows):
            d, i, low = int(doc[first[k]]), int(item[first[k]]), int(lows[k])
            if best.get((d, i), (1,))[0] == 0:
                continue
            seen = align_in_band(texts[d], self.texts[i], low, low + 2 * (int(self.budget[i]) + 1), int(self.budget[i]))
            if seen and (d, i) not in best or seen and seen[0] < best[d, i][0]:
                best[d, i] = seen

    def _plausible(self, texts, doc, item, low):
        """Indices of the candidates whose alignment, from the end that fewer items share, stays within the budget.

        Many are aligned side by side, a row of the band per character of the items;
        one that exceeds its budget drops out, so a shared stem costs next to nothing.
        """
        if len(doc) <= 8:
            return range(len(doc))
        order, good = np.lexsort((self.budget[item], self.length[item])), []
        for at in range(0, len(order), _ALIGNED):
            good.append(self._within(texts, doc, item, low, order[at : at + _ALIGNED]))
        return np.sort(np.concatenate(good)).tolist()

    def _within(self, texts, doc, item, low, alive):
        budget, length = self.budget[item], self.length[item]
        # The band of align_in_band, widened to the widest here: a wider band only lets more through.
        widest = int(budget[alive].max())
        band = np.arange(4 * widest + 3)
        names = np.unique(doc[alive])
        parts, begins, size = [], {}, 0
        for d in names.tolist():
            parts.append(_codes(texts[d]).astype(np.int64))
            begins[d] = size
            size += len(parts[-1])
        text, ends = np.concatenate(parts), {d: begins[d] + len(p) for d, p in zip(names.tolist(), parts, strict=True)}
        begin = np.array([begins[d] for d in doc[alive].tolist()], np.int64)
        end = np.array([ends[d] for d in doc[alive].tolist()], np.int64)
        goals = np.full((len(alive), int(length[alive].max())), -2, np.int64)
        for row, k in enumerate(alive.tolist()):
            own = self.codes[item[k]]
            goals[row, : len(own)] = own[::-1] if self.backward[item[k]] else own
        back = self.backward[item[alive]]
        # Text position before the item's first character, or after its last one going backward.
        first = begin + low[alive] - budget[alive]
        origin = np.where(back, first + length[alive] + 4 * budget[alive] + 2, first)
        sign = np.where(back, -1, 1)
        most, done = budget[alive], []
        where = origin[:, None] + sign[:, None] * band
        far = 1 << 30
        row = np.where((where >= begin[:, None]) & (where <= end[:, None]), 0, far)
        rows = np.arange(len(alive))
        for step in range(goals.shape[1]):
            # Of a position between characters, the character that the step passes.
            where = origin[rows, None] + sign[rows, None] * (band + step)
            char = np.where(sign[rows, None] > 0, where, where - 1)
            inside = (char >= begin[rows, None]) & (char < end[rows, None])
            same = inside & (text[np.clip(char, 0, len(text) - 1)] == goals[rows, step, None])
            new = row + ~same
            new[:, :-1] = np.minimum(new[:, :-1], row[:, 1:] + 1)
            after = where + sign[rows, None]
            valid = (after >= begin[rows, None]) & (after <= end[rows, None])
            new = np.where(valid, new, far)
            row = np.minimum.accumulate(new - band, 1) + band
            row = np.where(valid, row, far)
            least = row.min(1)
            ended = length[alive[rows]] == step + 1
            fits = least <= most[rows]
            done.append(alive[rows[ended & fits]])
            stay = fits & ~ended
            if not stay.all():
                rows, row = rows[stay], row[stay]
            if not len(rows):
                break
        return np.concatenate(done) if done else np.empty(0, np.int64)


def _band_rows(text: np.ndarray, item: np.ndarray, low: int, width: int, free_start: bool) -> np.ndarray:
    """Edit distances of the whole item against text ending at (len(item) + low + b), b < width."""
    n = len(text)
    b = np.arange(width)
    begin = low + b
    big = len(item) + n + 1
    inside = (begin >= 0) & (begin <= n)
    row = np.where(inside, 0 if free_start else np.abs(begin), big)
    padded = np.full(n + 2 * width + len(item) + abs(low) + 2, -1, np.int64)
    shift = width + abs(low) + 1
    padded[shift : shift + n] = text[: len(padded) - shift]
    for i, c in enumerate(item.tolist(), 1):
        at = i + low
        same = padded[shift + at - 1 : shift + at - 1 + width] == c
        step = row + ~same
        step[:-1] = np.minimum(step[:-1], row[1:] + 1)
        end = at + b
        step = np.where((end >= 0) & (end <= n), step, big)
        row = np.minimum.accumulate(step - b) + b
        row = np.where((end >= 0) & (end <= n), row, big)
    return row


def align_in_band(text: str, item: str, low: int, high: int, budget: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the best occurrence of ``item`` in ``text`` on diagonals [low, high), or None.

    The band is widened by the budget, as edits move an occurrence off its grams' diagonals.
    """
    low, high = low - budget, high + budget
    begin, stop = max(0, low), max(0, min(len(text), high + len(item)))
    exact = text.find(item, begin, stop)
    if exact >= 0:
        return 0, exact, exact + len(item)
    if budget == 0:
        return None
    region, goal = _codes(text[begin:stop]).astype(np.int64), _codes(item).astype(np.int64)
    row = _band_rows(region, goal, low - begin, high - low + 1, True)
    b = int(row.argmin())
    edits = int(row[b])
    if edits > budget:
        return None
    end = len(goal) + low - begin + b
    back = _band_rows(region[:end][::-1], goal[::-1], -edits, 2 * edits + 1, False)
    size = len(goal) - edits + int(back.argmin())
    return edits, begin + end - size, begin + end


def _blocks(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple[object, str]]]:
    """The items in blocks of about BLOCK_CHARS characters; the driver holds one at a time."""
    rows = benchmark.select(F.col(item_col).alias("item"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    chars = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    count = max(1, -(-chars // BLOCK_CHARS))
    for k in range(count):
        block = rows if count == 1 else rows.where(F.pmod(F.xxhash64("text"), F.lit(count)) == k)
        yield sorted(((r.item, r.text) for r in block.collect()), key=lambda r: (str(r[0]), r[1]))


def _pieces(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    low, own, chars = 0, [], 0
    for t in texts:
        own.append(normalised(t or ""))
        chars += len(own[-1]) + 1
        if chars >= _PIECE_CHARS:
            yield low, own
            low, own, chars = low + len(own), [], 0
    if own:
        yield low, own


def find_items(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", rate: float = EDIT_RATE, gram: int = GRAM) -> DataFrame:
    """(id, item, start, end, edits), a row for every document and item that it holds.

    An item is held if it occurs with at most ``edit_budget`` character edits in
    the normalised text (lower case, runs of white space as one space); start and
    end are code points of that. An item shorter than a gram is held only by a
    text equal to it; null and empty texts and items hold and are held by nothing.
    Repeated documents and items give repeated rows; empty tables give no rows;
    other columns are ignored.
    """
    id_type, item_type = type_of(docs, id_col), type_of(benchmark, item_col)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    spark, out = docs.sparkSession, None
    for block in _blocks(benchmark, item_col, item_text_col):
        items = spark.sparkContext.broadcast(Items(block, rate, gram))
        kind = _arrow_type(benchmark, item_col)

        def run(batches, items=items, kind=kind):
            held = items.value
            for batch in batches:
                rows = [(low + d, i, s, e, n) for low, own in _pieces(batch.column(1).to_pylist()) for d, i, s, e, n in held.search(own)]
                if rows:
                    d, i, s, e, n = (list(x) for x in zip(*rows, strict=True))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(d)), pa.array([held.ids[x] for x in i], kind), pa.array(s, pa.int32()), pa.array(e, pa.int32()), pa.array(n, pa.int32())], names=["id", "item", "start", "end", "edits"])

        found = arrow_map(rows, run, f"id {id_type}, item {item_type}, start int, end int, edits int")
        out = found if out is None else out.unionByName(found)
    return out


def _arrow_type(df: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[column].dataType)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", rate: float = EDIT_RATE, gram: int = GRAM) -> DataFrame:
    """``docs`` without the rows that hold a benchmark item, as ``find_items`` has it.

    Null and empty texts hold nothing and stay, repeated rows go or stay alike, an
    empty benchmark drops nothing, empty tables give no rows, and columns are
    unchanged, whatever their names.
    """
    spark = docs.sparkSession
    at = docs.columns.index(text_col)
    for block in _blocks(benchmark, item_col, item_text_col):
        items = spark.sparkContext.broadcast(Items(block, rate, gram))

        def run(batches, items=items):
            held = items.value
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                for low, own in _pieces(batch.column(at).to_pylist()):
                    clean[[low + d for d, *_ in held.search(own)]] = False
                yield batch.filter(pa.array(clean))

        docs = arrow_map(docs, run, docs.schema)
    return docs
