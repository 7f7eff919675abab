"""Quality rules as a short-circuit cascade over Arrow batches.

Each rule's cost and rejection rate are measured on a sample; rules then run in
order of rejections per cost, and a document that one rejects is not looked at
by the next. Rules are pure functions of the text, so the order never changes a
verdict, only what it costs.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, type_of
from .textscan import SpanHasher, Words, join_hashes, per_doc, pieces, window_hashes

#: The symbols that are counted, as in the contract.
SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
MAX_SYMBOLS_PER_WORD = 0.2
MAX_UPPER_SHARE = 0.6
MAX_DUP_LINE_SHARE = 0.5
MIN_LINES = 4
WORD_LENGTHS = (2.0, 14.0)
MIN_LETTER_SHARE = 0.4


def _table(members: bytes | range) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(members)] = True
    return out


_SYMBOL = _table(SYMBOLS)
_UPPER = _table(range(65, 91))
_LOWER = _table(range(97, 123))
_NON_ASCII_START = _table(range(0xC0, 0x100))
_CONTINUES = _table(range(0x80, 0xC0))


class TextBlock:
    """Whole texts of some documents; features are computed once, when first asked for."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets, self._known = data, offsets, {}

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def take(self, rows: np.ndarray) -> TextBlock:
        sizes = (self.offsets[1:] - self.offsets[:-1])[rows]
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        index = np.repeat(self.offsets[:-1][rows] - offsets[:-1], sizes) + np.arange(offsets[-1])
        block = TextBlock(self.data[index], offsets)
        block._known = {k: v[rows] for k, v in self._known.items() if isinstance(v, np.ndarray) and len(v) == len(self)}
        return block

    def get(self, name: str):
        if name not in self._known:
            self._known[name] = getattr(self, f"_{name}")()
        return self._known[name]

    def _words(self):
        return Words(self.data, self.offsets)

    def _hasher(self):
        return SpanHasher(self.data)

    def _n_words(self):
        return self.get("words").count

    def _word_chars(self):
        return per_doc(self.get("words").inside & ~_CONTINUES[self.data], self.offsets)

    def _n_symbols(self):
        return per_doc(_SYMBOL[self.data], self.offsets)

    def _n_upper(self):
        return per_doc(_UPPER[self.data], self.offsets)

    def _n_letters(self):
        return per_doc(_UPPER[self.data] | _LOWER[self.data] | _NON_ASCII_START[self.data], self.offsets)

    def _distinct(self, doc: np.ndarray, values: np.ndarray):
        """Group values of the same document: (inverse, counts, first document of each group)."""
        keys = join_hashes(values, doc.astype(np.uint64))
        _, first, inverse, counts = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
        return inverse, counts, doc[first]

    def _line_counts(self):
        """(lines with a word, those equal to an earlier one)."""
        n = len(self)
        if not len(self.data):
            return np.zeros((n, 2), np.int64)
        breaks = np.flatnonzero(self.data == 10)
        starts = np.unique(np.concatenate([self.offsets[:-1], breaks + 1]))
        starts = starts[starts < len(self.data)]
        doc = np.searchsorted(self.offsets, starts, "right") - 1
        ends = np.minimum(self.offsets[doc + 1], np.append(breaks, len(self.data))[np.searchsorted(breaks, starts)])
        wordy = np.concatenate([[0], np.cumsum(self.get("words").inside)])
        some = wordy[ends] > wordy[starts]
        starts, ends, doc = starts[some], ends[some], doc[some]
        _, _, owner = self._distinct(doc, self.get("hasher")(starts, ends))
        lines = np.bincount(doc, minlength=n)
        return np.stack([lines, lines - np.bincount(owner, minlength=n)], 1)

    def _n_dup_lines(self):
        return self.get("line_counts")[:, 1]

    def _n_repeat_words(self):
        words = self.get("words")
        single = self.get("hasher")(words.start, words.end)
        runs = window_hashes(single, 5)
        inside = np.flatnonzero(words.doc[: len(runs)] == words.doc[len(single) - len(runs) :])
        if not len(inside):
            return np.zeros(len(self), np.int64)
        inverse, counts, _ = self._distinct(words.doc[inside], runs[inside])
        twice = inside[counts[inverse] > 1]
        edge = np.zeros(len(single) + 6, np.int64)
        np.add.at(edge, twice, 1)
        np.add.at(edge, twice + 5, -1)
        covered = np.cumsum(edge[: len(single)]) > 0
        return np.bincount(words.doc[covered], minlength=len(self)).astype(np.int64)


@dataclass(frozen=True)
class Rule:
    """``rejects`` maps a block to one boolean per document."""

    name: str
    rejects: Callable[[TextBlock], np.ndarray]


def _too_short(b):
    return b.get("n_words") < MIN_WORDS


def _too_repetitive(b):
    return 100 * b.get("n_repeat_words") > MAX_REPEAT_PERCENT * b.get("n_words")


def _too_many_symbols(b):
    return b.get("n_symbols") > MAX_SYMBOLS_PER_WORD * b.get("n_words")


def _shouting(b):
    return b.get("n_upper") > MAX_UPPER_SHARE * b.get("n_letters")


def _repeated_lines(b):
    lines = b.get("line_counts")
    return (lines[:, 0] >= MIN_LINES) & (lines[:, 1] > MAX_DUP_LINE_SHARE * lines[:, 0])


def _odd_words(b):
    chars, n = b.get("word_chars"), b.get("n_words")
    return (chars < WORD_LENGTHS[0] * n) | (chars > WORD_LENGTHS[1] * n)


def _few_letters(b):
    return b.get("n_letters") < MIN_LETTER_SHARE * b.get("word_chars")


BASE_RULES = (Rule("too_short", _too_short), Rule("too_repetitive", _too_repetitive))
EXTRA_RULES = (
    Rule("too_many_symbols", _too_many_symbols),
    Rule("shouting", _shouting),
    Rule("repeated_lines", _repeated_lines),
    Rule("odd_words", _odd_words),
    Rule("few_letters", _few_letters),
)


class Cascade:
    """Rules in a measured order."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules

    def ordered_by(self, sample: list[str | None]) -> Cascade:
        """Order the rules by rejections per second on ``sample``, each on untouched texts."""
        if not sample:
            return self
        data = pa.array(sample, pa.string())
        worth = {}
        for rule in self.rules:
            began, gone = time.perf_counter(), 0
            for _, _, raw, offsets in pieces(data):
                gone += int(rule.rejects(TextBlock(raw, offsets)).sum())
            worth[rule.name] = (gone / len(sample) + 1e-6) / max(1e-9, time.perf_counter() - began)
        return Cascade(tuple(sorted(self.rules, key=lambda r: (-worth[r.name], r.name))))

    def rejected(self, block: TextBlock) -> np.ndarray:
        out = np.zeros(len(block), bool)
        rows, view = np.arange(len(block)), block
        for rule in self.rules:
            if not len(rows):
                break
            bad = rule.rejects(view)
            out[rows[bad]] = True
            if bad.any():
                left = np.flatnonzero(~bad)
                rows, view = rows[left], view.take(left)
        return out


def sample_texts(docs: DataFrame, text_col: str, rows: int = 500, seed: int = 7) -> list[str | None]:
    """At most ``rows`` texts, spread over the table, to measure rules on."""
    n = docs.count()
    if not n:
        return []
    return [r[0] for r in docs.select(text_col).sample(min(1.0, 1.5 * rows / n), seed).limit(rows).collect()]


def measured_cascade(docs: DataFrame, text_col: str, rules: tuple[Rule, ...], sample_rows: int = 500) -> Cascade:
    return Cascade(rules).ordered_by(sample_texts(docs, text_col, sample_rows))


#: Counts that ``assess`` returns, in order.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def assess(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = 500) -> DataFrame:
    """One row per input row: (id, COUNTS..., base_failed, kept).

    A null text has no word and fails the base rules (fewer than ten words, or
    over a fifth of the words inside five-word windows found twice). ``kept`` is
    false for these, else it is true unless one of EXTRA_RULES rejects the text.
    Repeated rows are judged alike; an empty table gives no rows; other columns
    are ignored.
    """
    cascade = measured_cascade(docs, text_col, EXTRA_RULES, sample_rows)

    def run(batches):
        for batch in batches:
            for low, high, data, offsets in pieces(batch.column(1)):
                block = TextBlock(data, offsets)
                counts = [block.get(c) for c in COUNTS]
                failed = BASE_RULES[0].rejects(block) | BASE_RULES[1].rejects(block)
                kept = ~failed
                left = np.flatnonzero(kept)
                kept[left[cascade.rejected(block.take(left))]] = False
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), *[pa.array(c.astype(np.int64)) for c in counts], pa.array(failed), pa.array(kept)], names=["id", *COUNTS, "base_failed", "kept"])

    schema = f"id {type_of(docs, id_col)}, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, kept boolean"
    return arrow_map(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), run, schema)


def keep_good(docs: DataFrame, text_col: str = "text", sample_rows: int = 500) -> DataFrame:
    """``docs`` without the rows that a base or extra rule rejects, columns unchanged."""
    cascade = measured_cascade(docs, text_col, BASE_RULES + EXTRA_RULES, sample_rows)
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            bad = [cascade.rejected(TextBlock(data, offsets)) for _, _, data, offsets in pieces(batch.column(at).cast(pa.string()))]
            yield batch.filter(pa.array(~np.concatenate(bad))) if bad else batch

    return arrow_map(docs, run, docs.schema)
