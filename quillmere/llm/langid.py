"""Language identification by interpolated Kneser-Ney character models.

Texts become runs of lower-case letters with single spaces between. One model per
language gives every character's probability after the three before it. All
models share sorted arrays of n-gram hashes with a column per language, so a
position needs one search however many languages there are.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, discard, materialise, type_of
from .textscan import mix

ORDER = 4
#: Characters of labelled text a language's model is fitted on, at most (whole documents).
SAMPLE_CHARS = 1_000_000
#: Every so many documents of the sample set the confidence and the rejection bound.
CALIBRATE_EVERY = 5
UNKNOWN = "und"
_PIECE = 1 << 20
_SPACE = 32
_maps: list[np.ndarray] = []


def _letter_map() -> np.ndarray:
    """Code point to lower-case letter, or to a space."""
    if not _maps:
        table = np.full(0x110000, _SPACE, np.uint32)
        for c in range(0x110000):
            ch = chr(c)
            if ch.isalpha():
                low = ch.lower()
                table[c] = ord(low[0])
        _maps.append(table)
    return _maps[0]


def letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(codes, owner): each text as a space and its letter runs, each followed by a space."""
    joined = "\0".join(["", *texts])
    raw = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    codes = _letter_map()[raw]
    first = np.zeros(len(raw), bool)
    first[np.cumsum(sizes) - sizes] = True
    last = np.zeros(len(raw), bool)
    last[np.cumsum(sizes) - 1] = True
    space = codes == _SPACE
    doubled = np.zeros(len(raw), bool)
    doubled[1:] = space[1:] & space[:-1]
    keep = ~doubled | first
    return codes[keep], owner[keep]


def _hashes(codes: np.ndarray, owner: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the n-gram that ends at each position, and whether the text has that many characters."""
    out = codes.astype(np.uint64)
    for k in range(1, order):
        shifted = np.zeros(len(codes), np.uint64)
        shifted[k:] = codes[:-k] if k < len(codes) else shifted[k:]
        out = out * np.uint64(0x100000001B3) + shifted
    whole = np.zeros(len(codes), bool)
    if order <= len(codes):
        whole[order - 1 :] = owner[order - 1 :] == owner[: len(owner) - order + 1]
    return mix(out + np.uint64(order * 0x9E3779B97F4A7C15 & (1 << 64) - 1)), whole


@dataclass
class Level:
    """Sorted hashes of n-grams, and natural logs by language."""

    keys: np.ndarray
    logs: np.ndarray

    def find(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.keys):
            return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return at, self.keys[at] == wanted


class Models:
    """Kneser-Ney models of some languages in common arrays."""

    def __init__(self, samples: dict[str, list[str]]):
        self.languages = sorted(samples)
        n = len(self.languages)
        grams = [[None] * n for _ in range(ORDER + 1)]
        for j, language in enumerate(self.languages):
            codes, owner = letters(samples[language])
            hashes = {o: _hashes(codes, owner, o) for o in range(1, ORDER + 1)}
            table = None
            for o in range(ORDER, 0, -1):
                gram, whole = hashes[o]
                if o == ORDER:
                    at = np.flatnonzero(whole)
                    keys, place, counts = np.unique(gram[at], return_index=True, return_counts=True)
                    place = at[place]
                else:  # how many characters the n-gram is seen after
                    keys, first, counts = np.unique(gram[table], return_index=True, return_counts=True)
                    place = table[first]
                table = place
                context = np.zeros(len(place), np.uint64) if o == 1 else hashes[o - 1][0][place - 1]
                lower = None if o == 1 else hashes[o - 1][0][place]
                grams[o][j] = (keys, counts.astype(np.float64), context, lower)
        size = max((len(g[0]) for g in grams[1] if g), default=1) + 1
        self.unseen = -float(np.log(size))
        self.levels: list[Level] = []
        self.backoffs: list[Level] = []
        below = None
        for o in range(1, ORDER + 1):
            parts, keys = grams[o], np.unique(np.concatenate([p[0] for p in grams[o]])) if n else np.empty(0, np.uint64)
            contexts = np.unique(np.concatenate([p[2] for p in parts])) if n else np.empty(0, np.uint64)
            probs, lams = np.zeros((len(keys), n)), np.ones((len(contexts), n))
            context_of, lower_of = np.zeros(len(keys), np.uint64), np.zeros(len(keys), np.uint64)
            for k, _, c, low in parts:
                at = np.searchsorted(keys, k)
                context_of[at] = c
                if low is not None:
                    lower_of[at] = low
            for j, (k, counts, c, _) in enumerate(parts):
                ones, twos = (counts == 1).sum(), (counts == 2).sum()
                d = ones / (ones + 2 * twos) if ones and twos else 0.5
                at = np.searchsorted(contexts, c)
                total = np.bincount(at, counts, len(contexts))
                kinds = np.bincount(at, minlength=len(contexts))
                seen = total > 0
                lams[seen, j] = d * kinds[seen] / total[seen]
                probs[np.searchsorted(keys, k), j] = np.maximum(counts - d, 0) / total[at]
            lam = lams[np.searchsorted(contexts, context_of)] if len(keys) else probs
            lowest = np.full_like(probs, 1.0 / size) if o == 1 else below[np.searchsorted(self.levels[-1].keys, lower_of)]
            probs = probs + lam * lowest
            below = probs
            self.levels.append(Level(keys, np.log(probs).astype(np.float32)))
            self.backoffs.append(Level(contexts, np.log(lams).astype(np.float32)))
        self.sharpness, self.bounds = 1.0, np.full(n, np.inf)

    def _logs(self, hashes, rows: np.ndarray, order: int) -> np.ndarray:
        gram, whole = hashes[order]
        out = np.empty((len(rows), len(self.languages)), np.float32)
        full = whole[rows]
        at, hit = self.levels[order - 1].find(gram[rows])
        hit &= full
        out[hit] = self.levels[order - 1].logs[at[hit]]
        missed = np.flatnonzero(~hit)
        if len(missed):
            if order == 1:
                at, known = self.backoffs[0].find(np.zeros(len(missed), np.uint64))
                out[missed] = self.unseen
                out[missed[known]] += self.backoffs[0].logs[at[known]]
            else:
                rest = rows[missed]
                lower = self._logs(hashes, rest, order - 1)
                at, known = self.backoffs[order - 1].find(hashes[order - 1][0][rest - 1])
                known &= full[missed]
                lower[known] += self.backoffs[order - 1].logs[at[known]]
                out[missed] = lower
        return out

    def cross_entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(nats per character by language, number of letters) of each text."""
        codes, owner = letters(texts)
        hashes = {o: _hashes(codes, owner, o) for o in range(1, ORDER + 1)}
        first = np.concatenate([[True], owner[1:] != owner[:-1]]) if len(owner) else np.zeros(0, bool)
        rows = np.flatnonzero(~first)  # the leading space is given
        logs = self._logs(hashes, rows, ORDER)
        size = np.bincount(owner[rows], minlength=len(texts))
        total = np.zeros((len(texts), len(self.languages)))
        some = np.flatnonzero(size)
        if len(some):
            total[some] = np.add.reduceat(logs, (np.cumsum(size) - size)[some], axis=0, dtype=np.float64)
        found = np.bincount(owner[codes != _SPACE], minlength=len(texts))
        return -total / np.maximum(size, 1)[:, None], found

    def shares(self, entropies: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Calibrated confidence: a softmax of entropies, sharper for longer texts."""
        scaled = -entropies * self.sharpness * np.sqrt(size)[:, None]
        scaled -= scaled.max(1, keepdims=True) if scaled.shape[1] else 0
        e = np.exp(scaled)
        return e / e.sum(1, keepdims=True)

    def calibrate(self, held: list[tuple[str, str]]) -> None:
        """Fit the sharpness to held-out texts, and the entropy above which a language is rejected."""
        held = [(lang, t) for lang, t in held if lang in self.languages]
        if not held:
            return
        entropies, size = self.cross_entropies([t for _, t in held])
        truth = np.array([self.languages.index(lang) for lang, _ in held])
        some = size > 0
        entropies, size, truth = entropies[some], size[some], truth[some]
        if not len(truth):
            return
        best = None
        for sharpness in (0.125, 0.25, 0.5, 1.0, 2.0, 4.0, 8.0):
            self.sharpness = sharpness
            loss = -np.log(np.maximum(self.shares(entropies, size)[np.arange(len(truth)), truth], 1e-9)).mean()
            if best is None or loss < best[0] - 1e-6:
                best = (loss, sharpness)
        self.sharpness = best[1]
        for j in range(len(self.languages)):
            own = entropies[truth == j, j]
            if len(own) >= 20:
                self.bounds[j] = np.quantile(own, 0.995) + 3 * own.std()

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """(language, score in [0, 1], nats per character, rejected) of each text."""
        names, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
        entropy, rejected = np.full(len(texts), np.nan), np.ones(len(texts), bool)
        if texts and self.languages:
            all_h, size = self.cross_entropies(texts)
            share = self.shares(all_h, size)
            pick = all_h.argmin(1)
            for i in np.flatnonzero(size):
                names[i] = self.languages[pick[i]]
            some = size > 0
            score[some] = share[np.arange(len(texts)), pick][some]
            entropy[some] = all_h[np.arange(len(texts)), pick][some]
            rejected[some] = entropy[some] > self.bounds[pick[some]]
        return names, score, entropy, rejected


def fit(labelled: DataFrame, text_col: str, lang_col: str, sample_chars: int = SAMPLE_CHARS, seed: int = 5, id_col: str | None = None) -> Models:
    """Models of every language in ``labelled``, from at most ``sample_chars`` of each.

    Documents are drawn by a seeded hash of their text and id so that a language's share
    comes to a little over the bound; of these the first by the hash go to the driver,
    until the bound is reached. All partitions are read side by side. A language of
    which nothing is drawn (few texts, very long or all of one id) learns from its
    text of least hash, so every language with text has a model.
    """
    rows = labelled.select(F.col(lang_col).alias("lang"), F.col(text_col).cast("string").alias("text"), (F.col(id_col) if id_col else F.lit(None)).cast("string").alias("id")).where("lang is not null and text is not null")
    place = F.xxhash64(F.lit(seed), "text", "id")
    first = F.min(F.when(F.length("text") > 0, place)).alias("first")
    sums = rows.groupBy("lang").agg(F.sum(F.length("text")).alias("chars"), first).collect()
    totals, firsts = {r.lang: r.chars for r in sums}, {r.lang: r.first for r in sums}
    share = {k: min(1.0, 1.2 * sample_chars / v) if v else 1.0 for k, v in totals.items()}
    if not share:
        return Models({})
    chance = F.pmod(place, F.lit(1 << 20)) / F.lit(float(1 << 20))
    wanted = F.create_map(*[F.lit(x) for k, v in sorted(share.items()) for x in (k, float(v))])
    train: dict[str, list[str]] = {k: [] for k in share}
    held: list[tuple[str, str]] = []
    drawn = materialise(rows.where(chance < F.element_at(wanted, F.col("lang"))).select("lang", "text", place.alias("place")), "sample")
    before = F.coalesce(F.sum(F.length("text")).over(Window.partitionBy("lang").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bounded = drawn.withColumn("before", before).where(F.col("before") < sample_chars)
    seen = dict.fromkeys(share, 0)
    for r in bounded.orderBy("lang", "place").collect():
        seen[r.lang] += 1
        if seen[r.lang] % CALIBRATE_EVERY == 0:
            held.append((r.lang, r.text))
        else:
            train[r.lang].append(r.text)
    discard(drawn)
    # A language of which nothing was drawn learns from its text of least hash.
    for lang in [k for k, v in train.items() if not v and firsts[k] is not None]:
        r = rows.where((F.col("lang") == lang) & (place == firsts[lang])).select(F.substring("text", 1, sample_chars).alias("text")).first()
        train[lang].append(r.text)
    models = Models({k: v for k, v in train.items() if v})
    models.calibrate(held)
    return models


def identify(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_chars: int = SAMPLE_CHARS) -> DataFrame:
    """One row per input row: (id, held_out, lang_pred, score, nats_per_char, rejected).

    Learns from the rows where ``learn`` is true and language and text are not
    null. The language of least cross-entropy per character is predicted, ties
    going to the first by name; ``und`` with score 0 where the text is null or has
    no letter, or nothing was learned. ``score`` is a calibrated confidence;
    ``rejected`` says that the text is unlike the predicted language's held-out
    texts. Repeated rows are predicted alike; an empty table gives no rows.
    """
    models = fit(docs.where(learn), text_col, lang_col, sample_chars, id_col=id_col)
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches):
        m = shared.value
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            out: list = [[], [], [], []]
            low = 0
            while low < len(texts):
                high, chars = low, 0
                while high < len(texts) and (high == low or chars + len(texts[high]) <= _PIECE):
                    chars += len(texts[high])
                    high += 1
                for o, x in zip(out, m.predict(texts[low:high]), strict=True):
                    o.extend(x)
                low = high
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(out[0], pa.string()), pa.array(out[1], pa.float64()), pa.array(out[2], pa.float64()), pa.array(out[3], pa.bool_())], names=["id", "held_out", "lang_pred", "score", "nats_per_char", "rejected"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), (~learn).alias("held_out"))
    return arrow_map(rows, run, f"id {type_of(docs, id_col)}, held_out boolean, lang_pred string, score double, nats_per_char double, rejected boolean")
