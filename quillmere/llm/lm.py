"""A log-bilinear neural language model, trained by noise-contrastive estimation.

The model predicts the class of the next token from the classes of the two
before it: frequent words are classes of their own, all other words share
classes by their ending. A word's probability is its class's, times its smoothed
share of the class. Training covers the whole corpus: the counts of all class
trigrams are gathered, dealt to shards, and every round trains the shards side
by side in numpy and averages them. Scores are exactly normalised: the logits of
the two context positions add up, so one matrix product of their exponentials
gives the normaliser of every context.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, discard, free_shuffles, materialise, type_of

#: The end of a text. No word equals it, as words have no white space.
END = b"\n"
#: Words that are no class of their own share one by their last bytes.
ENDING_BYTES = 2
#: Parameters in one row of a shard's result.
_CHUNK = 1 << 14


@dataclass(frozen=True)
class Settings:
    """Bounds of the model: it never grows with the corpus; the counts behind it do."""

    own_classes: int = 1024
    ending_classes: int = 512
    dimensions: int = 32
    rounds: int = 2
    #: Distinct trigrams in one shard, on average; more of them make more shards (``shards`` at least).
    shard_trigrams: int = 1_000_000
    shards: int = 4
    noise: int = 48
    minibatch: int = 1024
    rate: float = 0.15
    #: Words whose counts every task holds; the rest are looked up by a join.
    held_words: int = 200_000
    seed: int = 17


def ending_class(word: bytes, classes: int) -> int:
    return crc32(word[-ENDING_BYTES:]) % classes


class _Lookup(dict):
    """Word to number; words it lacks get one by their ending."""

    def __init__(self, known, offset: int, sign: int, classes: int):
        super().__init__(known)
        self.offset, self.sign, self.classes = offset, sign, classes

    def __missing__(self, word):
        return self.offset + self.sign * ending_class(word, self.classes)


def _tokens(column: pa.Array) -> tuple[list[bytes], np.ndarray]:
    """All tokens of a column of texts, ends included, and how many each text has."""
    out: list[bytes] = []
    sizes = []
    for text in column.cast(pa.binary()).to_pylist():
        before = len(out)
        if text:
            out += text.lower().split()
        out.append(END)
        sizes.append(len(out) - before)
    return out, np.array(sizes, np.int64)


def _numbers(lookup: dict, tokens: list[bytes]) -> np.ndarray:
    return np.fromiter(map(lookup.__getitem__, tokens), np.int32, len(tokens))


def _contexts(classes: np.ndarray, ends: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """Classes of the second-last and the last token before each; ``start`` before the first."""
    last = np.full(len(classes), start, np.int32)
    last[1:] = np.where(ends[:-1], start, classes[:-1])
    second = np.full(len(classes), start, np.int32)
    second[1:] = np.where(ends[:-1], start, last[:-1])
    return second, last


def count_words(texts: DataFrame, ending_classes: int) -> DataFrame:
    """(word, ending, c) of every distinct token of the column ``text``."""

    def flush(counts):
        words = list(counts)
        return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array([ending_class(w, ending_classes) for w in words], pa.int32()), pa.array(list(counts.values()), pa.int64())], names=["word", "ending", "c"])

    def run(batches):
        counts: Counter = Counter()
        for batch in batches:
            counts.update(_tokens(batch.column(0))[0])
            if len(counts) > 400_000:
                yield flush(counts)
                counts = Counter()
        yield flush(counts)

    return arrow_map(texts.select("text"), run, "word binary, ending int, c long").groupBy("word", "ending").agg(F.sum("c").alias("c"))


def count_trigrams(texts: DataFrame, lookup: _Lookup, end_class: int, outputs: int) -> DataFrame:
    """(code, n) of every distinct trigram of classes, over all of ``texts``."""
    base = outputs + 1

    def merged(parts):
        codes = np.concatenate([c for c, _ in parts])
        order = np.argsort(codes, kind="stable")
        codes, n = codes[order], np.concatenate([n for _, n in parts])[order]
        first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
        return codes[first], np.add.reduceat(n, first)

    def flush(parts):
        codes, n = merged(parts)
        return pa.RecordBatch.from_arrays([pa.array(codes), pa.array(n)], names=["code", "n"])

    def run(batches):
        parts: list = []
        for batch in batches:
            tokens, _ = _tokens(batch.column(0))
            if not tokens:
                continue
            classes = _numbers(lookup, tokens)
            second, last = _contexts(classes, classes == end_class, outputs)
            parts.append(np.unique((second.astype(np.int64) * base + last) * base + classes, return_counts=True))
            if len(parts) >= 16:
                parts = [merged(parts)]
                if len(parts[0][0]) > 1_500_000:
                    yield flush(parts)
                    parts = []
        if parts:
            yield flush(parts)

    return arrow_map(texts.select("text"), run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


@dataclass
class LogBilinear:
    """Context vectors, per-position weights, output vectors and biases."""

    context: np.ndarray
    weights: np.ndarray
    output: np.ndarray
    bias: np.ndarray

    @classmethod
    def fresh(cls, unigram: np.ndarray, dimensions: int, seed: int) -> LogBilinear:
        rng = np.random.default_rng(seed)
        outputs = len(unigram)
        same = np.stack([np.eye(dimensions, dtype=np.float32)] * 2)
        return cls(rng.normal(0, 0.1, (outputs + 1, dimensions)).astype(np.float32), same, rng.normal(0, 0.1, (outputs, dimensions)).astype(np.float32), np.log(unigram).astype(np.float32))

    def parts(self) -> list[np.ndarray]:
        return [self.context, self.weights, self.output, self.bias]

    def packed(self) -> bytes:
        return b"".join(p.astype("<f4").tobytes() for p in self.parts())

    def unpacked(self, raw: bytes) -> LogBilinear:
        flat, parts, at = np.frombuffer(raw, "<f4"), [], 0
        for p in self.parts():
            parts.append(flat[at : at + p.size].reshape(p.shape).copy())
            at += p.size
        return LogBilinear(*parts)

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Logits by either context position, and the log normaliser of every context."""
        one = self.context @ self.weights[0] @ self.output.T
        two = self.context @ self.weights[1] @ self.output.T + self.bias
        top_one, top_two = one.max(1), two.max(1)
        norm = np.exp(one - top_one[:, None]) @ np.exp(two - top_two[:, None]).T
        np.log(norm, out=norm)
        norm += top_one[:, None]
        norm += top_two
        return one, two, norm


def train_shard(model: LogBilinear, codes: np.ndarray, n: np.ndarray, unigram: np.ndarray, settings: Settings, seed: int) -> LogBilinear:
    """One pass of noise-contrastive estimation over counted trigrams (Adagrad).

    Every trigram is visited; one counted c times pulls with weight c, spread
    over up to 64 visits. Noise words come from the unigram and are shared by a
    minibatch.
    """
    rng = np.random.default_rng(seed)
    base = len(unigram) + 1
    mean = n.mean()
    visits = np.clip(np.ceil(n / mean), 1, 64).astype(np.int64)
    rows = np.repeat(np.arange(len(n)), visits)
    rng.shuffle(rows)
    weight = (n / visits / mean).astype(np.float32)
    k = settings.noise
    log_kp = np.log(k * unigram).astype(np.float32)
    steps = np.cumsum(unigram)
    parts = model.parts()
    squares = [np.full(p.shape, 1e-3, np.float32) for p in parts]
    context, weights, output, bias = parts

    def descend(part: int, index: np.ndarray, values: np.ndarray) -> None:
        """Step down the gradient of some rows, those of equal index summed first."""
        order = np.argsort(index, kind="stable")
        index = index[order]
        first = np.flatnonzero(np.concatenate([[True], index[1:] != index[:-1]]))
        at, g = index[first], np.add.reduceat(values[order], first, axis=0)
        square = squares[part][at] + g * g
        squares[part][at] = square
        parts[part][at] -= settings.rate * g / np.sqrt(square)

    for low in range(0, len(rows), settings.minibatch):
        at = rows[low : low + settings.minibatch]
        code, w = codes[at], weight[at] / len(at)
        target, last, second = code % base, code // base % base, code // base // base
        c1, c2 = context[second], context[last]
        predicted = c1 @ weights[0] + c2 @ weights[1]
        noise = np.minimum(np.searchsorted(steps, rng.random(k) * steps[-1]), len(unigram) - 1)
        out, noise_out = output[target], output[noise]
        real = np.einsum("ij,ij->i", predicted, out) + bias[target] - log_kp[target]
        fake = predicted @ noise_out.T + (bias[noise] - log_kp[noise])
        g_real = -w / (1 + np.exp(np.clip(real, -30, 30)))
        g_fake = w[:, None] / (1 + np.exp(np.clip(-fake, -30, 30)))
        g_pred = g_real[:, None] * out + g_fake @ noise_out
        g_weights = np.stack([c1.T @ g_pred, c2.T @ g_pred])
        descend(0, np.concatenate([second, last]), np.concatenate([g_pred @ weights[0].T, g_pred @ weights[1].T]))
        seen = np.concatenate([target, noise])
        descend(2, seen, np.concatenate([g_real[:, None] * predicted, g_fake.T @ predicted]))
        descend(3, seen, np.concatenate([g_real, g_fake.sum(0)]))
        squares[1] += g_weights * g_weights
        weights -= settings.rate * g_weights / np.sqrt(squares[1])
    return model


def train(trigrams: DataFrame, unigram: np.ndarray, settings: Settings) -> LogBilinear:
    """Rounds of training by shard and averaging, over the whole table of counts."""
    model = LogBilinear.fresh(unigram, settings.dimensions, settings.seed)
    count = max(settings.shards, -(-trigrams.count() // settings.shard_trigrams))
    for turn in range(settings.rounds):
        packed, shape = model.packed(), model

        def run(batches, packed=packed, shape=shape, turn=turn):
            got = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
            if not got:
                return
            codes, n = np.concatenate([c for c, _ in got]), np.concatenate([n for _, n in got])
            order = np.argsort(codes)
            trained = np.frombuffer(train_shard(shape.unpacked(packed), codes[order], n[order], unigram, settings, settings.seed * 1000 + turn).packed(), "<f4")
            own = float(n.sum())
            chunks = [(trained[low : low + _CHUNK] * own).astype("<f8").tobytes() for low in range(0, len(trained), _CHUNK)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(chunks)), pa.int32()), pa.array([own] * len(chunks)), pa.array(chunks, pa.binary())], names=["chunk", "weight", "summed"])

        def add(batches):
            sums: dict = {}
            for b in batches:
                for chunk, own, raw in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    before = sums.get(chunk, (0.0, 0.0))
                    sums[chunk] = before[0] + own, before[1] + np.frombuffer(raw, "<f8")
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([w for w, _ in sums.values()], pa.float64()), pa.array([x.tobytes() for _, x in sums.values()], pa.binary())], names=["chunk", "weight", "summed"])

        # The shards' models are averaged chunk by chunk, so the driver gets one model, however many there are.
        rows = "chunk int, weight double, summed binary"
        shards = arrow_map(trigrams.repartition(count, "code"), run, rows)
        mean = sorted(arrow_map(shards.repartition("chunk"), add, rows).toArrow().to_pylist(), key=lambda r: r["chunk"])
        if not mean:
            break
        model = model.unpacked(np.concatenate([np.frombuffer(r["summed"], "<f8") / r["weight"] for r in mean]).astype("<f4").tobytes())
    return model


def most_frequent(counts: DataFrame, most: int) -> DataFrame:
    """The words of the highest counts, ``most`` of them at most; cut between sixteenths of a doubling."""
    step = F.floor(F.log2("c") * 16)
    total, least = 0, None
    for low, n in sorted(counts.groupBy(step).agg(F.count(F.lit(1))).collect(), reverse=True):
        total += n
        if total > most:
            break
        least = low
    return counts.where(F.lit(False) if least is None else step >= least)


@dataclass
class Trained:
    """All that scoring needs; every part is bounded by the settings."""

    settings: Settings
    tokens: int
    distinct: int
    held: dict
    held_class: np.ndarray
    held_log: np.ndarray
    own: int
    class_log: np.ndarray
    model: LogBilinear
    _tables: tuple = field(repr=False, default=())

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The model's tables, made once per process: the vectors alone are sent to it."""
        if not self._tables:
            self._tables = self.model.tables()
        return self._tables


def fit(texts: DataFrame, counts: DataFrame, settings: Settings) -> Trained:
    """Train on the column ``text`` of all rows; ``counts`` is its materialised word table."""
    totals = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    top = most_frequent(counts, settings.held_words).select("word", "c").toArrow()
    by_count = sorted(zip(top["c"].to_pylist(), top["word"].to_pylist(), strict=True), key=lambda x: (-x[0], x[1]))
    words, c = [w for _, w in by_count], np.array([n for n, _ in by_count], np.int64)
    own_words = words[: settings.own_classes]
    if END not in own_words:
        own_words = [*own_words[: settings.own_classes - 1], END]
    own = {w: i for i, w in enumerate(own_words)}
    outputs = len(own) + settings.ending_classes
    by_word = dict(zip(words, c.tolist(), strict=True))
    mass = np.zeros(outputs)
    kinds = np.zeros(settings.ending_classes)
    for ending, n, v in counts.groupBy("ending").agg(F.sum("c"), F.count(F.lit(1))).collect():
        mass[len(own) + ending], kinds[ending] = n, v
    for w, i in own.items():
        mass[i] = by_word.get(w, 0)
        if w in by_word:
            e = ending_class(w, settings.ending_classes)
            mass[len(own) + e] -= mass[i]
            kinds[e] -= 1
    unigram = (mass + 0.5) / (mass + 0.5).sum()
    lookup = _Lookup(own, len(own), 1, settings.ending_classes)
    trigrams = materialise(count_trigrams(texts, lookup, own[END], outputs), "trigrams")
    model = train(trigrams, unigram.astype(np.float64), settings)
    discard(trigrams)
    held_class = np.array([own.get(w, len(own) + ending_class(w, settings.ending_classes)) for w in words], np.int32)
    held = {w: i for i, w in enumerate(words)}
    if END not in held:
        held[END] = len(held_class)
        held_class, c = np.append(held_class, np.int32(own[END])), np.append(c, 0)
    return Trained(settings, int(totals.n), int(totals.v), held, held_class, np.log10(c + 1.0), len(own), np.log10(mass[len(own) :] + kinds + 1), model)


def score_texts(docs: DataFrame, train_on, id_col: str = "doc_id", text_col: str = "text", settings: Settings | None = None) -> DataFrame:
    """One row per input row: (id, held_out, n_tokens, n_known, train_tokens, base_score, score).

    Learns from the rows where the Column ``train_on`` is true, scores all. Texts
    are lower-cased (A-Z), split at ASCII white space, and end with one end token;
    null counts as empty. ``base_score`` is the add-one unigram's log10
    probability, ``score`` the model's. Repeated rows get equal scores. With no
    training row both assign log10(1) to words by count and the model is uniform;
    an empty table gives no rows; other columns are ignored.
    """
    settings = settings or Settings()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), train_on.alias("learn"))
    texts = rows.where("learn").select("text")
    counts = materialise(count_words(texts, settings.ending_classes), "words")
    trained = fit(texts, counts, settings)
    free_shuffles(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(trained)
    id_type = type_of(docs, id_col)

    def run(batches):
        t = shared.value
        classes_n = t.settings.ending_classes
        lookup = _Lookup(t.held, -1, -1, classes_n)
        one, two, norm = t.tables()
        start = one.shape[0] - 1
        for batch in batches:
            if not batch.num_rows:
                continue
            tokens, sizes = _tokens(batch.column(1))
            number = _numbers(lookup, tokens)
            first = np.cumsum(sizes) - sizes
            ends = np.zeros(len(tokens), bool)
            ends[first + sizes - 1] = True
            rare = number < 0
            classes = np.where(rare, t.own - 1 - number, t.held_class[np.maximum(number, 0)])
            second, last = _contexts(classes, ends, start)
            nats = one[second, classes] + two[last, classes] - norm[second, last]
            log_count = np.where(rare, 0.0, t.held_log[np.maximum(number, 0)])
            shared_class = classes >= t.own
            log10 = nats / np.log(10.0) + np.where(shared_class, log_count - t.class_log[np.maximum(classes - t.own, 0)], 0.0)
            add = lambda x: np.add.reduceat(x, first)
            doc = np.repeat(np.arange(len(sizes)), sizes)
            seen = Counter(zip(doc[rare].tolist(), [tokens[i] for i in np.flatnonzero(rare).tolist()], strict=True))
            hashes = np.array([xxhash.xxh3_64_intdigest(x) for x in batch.column(1).cast(pa.binary()).to_pylist()], np.uint64).view(np.int64)
            # A text's own row meets no word: its key has white space and differs by text.
            keys = [END + h.tobytes() for h in hashes] + [w for _, w in seen]
            at = np.concatenate([np.arange(len(sizes)), np.array([d for d, _ in seen], np.int64)])
            more = len(seen)

            def column(values, kind, more=more):
                return pa.concat_arrays([pa.array(values, kind), pa.nulls(more, kind)])

            known = (~rare) & (log_count > 0)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(at)),
                    pa.array(hashes[at]),
                    pa.array(keys, pa.binary()),
                    pa.concat_arrays([pa.nulls(len(sizes), pa.int64()), pa.array(list(seen.values()), pa.int64())]),
                    pa.concat_arrays([batch.column(2), pa.nulls(more, pa.bool_())]),
                    column(sizes, pa.int64()),
                    column(add(known.astype(np.int64)), pa.int64()),
                    column(add(log_count), pa.float64()),
                    column(add(log10), pa.float64()),
                ],
                names=["id", "th", "word", "tf", "learn", "n_tokens", "n_known", "base", "model"],
            )

    parts = arrow_map(rows, run, f"id {id_type}, th long, word binary, tf long, learn boolean, n_tokens long, n_known long, base double, model double")
    joined = parts.join(counts.select("word", "c"), "word", "left")
    rare_log = F.coalesce(F.sum(F.col("tf") * F.log10(F.coalesce("c", F.lit(0)) + F.lit(1.0))), F.lit(0.0))
    times = F.count("n_tokens")
    summed = joined.groupBy("id", "th").agg(
        times.alias("times"),
        F.max("learn").alias("learn"),
        F.max("n_tokens").alias("n_tokens"),
        ((F.sum("n_known") + F.coalesce(F.sum(F.when(F.col("c") > 0, F.col("tf"))), F.lit(0))) / times).cast("long").alias("n_known"),
        ((F.sum("base") + rare_log) / times).alias("base"),
        ((F.sum("model") + rare_log) / times).alias("model"),
    )
    one_log = float(np.log10(trained.tokens + trained.distinct + 1))
    return summed.select(
        "id",
        (~F.col("learn")).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(trained.tokens).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * F.lit(one_log)).alias("base_score"),
        F.col("model").alias("score"),
        F.explode(F.sequence(F.lit(1).cast("long"), "times")).alias("copy"),
    ).drop("copy")
