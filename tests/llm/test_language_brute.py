"""Language identification beside Kneser-Ney models written from the definition."""

import math
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quillmere.llm import langid
from quillmere.llm import queries as q


def shown(text):
    """A space, then runs of lower-case letters with single spaces between."""
    return re.sub(" +", " ", " " + "".join(c.lower()[0] if c.isalpha() else " " for c in text or ""))


class Plain:
    """Interpolated Kneser-Ney of one language; order four counts n-grams, lower ones what they follow."""

    def __init__(self, texts):
        self.counts = [None] * 5
        self.counts[4] = Counter(s[i : i + 4] for s in map(shown, texts) for i in range(len(s) - 3))
        for o in (3, 2, 1):
            self.counts[o] = Counter(g[1:] for g in self.counts[o + 1])
        self.discount, self.total, self.kinds = [None] * 5, [None] * 5, [None] * 5
        for o in range(1, 5):
            ones, twos = (sum(c == n for c in self.counts[o].values()) for n in (1, 2))
            self.discount[o] = ones / (ones + 2 * twos) if ones and twos else 0.5
            self.total[o], self.kinds[o] = defaultdict(int), defaultdict(int)
            for g, c in self.counts[o].items():
                self.total[o][g[:-1]] += c
                self.kinds[o][g[:-1]] += 1
        self.known = {}

    def chance(self, gram, size):
        """Probability of the gram's last character after the others."""
        if gram in self.known:
            return self.known[gram]
        o = len(gram)
        below = self.chance(gram[1:], size) if o > 1 else 1 / size
        total = self.total[o].get(gram[:-1], 0)
        out = below
        if total:
            d = self.discount[o]
            out = max(self.counts[o].get(gram, 0) - d, 0) / total + d * self.kinds[o][gram[:-1]] / total * below
        self.known[gram] = out
        return out

    def nats(self, text, size):
        s = shown(text)
        return -sum(math.log(self.chance(s[max(0, i - 3) : i + 1], size)) for i in range(1, len(s))) / max(1, len(s) - 1)


def test_predictions_beside_the_definition(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", F.xxhash64(F.lit(5), "text", F.col("doc_id").cast("string")).alias("place")).collect()
    learnt = defaultdict(list)
    for r in sorted(docs, key=lambda r: r.place):
        if zlib.crc32(str(r.doc_id).encode()) % 3 != 1 and r.lang is not None and r.text is not None:
            learnt[r.lang].append(r.text)
    assert all(sum(map(len, ts)) < langid.SAMPLE_CHARS for ts in learnt.values())  # so the sample is everything
    models = {k: Plain([t for i, t in enumerate(ts, 1) if i % langid.CALIBRATE_EVERY]) for k, ts in sorted(learnt.items())}
    size = max(len(m.counts[1]) for m in models.values()) + 1
    got = {r.doc_id: r for r in q.op6_language_id(spark, sf_dir).collect()}
    assert len(got) == len(docs)
    for r in docs:
        found = got[r.doc_id]
        if not shown(r.text).strip():
            assert (found.lang_pred, found.score) == ("und", 0.0)
            continue
        nats = {k: m.nats(r.text, size) for k, m in models.items()}
        best = min(nats.values())
        assert found.nats_per_char == pytest.approx(best, rel=1e-4)
        assert nats[found.lang_pred] == pytest.approx(best, rel=1e-5)
        assert 1 / len(models) - 1e-9 <= found.score <= 1


def test_the_sum_over_an_alphabet_is_one():
    model = Plain(["abc abd abe", "bab dab", "cab bad, cad"])
    letters = sorted(model.counts[1])
    size = len(letters)
    for context in ("abc", "ba", "", " ca", "zzz", "dz"):
        assert sum(model.chance(context[-3:] + c, size) for c in letters) == pytest.approx(1)
        model.known.clear()
