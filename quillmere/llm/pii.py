"""Personal data by weak supervision, in Spark SQL expressions alone.

Strict patterns give the base spans, which always stay. Looser patterns propose
more. Labelers (pattern, structure, gazetteer, context, boundary) vote on every
span; expectation-maximisation over the counts of vote patterns of the whole
table estimates how reliable each labeler is, and its posteriors train a logistic
span classifier that decides the proposals. Only the bounded table of vote
pattern counts reaches the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import bind, cut, fold, running

KINDS = ("email", "ip", "card", "phone", "secret")
BASE_KINDS = KINDS[:4]
LABELERS = ("pattern", "structure", "gazetteer", "context", "boundary")
VOTES = (-1, 0, 1)
#: A proposal is accepted from this probability on.
ACCEPT = 0.9

# The contract's patterns, written so that Java's matcher takes linear time and no deep
# recursion: a match can begin only where a run begins or the match before ended. Runs of
# under 13 digits can be no card, base or proposed, so they are not matched at all.
_LOCAL = "[A-Za-z0-9._%+-]"
BASE_PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){12,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE_PATTERNS = {
    "email": rf"(?<!{_LOCAL}){_LOCAL}++ ?[(\[]at[)\]] ?[A-Za-z0-9-]++(?: ?(?:\.|[(\[]dot[)\]]) ?[A-Za-z0-9-]++)++",
    "phone": r"(?<![0-9+().-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
    "secret": r"(?<![A-Za-z0-9_/+-])[A-Za-z0-9_/+-]{20,}(?![A-Za-z0-9_/+-])",
}
#: What a text must hold before a pattern is tried on it.
NEEDS = {"email": "@", "ip": ".", "phone": "+"}
#: Gazetteer of top-level domains.
TOP_LEVEL = "com org net edu gov mil int info biz io co ai app dev me tv uk us ca au de fr es it nl be ch at se no dk fi pl pt br mx ar jp cn in kr ru za nz ie eu test example local".split()
#: Words before a span that speak for its kind, and words that speak against any.
CONTEXT_FOR = {
    "email": "mail contact write reach address correo courriel kontakt",
    "ip": "ip host server address client login connect",
    "card": "card visa mastercard amex credit debit payment karte carte tarjeta",
    "phone": "phone tel call mobile cell fax contact number telefon téléphone teléfono",
    "secret": "token secret key password passwd pwd credential auth bearer api",
}
CONTEXT_AGAINST = "isbn issn doi order invoice version page chapter serial sha commit checksum digest"


def _empty(kind: str) -> Column:
    return F.expr(f"cast(array() as array<{kind}>)")


def _located(df: DataFrame, text: str, name: str, pattern: str, needs: Column) -> DataFrame:
    """Add array<struct<start, end, value>> of the leftmost non-overlapping matches, in code points.

    The pieces between matches and the matches alternate, so their running
    lengths are the offsets.
    """
    values, gaps = f"{name}_values", f"{name}_gaps"
    df = df.withColumn(values, F.when(needs, F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))).otherwise(_empty("string")))
    df = df.withColumn(gaps, F.when(F.size(values) > 0, F.slice(F.split(F.col(text), pattern, -1), F.lit(1), F.size(values))).otherwise(_empty("string")))
    start = F.expr("named_struct('at', 0, 'spans', cast(array() as array<struct<start:int,end:int,value:string>>))")

    def step(a: Column, x: Column) -> Column:
        begin = a["at"] + x["gap"]
        end = begin + F.length(x["value"])
        return F.struct(end.alias("at"), F.concat(a["spans"], F.array(F.struct(begin.alias("start"), end.alias("end"), x["value"].alias("value")))).alias("spans"))

    pairs = F.zip_with(gaps, values, lambda g, v: F.struct(F.length(g).alias("gap"), v.alias("value")))
    spans = F.when(F.size(values) > 0, F.aggregate(pairs, start, step)["spans"]).otherwise(_empty("struct<start:int,end:int,value:string>"))
    return df.withColumn(name, spans).drop(values, gaps)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def add(total: Column, i: Column) -> Column:
        x = F.substring(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, x).when(x > 4, 2 * x - 9).otherwise(2 * x)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def octets(value: Column) -> Column:
    """Whether all parts are at most 255."""

    def fits(part: Column) -> Column:
        plain = F.regexp_replace(part, "^0+", "")
        return F.when(F.length(plain) <= 3, F.coalesce(plain.try_cast("int"), F.lit(0)) <= 255).otherwise(F.lit(False))

    return F.forall(F.split(value, r"\."), fits)


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return octets(value)
    if kind == "card":
        return F.when(F.length(_digits(value)).between(16, 19), luhn(_digits(value))).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(value)).between(8, 15)
    return F.lit(True)


def _checked(kind: str):
    return lambda s: _valid(kind, s["value"])


def _sign(yes: Column, no: Column | None = None) -> Column:
    out = F.when(yes, F.lit(1))
    return (out.otherwise(F.lit(-1)) if no is None else out.when(no, F.lit(-1)).otherwise(F.lit(0))).cast("int")


def _votes(kind: str, base: bool, text: Column, s: Column) -> list[Column]:
    """One vote of each labeler on a span of known kind."""
    value, digits = s["value"], _digits(s["value"])
    structure = {
        "email": F.lit(1).cast("int"),
        "ip": _sign(octets(value)),
        "card": _sign(_valid("card", value)),
        "phone": _sign(F.length(digits).between(8, 15)),
        "secret": _sign(value.rlike("[0-9]") & value.rlike("[A-Za-z]"), ~value.rlike("[0-9]")),
    }[kind]
    gazetteer = {
        "email": _sign(F.lower(F.regexp_extract(value, r"([A-Za-z0-9-]+)$", 1)).isin(TOP_LEVEL)),
        "ip": _sign(~value.rlike(r"^0"), value.rlike(r"^0\.")),
        "card": _sign(digits.rlike("^[3-6]"), F.lit(True)),
        "phone": _sign(digits.rlike("^1?[2-9]|^[2-9]"), F.length(digits) > 15),
        "secret": _sign(F.size(F.array_distinct(F.split(value, ""))) >= 10),
    }[kind]
    near = F.lower(F.substring(text, F.greatest(s["start"] - 40, F.lit(0)) + 1, F.least(s["start"], F.lit(40))))
    context = _sign(near.rlike("|".join(CONTEXT_FOR[kind].split())), near.rlike(r"\b(?:" + "|".join(CONTEXT_AGAINST.split()) + r")\b"))
    sides = F.concat(F.when(s["start"] > 0, F.substring(text, s["start"], F.lit(1))).otherwise(F.lit("")), F.substring(text, s["end"] + 1, F.lit(1)))
    boundary = _sign(~sides.rlike(r"[\p{L}0-9]"))
    return [F.lit(1 if base else 0).cast("int"), structure, gazetteer, context, boundary]


def _candidates(df: DataFrame, text: str) -> DataFrame:
    """Add ``base_<kind>`` spans and ``proposed``, the array of all voted spans."""
    has_digit = F.col(text).rlike("[0-9]")
    needs = {k: (F.contains(F.col(text), F.lit(NEEDS[k])) if k in NEEDS else F.lit(True)) & (has_digit if k != "email" else F.lit(True)) for k in BASE_KINDS}
    for kind in BASE_KINDS:
        df = _located(df, text, f"raw_{kind}", BASE_PATTERNS[kind], needs[kind])
        df = df.withColumn(f"base_{kind}", F.filter(f"raw_{kind}", _checked(kind)))
    df = _located(df, text, "loose_email", LOOSE_PATTERNS["email"], F.col(text).rlike(r"[(\[]at[)\]]"))
    df = _located(df, text, "loose_phone", LOOSE_PATTERNS["phone"], has_digit)
    df = _located(df, text, "loose_secret", LOOSE_PATTERNS["secret"], has_digit)
    df = df.withColumn("loose_card", F.filter("raw_card", lambda s: F.length(_digits(s["value"])).between(13, 19) & ~_valid("card", s["value"])))

    def voted(name: str, kind: str, base: bool) -> Column:
        def one(s: Column) -> Column:
            votes = [v.alias(n) for v, n in zip(_votes(kind, base, F.col(text), s), LABELERS, strict=True)]
            size = F.least(F.lit(3), F.floor((s["end"] - s["start"]) / 12).cast("int"))
            return F.struct(F.lit(KINDS.index(kind)).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.lit(base).alias("base"), size.alias("size"), *votes)

        return F.transform(name, one)

    lists = [voted(f"base_{k}", k, True) for k in BASE_KINDS] + [voted(f"loose_{k}", k, False) for k in ("email", "card", "phone", "secret")]
    return df.withColumn("proposed", F.concat(*lists))


@dataclass
class SpanClassifier:
    """Weights of the logistic classifier, by feature; natural-log odds add up."""

    bias: float
    kind: np.ndarray
    votes: np.ndarray
    size: np.ndarray

    def odds(self, c: Column) -> Column:
        pick = lambda index, values: F.element_at(F.array(*[F.lit(float(v)) for v in values]), index.cast("int") + 1)
        out = F.lit(self.bias) + pick(c["kind"], self.kind) + pick(c["size"], self.size)
        for j, name in enumerate(LABELERS):
            out = out + pick(c[name] + 1, self.votes[j])
        return out


def estimate(patterns: list[tuple], rounds: int = 50) -> np.ndarray:
    """Posterior of every vote pattern (kind, size, votes..., n) by expectation-maximisation.

    Each kind has its prior and, per labeler, the chance of each vote on real and
    on false spans. The start is the share of positive votes; counts are smoothed.
    """
    rows = np.array([p[:-1] for p in patterns], np.int64).reshape(len(patterns), 2 + len(LABELERS))
    n = np.array([p[-1] for p in patterns], float)
    votes = rows[:, 2:] + 1
    posterior = np.clip((rows[:, 2:].sum(1) + len(LABELERS)) / (2 * len(LABELERS)), 0.05, 0.95)
    for kind in np.unique(rows[:, 0]) if len(rows) else ():
        own = rows[:, 0] == kind
        p, v, w = posterior[own], votes[own], n[own]
        for _ in range(rounds):
            prior = ((w * p).sum() + 1) / (w.sum() + 2)
            real, false = np.empty((len(LABELERS), 3)), np.empty((len(LABELERS), 3))
            for j in range(len(LABELERS)):
                for value in range(3):
                    is_it = v[:, j] == value
                    # Labelers are taken to be better than chance: a weak prior says so.
                    real[j, value] = (w * p)[is_it].sum() + (0.5, 1.0, 2.0)[value]
                    false[j, value] = (w * (1 - p))[is_it].sum() + (2.0, 1.0, 0.5)[value]
            real /= real.sum(1, keepdims=True)
            false /= false.sum(1, keepdims=True)
            each = np.arange(len(LABELERS))
            odds = np.log(prior / (1 - prior)) + (np.log(real)[each, v] - np.log(false)[each, v]).sum(1)
            p = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        posterior[own] = p
    return posterior


def train_classifier(patterns: list[tuple], posterior: np.ndarray, steps: int = 400, rate: float = 0.5, shrink: float = 1e-3) -> SpanClassifier:
    """Logistic regression on kind, size and votes, fitted to the posteriors."""
    width = len(KINDS) + 4 + 3 * len(LABELERS)
    x, n = np.zeros((len(patterns), width)), np.ones(len(patterns))
    for i, (kind, size, *votes, count) in enumerate(patterns):
        x[i, kind] = x[i, len(KINDS) + size] = 1
        for j, v in enumerate(votes):
            x[i, len(KINDS) + 4 + 3 * j + v + 1] = 1
        n[i] = np.log1p(count)
    w, b, total = np.zeros(width), 0.0, n.sum() or 1.0
    for _ in range(steps if len(patterns) else 0):
        p = 1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30)))
        g = n * (p - posterior) / total
        w -= rate * (x.T @ g * width / 4 + shrink * w)
        b -= rate * g.sum()
    return SpanClassifier(float(b), w[: len(KINDS)], w[len(KINDS) + 4 :].reshape(len(LABELERS), 3), w[len(KINDS) : len(KINDS) + 4])


def fit(docs: DataFrame, text_col: str) -> SpanClassifier:
    """Train on the vote patterns of every document."""
    named = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    spans = _candidates(named, "text").select(F.explode("proposed").alias("s"))
    fields = ["kind", "size", *LABELERS]
    counts = spans.groupBy(*[F.col(f"s.{f}").alias(f) for f in fields]).agg(F.count(F.lit(1)).alias("n"))
    patterns = sorted(tuple(r) for r in counts.collect())
    return train_classifier(patterns, estimate(patterns))


_SPAN = "struct<kind:int,start:int,end:int>"


def _with_spans(df: DataFrame, text: str, classifier: SpanClassifier) -> DataFrame:
    """Add ``all_base`` and ``added``: arrays of (kind, start, end), by kind, then start."""
    df = _candidates(df, text)
    plain = lambda kind: lambda s: F.struct(F.lit(KINDS.index(kind)).alias("kind"), s["start"].alias("start"), s["end"].alias("end"))
    df = df.withColumn("all_base", F.concat(*[F.transform(f"base_{k}", plain(k)) for k in BASE_KINDS]))
    least = float(np.log(ACCEPT / (1 - ACCEPT)))
    good = F.filter("proposed", lambda c: ~c["base"] & (classifier.odds(c) >= least) & ~F.exists("all_base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
    by_start = F.array_sort(F.transform(good, lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind"))))

    def step(at: Column, s: Column) -> Column:
        span = F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))
        free = s["start"] >= at
        return F.struct(F.when(free, s["end"]).otherwise(at).alias("state"), F.when(free, F.array(span)).otherwise(_empty(_SPAN)).alias("out"))

    return df.withColumn("added", F.when(F.size("proposed") > F.size("all_base"), F.array_sort(bind(by_start, lambda spans: fold(spans, F.lit(0), step, _SPAN)))).otherwise(_empty(_SPAN)))


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: (id, base, spans), arrays of (kind, start, end), by kind, then start.

    ``base`` holds what the strict patterns find and check; ``spans`` these and the
    accepted proposals, which overlap no base span and one another neither. Kinds
    are indices of KINDS, offsets are code points. Null and empty texts have no
    span; repeated rows have equal spans; an empty table gives no rows; other
    columns are ignored.
    """
    classifier = fit(docs, text_col)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return _with_spans(rows, "text", classifier).select("id", F.col("all_base").alias("base"), F.array_sort(F.concat("all_base", "added")).alias("spans"))


def redact(docs: DataFrame, text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with every span of the text replaced by its kind, as ``[EMAIL]``.

    Overlapping base spans are replaced from the left, the rest of a later one
    separately. Texts without spans, and null and empty texts, stay as they are.
    Where the table has an integer column ``chars_col`` it is set to the new length.
    Repeated rows are redacted alike, an empty table gives no rows, and all other
    columns are passed on unchanged, whatever their names.
    """
    classifier = fit(docs, text_col)
    kept = [c for c in docs.columns if c != text_col]
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    df = _with_spans(inner, "text", classifier)
    every = F.array_sort(F.transform(F.concat("all_base", "added"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    masks = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS], F.lit(""))

    def masked(spans: Column) -> Column:
        reached = running(F.transform(spans, lambda s: s["end"]), F.greatest, F.lit(0))
        kept = F.zip_with(spans, reached, lambda s, at: F.struct(at.alias("start"), F.greatest(s["start"], at).alias("end"), (s["end"] > at).alias("masks"), s["kind"].alias("kind")))
        last = F.struct(F.array_max(F.transform(spans, lambda s: s["end"])).alias("start"), F.length("text").alias("end"), F.lit(True).alias("masks"), F.lit(len(KINDS)).alias("kind"))
        pieces = F.concat(F.filter(kept, lambda s: s["masks"]), F.array(last))
        plain = bind(pieces, lambda p: F.zip_with(cut(F.col("text"), p), p, lambda t, s: F.concat(t, F.element_at(masks, s["kind"] + 1))))
        return F.array_join(plain, "")

    df = df.withColumn("masked", F.when(F.size("all_base") + F.size("added") > 0, bind(every, masked)))
    new_text = F.coalesce("masked", F.col(f"row.`{text_col}`"))
    df = df.withColumn("new_text", new_text)
    out = []
    for f in docs.schema.fields:
        if f.name == text_col:
            out.append(F.col("new_text").alias(f.name))
        elif f.name == chars_col and chars_col in kept and f.dataType.simpleString() in ("bigint", "int"):
            out.append(F.when(F.col("masked").isNotNull(), F.length("new_text")).otherwise(F.col(f"row.`{f.name}`")).cast(f.dataType).alias(f.name))
        else:
            out.append(F.col(f"row.`{f.name}`").alias(f.name))
    return df.select(*out)
