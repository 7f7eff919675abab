"""Token alignment, the Merkle manifest and exact copies beside plain versions; all SQL beside its query."""

import hashlib
import random
from collections import Counter

import pytest
from brute import aligned, exact_copies, manifest
from compare import connection, differences
from pyspark.sql import functions as F
from test_contracts import NASTY, nasty

from quillmere.llm import alignment, exact, merkle, oracle
from quillmere.llm import queries as q
from quillmere.llm.common import hot_keys, id_remainder, spread_join

ODD = [
    (20, " leading and  double   spaces\n\n\n\tand\ttabs \r\n end "),
    (21, "<|endoftext|> <s> </s> <unk> <0x41> ▁ ▁x"),
    (22, "naïve café — “quotes” 日本語のテキスト עברית 👩‍👩‍👧‍👦 🏳️‍🌈 ­ \x00 \x7f ​"),
    (23, "it's we'll they've I'd 'S 'LL 12345678901234567890 1.2.3 ___ ....... !!!???"),
    (24, "a" * 3000 + " " * 3000 + "\n" * 500 + "é" * 700),
    (25, "word " * 20_000),
    (26, "<|endoftext|>" * 3),
    (27, "ﬁ ½ Å ① ｆｕｌｌ １２ ̧́"),
]


@pytest.mark.parametrize("name", sorted(oracle.SQL))
def test_sql_of_the_registered_query(spark, sf_dir, name):
    assert differences(connection(sf_dir), q.queries()[name](spark, sf_dir), oracle.SQL[name]) == ""


def _stats(r, groups):
    return (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, groups)


def test_alignment_of_the_table(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: _stats(r, r.groups_sha256) for r in q.op11_token_alignment(spark, sf_dir).collect()}
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest() if s else ""
    assert got == {i: (*w[:-1], digest(w[-1])) for (i, _), w in zip(docs, aligned([t for _, t in docs]))}


@pytest.mark.parametrize("head", [alignment.HEAD, 40, 0])
def test_alignment_edges(spark, head):
    rows = [*NASTY, *ODD]
    df = spark.createDataFrame([(*r, "g", 1) for r in rows], "doc_id long, text string, groups string, row int")
    out = alignment.align_texts(df, head=head).collect()
    key = lambda r: str(r)
    assert sorted([(r.id, *_stats(r, r.groups)) for r in out], key=key) == sorted([(i, *w) for (i, _), w in zip(rows, aligned([t for _, t in rows]))], key=key)
    assert alignment.align_texts(df.limit(0)).collect() == []


def test_runs_are_jumped_and_irregular_groups_are_resolved():
    rng = random.Random(3)
    for _ in range(400):
        n = rng.randint(1, 60)
        keep = rng.choice([0.2, 0.5, 0.9, 1.0])
        ends = sorted({n, *(x for x in range(1, n) if rng.random() < keep)})
        others = sorted({n, *(x for x in range(1, n) if rng.random() < keep)})
        found = [*alignment.align(ends, others)]
        cuts = []
        for regular, a, b, c, d in found:
            assert ends[b - 1] == others[d - 1] and (a, c) == ((0, 0) if not cuts else here)
            here = (b, d)
            if regular:
                assert b > a and ends[a:b] == others[c:d]
                cuts += ends[a:b]
            else:
                assert (b - a, d - c) != (1, 1) and not set(ends[a : b - 1]) & set(others[c : d - 1])
                cuts.append(ends[b - 1])
        assert cuts == sorted(set(ends) & set(others)) and here == (len(ends), len(others))
        assert not any(x[0] and y[0] for x, y in zip(found, found[1:]))


def test_both_ways_to_byte_tokens_agree():
    tokens = alignment.ByteTokens(f"{alignment.TOKENIZERS}/{alignment.BYTE_BPE}")
    assert tokens.quick is not None
    for _, t in [*NASTY, *ODD]:
        assert tokens.ids(" " + (t or "")) == tokens.library.encode(" " + (t or ""), add_special_tokens=False).ids


def test_packed_links_round_trip():
    import numpy as np

    for codes in ([], [0], [5, 5, 6, (1 << 32) - 1], [5, 6, 6, 1 << 40]):
        assert alignment.unpack(alignment.pack(np.array(codes, np.int64))).tolist() == codes


def _audited(df):
    out = merkle.audit(df, columns=("doc_id", "lang", "text"), tampered={"text": F.upper("text")}, where=id_remainder("doc_id", 3) == 0).collect()
    flat = lambda r: "".join("".join(s.left + s.right) for s in r.path)
    return Counter((r.id, r.leaf, r.subroot, r.root, hashlib.sha256(flat(r).encode()).hexdigest(), (r.nodes or [r.version_leaf])[-1], r.verified) for r in out)


@pytest.mark.parametrize("sizes", [(1,), (0, 1, 1), (1, 8, 9, 64, 65, 7, 2, 3, 1, 11), (513, 4), (1100, None)])
def test_merkle_versions(spark, sizes):
    import zlib

    rng = random.Random(len(sizes))
    rows = []
    for k, n in enumerate(sizes):
        for _ in range(5 if n is None else n):
            rows.append((None if rng.random() < 0.05 else rng.randint(-5, 2000), None if n is None else "é" * k + "l", rng.choice([None, "", "Some Text", "same", "x" * rng.randint(0, 50)])))
    rows += rows[:3]
    df = spark.createDataFrame([(*r, "n", 1) for r in rows], "doc_id long, lang string, text string, named string, pos int").repartition(5)
    changed = [(i, g, None if t is None else t.upper()) if zlib.crc32(("" if i is None else str(i)).encode()) % 3 == 0 else None for i, g, t in rows]
    assert _audited(df) == Counter(manifest([(i, g, (i, g, t)) for i, g, t in rows], changed))


def test_merkle_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, source string, lang string, n_chars long, text string")
    assert merkle.audit(df).collect() == []


@pytest.mark.parametrize("digest_chars", [64, 1])
def test_exact_copies(spark, digest_chars):
    """With one hex digit as digest all groups clash and contents alone decide."""
    rng = random.Random(9)
    rows = [*NASTY, *((100 + i, rng.choice(["a b", "ab", " ab\n", "a\x0bb", "c d", "cd", " ", "", None])) for i in range(200)), (50, "ab"), (None, "a  b"), (None, "a  b")]
    df = spark.createDataFrame([(*r, "x", True) for r in rows], "doc_id long, text string, keep_id string, hot boolean").repartition(7)
    got = Counter((r.id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact.mark_copies(df, digest_chars=digest_chars).collect())
    assert got == Counter(exact_copies(rows))
    assert exact.mark_copies(df.limit(0)).collect() == []


def test_hot_keys_are_few_and_joined_without_loss(spark):
    rows = spark.range(4000).select((F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string"))).alias("k"), F.col("id").alias("late"))
    hot = hot_keys(rows, ["k"])
    assert [r.k for r in hot.collect()] == ["hot"]
    table = rows.select("k").distinct().where("k <> '7'").select("k", F.concat(F.lit("of "), "k").alias("v"))
    got = spread_join(rows, table, ["k"], hot, "v")
    assert got.columns == ["k", "late", "v"]
    assert got.where("v = 'of ' || k").count() == 3999 and got.where("k = '7' and v is null").count() == 1
