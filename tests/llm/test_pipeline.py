"""The pipeline's stages, one by one and on awkward tables."""

from collections import defaultdict

import corpus_pipeline as cp
import pytest
from brute import base_spans, quality, targets, words

from quillmere.llm.decontaminate import normalised

AWKWARD = [
    (1, None, "en", "a", 0, "x", 1.0),
    (2, "", None, None, 0, "x", 1.0),
    (3, "too short", "en", "a", 9, "x", 1.0),
    (4, "a clean text of more than ten words that nobody has copied anywhere yet, mail me at jo@example.org today", "en", "a", 1, None, 1.0),
    (4, "a clean text of more than ten words that nobody has copied anywhere yet, mail me at jo@example.org today", "en", "a", 1, None, 1.0),
    (5, "A clean text of more than ten words that nobody has copied anywhere yet, mail me at jo@example.org  today", "en", "b", 1, None, 1.0),
    (None, "another clean text without an id that still has more than ten words in it", "de", None, 1, "y", 2.0),
    (7, " ".join(f"word{i}" for i in range(60000)), "en", "c", 1, "y", 2.0),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, row_key double"


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame(AWKWARD, SCHEMA)


def test_stages_keep_columns_and_clean_rows(spark, sf_dir, awkward):
    docs = awkward
    for name, stage in cp.STAGES:
        out = stage(spark, docs, sf_dir)
        if name != "source_mix":
            assert out.columns == awkward.columns
        docs = spark.createDataFrame(out.collect(), out.schema)
    rows = {r.doc_id: r for r in docs.collect()}
    assert set(rows) == {4, None, 7} and docs.count() == 3
    assert "[EMAIL]" in rows[4].text and rows[4].n_chars == len(rows[4].text)
    assert docs.columns[: len(awkward.columns)] == awkward.columns


def test_stages_take_empty_tables(spark, sf_dir, awkward):
    docs = awkward.limit(0)
    for _, stage in cp.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0


def test_whole_run(spark, sf_dir):
    before = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    items = [normalised(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    out = cp.run(spark, sf_dir).collect()
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in out:
        old = before[r.doc_id].text
        assert not quality(old)[-1]
        assert not any(i in normalised(old) for i in items)
        assert not base_spans(r.text) and (r.text == old or "[" in r.text)
        assert r.n_chars == len(r.text)
        sizes[r.source] += len(words(r.text))
        taken[r.source] += r.taken
    want = targets(sizes)
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)
    assert len({" ".join(words(before[r.doc_id].text)).lower() for r in out}) == len(out) == len({r.doc_id for r in out})
