"""Queries beside their SQL on tables made for what reviews found."""

import os

from compare import connection, differences

from quillmere import plans, registry

plans.load()


def _with(spark, sf_dir, folder, **tables):
    """A copy of the smallest tables, by links, in which ``tables`` are others."""
    for name in os.listdir(sf_dir):
        if name.removesuffix(".parquet") not in tables:
            os.symlink(f"{sf_dir}/{name}", folder / name)
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def _same(spark, folder, name):
    return differences(connection(folder), registry.QUERIES[name](spark, folder), registry.ORACLES[name])


def test_long_numbered_lines_are_no_titles(spark, sf_dir, tmp_path):
    said = ["Di. " + "le pa re " * 20, "1. " + "a" * 99 + "\nKey Points:", "1. " + "b" * 100 + "\nKey Points:", "Several::", ":::\nlast one here", "####\nMarket Overview"]
    turns = spark.createDataFrame([(i // 4, i % 4 + 1, "user", said[i % len(said)]) for i in range(96)], spark.read.parquet(f"{sf_dir}/conversations.parquet").schema)
    assert _same(spark, _with(spark, sf_dir, tmp_path, conversations=turns), "t02_section_title") == ""


def test_a_prompt_cache_that_fills(spark, sf_dir, tmp_path):
    events = spark.sql("""select id as event_id, timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, cast(id * 7 as int), 0) as ts, 16L as user_id, 'view' as event_type,
        cast(10 * (case when id % 3 = 0 then id % 9 else xxhash64(id) & 127 end) as double) as value, '{}' as props from range(1500)""")
    folder = _with(spark, sf_dir, tmp_path, events=events)
    assert _same(spark, folder, "x11_prompt_cache") == ""


def test_every_gap_between_code_and_specification(spark, sf_dir, tmp_path):
    said = ["abcdefghijklm nopqrstuvwxyzab cdefghijklmno", "xabcdefghijklmx and nopqrstuvwxyzab", "nothing", None, "abcdefghijklm"]
    rows = [(i, said[i % len(said)], "en", f"s{i % 3}" if i % 7 else None, 1) for i in range(300)]
    docs = spark.createDataFrame(rows, spark.read.parquet(f"{sf_dir}/documents.parquet").schema)
    folder = _with(spark, sf_dir, tmp_path, documents=docs)
    assert _same(spark, folder, "j13_missing_names") == ""
    assert {"code", "spec", "missing"} <= set(registry.QUERIES["j13_missing_names"](spark, folder).columns)


def test_a_block_of_postings_stays_with_its_task(spark):
    from pyspark.sql import functions as F

    from quillmere.operators.keyword_index import KeywordIndex

    docs = spark.createDataFrame([(i, f"a b{i % 50} c{i}") for i in range(3000)], "id long, text string").repartition(3)
    files = KeywordIndex.build(docs).postings().select("block", F.input_file_name().alias("file")).distinct()
    assert files.groupBy("block").count().where("count > 1").count() == 0


def test_hits_go_to_the_texts(spark, sf_dir):
    for name in ("k06_keyword_rerank", "k23_entity_boost", "k28_context_packing", "k14_adaptive_retrieval"):
        plan = registry.QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
        joins = [line for line in plan.splitlines() if " Join " in f" {line} " and "strategy=broadcast" in line]
        assert joins, name


def test_vector_search_a_few_scores_at_a_time(spark, monkeypatch):
    from quillmere.operators import retrieval

    v = spark.createDataFrame([(i, [float(i % 7), float(i % 11), 1.0]) for i in range(200)], "id long, vector array<double>")
    q = v.where("id % 5 = 0").withColumnRenamed("id", "query_id")
    found = lambda: sorted(map(tuple, retrieval.vector_top_k(v, q, 7).collect()))
    want = found()
    monkeypatch.setattr(retrieval, "CELLS", 450)
    assert found() == want and len(want) == 280


def test_streams_follow_each_other(spark, monkeypatch):
    import random

    from quillmere.streaming import think

    draw = random.Random(5)
    pieces = ["<think>", "</think>", "<thinking>", "</thinking>", "<th", "ink>", "plain ", "x" * 300, "é<", "/", None]
    streams = {k: [draw.choice(pieces) for _ in range(draw.randint(1, 14))] for k in [None, *range(200)]}
    rows = [(k, i, t) for k, said in streams.items() for i, t in enumerate(said)]
    draw.shuffle(rows)
    want = {}
    for k, said in streams.items():
        f = think.ThinkFilter()
        want[k] = "".join([f.feed(t) for t in said]) + f.flush()
    out = think.filter_batch(spark.createDataFrame(rows, "stream_id long, seq int, token string"))
    assert {r.stream_id: r.shown for r in out.collect()} == want
    assert "FlatMapGroups" not in out._jdf.queryExecution().optimizedPlan().toString()  # no frame for every stream


def test_hops_over_a_hub(spark, monkeypatch):
    from quillmere.operators import graph as G

    monkeypatch.setattr(G, "FAN", 3)
    monkeypatch.setattr(G, "TASK_PAIRS", 5)
    pairs = {(i, 0) for i in range(1, 40)} | {(0, i) for i in range(1, 40)} | {(i, i + 100) for i in range(1, 9)}
    out = G.within_hops(spark.createDataFrame(list(pairs), "src long, dst long"), spark.createDataFrame([(0,), (5,)], "id long"), 2)
    want = {}
    for seed in (0, 5):
        want[seed, seed] = 0
        for step in (1, 2):
            for s, i in [k for k, h in want.items() if k[0] == seed and h == step - 1]:
                for a, b in pairs:
                    if a == i:
                        want.setdefault((s, b), step)
    assert {(r.seed, r.id): r.hops for r in out.collect()} == want


def test_totals_in_intervals_without_pairs(spark):
    import random

    from quillmere.operators import timejoins

    draw = random.Random(12)
    key = lambda: None if draw.random() < 0.05 else (0 if draw.random() < 0.6 else draw.randrange(4))
    some = lambda: None if draw.random() < 0.05 else draw.randrange(-30, 60)
    intervals, points = [(key(), some(), some()) for _ in range(150)], [(key(), some(), i) for i in range(300)]
    one, two = spark.createDataFrame(intervals, "k int, low long, high long"), spark.createDataFrame(points, "k int, t long, p long")
    want = {}
    for k, a, b in intervals:
        inside = [p for j, t, p in points if None not in (k, a, b, t) and k == j and a <= t <= b]
        if inside:
            want[k, a, b] = (len(inside), max(inside))
    for width, part_rows in ((10.0, 100_000), (3.0, 5), (1000.0, 20)):
        out = timejoins.totals_in_intervals(one, two, "k", "low", "high", "t", "p", width, part_rows)
        assert {(r.k, r.low, r.high): (r.n, r["last"]) for r in out.collect()} == want


def test_pairs_counted_by_meetings_and_by_cells(monkeypatch):
    import random

    import numpy as np
    import pyarrow as pa

    from quillmere.operators import relations as J

    draw = random.Random(7)
    one, two = ([draw.sample(range(-20, 40), draw.randint(0, 9)) for _ in range(n)] for n in (70, 90))
    want = {(i, k, n) for i, x in enumerate(one) for k, y in enumerate(two) if (n := len(set(x) & set(y))) >= 2}
    lists = lambda x: pa.chunked_array([pa.array(x[:30], pa.list_(pa.int64())), pa.array(x[30:], pa.list_(pa.int64()))])
    monkeypatch.setattr(J, "CELLS", 60)
    for sparse in (0, 10**9):
        monkeypatch.setattr(J, "SPARSE", sparse)
        found = [p for part in J.kept_pairs(lists(one), lists(two), lambda shared, na, nb: shared >= 2) for p in zip(*map(np.ndarray.tolist, part), strict=True)]
        assert len(found) == len(want) and set(found) == want


def test_overlaps_of_many_alike(spark, sf_dir, tmp_path):
    """Copies, folders that are null or empty, and texts that are null; no pair is shuffled."""
    said = ["abcdefghijklm nopqrstuvwxyzab cdefghijklmno", "abcdefghijklm Abcdefghijklm nopqrstuvwxyzab", "abcdefghijklm", None, "no long words"]
    rows = [(i, said[i % len(said)], "en", (None, "", "s")[i % 3], 1) for i in range(300)]
    docs = spark.createDataFrame(rows, spark.read.parquet(f"{sf_dir}/documents.parquet").schema)
    folder = _with(spark, sf_dir, tmp_path, documents=docs)
    for name in ("j04_entity_overlap", "j09_weighted_overlap"):
        assert _same(spark, folder, name) == ""
        plan = registry.QUERIES[name](spark, folder)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.index("FlatMapGroupsInArrow") < min(plan.index(x) for x in ("Join", "Aggregate"))


def test_relationship_workflow_writes_no_texts(spark, sf_dir, tmp_path, monkeypatch):
    from quillmere.plans import workflows

    monkeypatch.setattr(workflows, "_folder", lambda spark, name: f"file://{tmp_path}/{name}")
    assert _same(spark, sf_dir, "e07_relationship_workflow") == ""
    kept = os.listdir(tmp_path / "e07")
    assert kept == ["classify"] and spark.read.parquet(f"file://{tmp_path}/e07/classify").columns == ["doc_id", "error"]


def test_pairs_of_a_common_title(spark, sf_dir, tmp_path, monkeypatch):
    """A title's pairs leave their task as rows of ids and targets, whatever parts and batches they are dealt into."""
    from quillmere.operators import relations as J

    said = ["One two three four", "One two three", " One\n two  three", "so: One two three.", "One", "", None, "x One two"]
    docs = spark.createDataFrame([(i, said[i % len(said)], "en", "s", 1) for i in range(400)] + [(1, said[0], "en", None, 1)] * 3, spark.read.parquet(f"{sf_dir}/documents.parquet").schema)
    folder = _with(spark, sf_dir, tmp_path, documents=docs)
    plan = registry.QUERIES["j15_name_mention"](spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("MapInArrow") < plan.index("Join")
    assert _same(spark, folder, "j15_name_mention") == ""
    monkeypatch.setattr(J, "PAIRS", 500)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        assert _same(spark, folder, "j15_name_mention") == ""
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_phrases_that_name_parts_of_each_other(spark, sf_dir, tmp_path, monkeypatch):
    """Phrases that point at few files, at all of them, at the same ones and at none; pairs leave their task as rows of ids and targets."""
    from quillmere.operators import relations as J

    said = ["see file d", "see file doc and mentioned in doc_1", "according to 1, mentioned in 12 or mentioned in _1", "refers to document doc_3.pdf see section doc", None, "mentioned in me", "SEE  FILE c mentioned\nin O"]
    docs = spark.createDataFrame([(i, said[i % len(said)], "en", "s", 1) for i in range(150)] + [(2, said[0], "en", None, 1)] * 2, spark.read.parquet(f"{sf_dir}/documents.parquet").schema)
    folder = _with(spark, sf_dir, tmp_path, documents=docs)
    plan = registry.QUERIES["j11_reference_phrase"](spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("MapInArrow") < plan.index("Join")
    assert _same(spark, folder, "j11_reference_phrase") == ""
    monkeypatch.setattr(J, "PAIRS", 300)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        assert _same(spark, folder, "j11_reference_phrase") == ""
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_a_few_values_leave_at_once():
    import numpy as np

    from quillmere.operators import relations as J

    parts = list(J._cut(iter([(np.arange(130), np.arange(1000, 1300)), (np.arange(0), np.arange(9)), (np.arange(1), np.arange(9))])))
    assert max(len(i) * len(t) for i, t in parts) <= J.ROW_IDS * J.ROW_TARGETS
    assert len({(a, b) for i, t in parts for a in i for b in t}) == sum(len(i) * len(t) for i, t in parts) == 130 * 300 + 9


def test_a_row_for_all_texts_that_lack_as_much(spark, sf_dir, monkeypatch):
    import random

    import numpy as np

    from quillmere.operators import names as N

    draw = random.Random(3)
    counts = np.array([[draw.choice([0, 0, 0, 1, 2, 5]) for _ in range(23)] for _ in range(31)], np.int32)
    below = np.array([draw.choice([0, 0.5, 1.5, 3.0]) for _ in counts])
    monkeypatch.setattr(N, "OUT_ROWS", 50)
    got = [(r, c, v) for rows, values, at, cols in N._alike(counts, below) for k, (r, v) in enumerate(zip(rows, values, strict=True)) for c in cols[at[k] : at[k + 1]]]
    assert sorted(got) == [(r, c, n) for r, row in enumerate(counts) for c, n in enumerate(row) if n < below[r]]
    plan = registry.QUERIES["j13_missing_names"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("FlatMapGroupsInArrow")


def test_many_equal_confidences_add_up(spark, sf_dir, tmp_path, monkeypatch):
    from pyspark.sql import functions as F

    from quillmere.plans import workflows

    monkeypatch.setattr(workflows, "_folder", lambda spark, name: f"file://{tmp_path}/{name}")
    monkeypatch.setitem(registry.QUERIES, "j11_reference_phrase", lambda spark, sf_dir: spark.range(0, 10_000_001, 1, 1).select(F.lit(0.8).alias("confidence")))
    monkeypatch.setitem(registry.QUERIES, "j04_entity_overlap", lambda spark, sf_dir: spark.sql("select explode(array(0.4D, null, 1.0D)) as confidence"))
    out = {r.kind: (r.n, r.confidence) for r in registry.QUERIES["e07_relationship_workflow"](spark, sf_dir).collect()}
    assert out["cross_reference"] == (10_000_001, 8_000_000.8) and out["entity_overlap"] == (3, 1.4)
