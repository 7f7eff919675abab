"""Plain-Python parts and properties of ranked lists."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillmere.functions import chunking as C
from quillmere.functions import routing as R
from quillmere.functions import text as T
from quillmere.operators import filters, graph, mmr, ranking, retrieval, store
from quillmere.sources import binary
from quillmere.sources.html import elements
from quillmere.streaming import limits
from quillmere.streaming.think import ThinkFilter, filter_stream


@given(st.text(alphabet="ab .\n", max_size=400), st.integers(5, 60), st.integers(0, 4))
@settings(max_examples=150, deadline=None)
def test_splitter_bounds_and_covers(text, size, overlap):
    chunks = C.split_recursive(text, size, overlap)
    assert all(0 < len(c) <= size for c in chunks)
    assert set("".join(text.split())) <= set("".join(chunks))
    assert chunks == C.split_recursive(text, size, overlap)


def test_splitter_prefers_coarse_cuts():
    text = "first paragraph here\n\nsecond paragraph there\n\nthird"
    assert C.split_recursive(text, 25, 0) == ["first paragraph here", "second paragraph there", "third"]


def test_header_sections():
    assert [s[0] for s in C.header_sections("lost\n# A\nx\n## B\ny")] == ["A", "B"] and C.header_sections("none") == []


def test_long_windows_end_at_sentences():
    text = "word " * 500 + "end. " + "more " * 500
    parts = C.split_long(text, 3000, 100)
    assert all(len(p) <= 3000 for p in parts) and parts[0].endswith("end.")


def test_packed_lines():
    parts = C.pack_lines("\n".join("x" * 30 for _ in range(10)), 100)
    assert all(len(p) <= 100 for p in parts) and "".join(parts).count("x") == 300


def test_box_groups():
    assert C.group_boxes([(0, 0, 10), (30, 0, 10), (500, 500, 5), (32, 40, 4)]) == [0, 0, 1, 0]


@given(st.lists(st.sampled_from(["a", "bc", "<think>", "</think>", "<thi", "nk>", "x<", "</", "think>", "<thinking>", "</thinking>"]), max_size=12), st.randoms())
@settings(max_examples=200, deadline=None)
def test_think_filter_ignores_token_borders(tokens, rng):
    text = "y" * 600 + "".join(tokens)

    def run(parts):
        f = ThinkFilter()
        return "".join(f.feed(p) for p in parts) + f.flush()

    cuts = sorted(rng.randrange(len(text) + 1) for _ in range(10))
    parts = [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)])]
    long = [p for p in [text[:600], *[text[600:][i : i + 1] for i in range(len(text) - 600)]]]
    assert run(long) == run([text[:600], *parts_after(parts)])


def parts_after(parts):
    left, out = 600, []
    for p in parts:
        if left >= len(p):
            left -= len(p)
            continue
        out.append(p[left:])
        left = 0
    return out


def test_think_filter_drops_preface_and_unclosed():
    f = ThinkFilter()
    assert f.feed("let me see <thi") == "" and f.feed("nk>secret</think>Hi") == "Hi" and f.flush() == ""
    g = ThinkFilter()
    assert g.feed("short") == "" and g.flush() == "short"
    h = ThinkFilter()
    assert h.feed("<think>never closed") + h.flush() == ""


def test_think_stream(spark, tmp_path):
    rows = [(1, 0, "plan <think>no"), (1, 1, "</think>yes"), (2, 0, "<think>a</think>"), (2, 1, "b")]
    spark.createDataFrame(rows, "stream_id long, seq int, token string").coalesce(1).write.parquet(str(tmp_path / "in"))
    tokens = spark.readStream.schema("stream_id long, seq int, token string").parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    q = filter_stream(tokens).writeStream.format("memory").queryName("think").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r.stream_id, r.shown) for r in spark.table("think").collect()} == {(1, "yes"), (2, "b")}


def test_limits():
    assert limits.lru_replay([(0, "a"), (1, "a"), (2, "b"), (3, "c"), (4, "a")], 2, 100) == [False, True, False, False, False]
    assert limits.lru_replay([(0, "a"), (50, "a"), (200, "a")], 2, 100) == [False, True, False]
    rates = limits.adaptive_rates(["ok"] * 10 + ["limited", "error", "error", "error"])
    assert rates[9] == pytest.approx(11) and rates[10] == pytest.approx(5.5) and rates[-1] == pytest.approx(2.75)


def test_token_bucket(spark):
    rows = [(1, float(t), i) for i, t in enumerate([0, 0, 0, 10, 10])]
    df = spark.createDataFrame(rows, "k int, t double, i int")
    r = limits.token_bucket(df, "k", F.col("t"), "i", 0.1, 2).first()
    assert (r.allowed, r.refused) == (3, 2)


def test_mmr_matches_definition():
    rng = np.random.default_rng(0)
    v, q = rng.normal(size=(12, 5)), rng.normal(size=5)
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    rel = unit @ (q / np.linalg.norm(q))
    got = mmr.select(v, q, rel, 4, 0.7)
    want = [int(np.argmax(rel))]
    while len(want) < 4:
        best = max((i for i in range(12) if i not in want), key=lambda i: 0.7 * rel[i] - 0.3 * max(unit[i] @ unit[j] for j in want))
        want.append(best)
    assert got == want and mmr.select(v, q, rel, 20) == list(range(12))


@pytest.fixture(scope="module")
def ranked(spark):
    rng = random.Random(1)
    rows = [(q, i, rng.randrange(4), i + 1, round(1 - i / 20, 4)) for q in range(3) for i in range(15)]
    return spark.createDataFrame(rows, "query_id int, id int, file_key int, rank int, score double")


@pytest.mark.parametrize("make,per_file,total", [(lambda h: ranking.cap_per_file(h, 2, 6), 2, 6), (lambda h: ranking.rebalance(h, 0.5, 3), 3, 99), (lambda h: ranking.diversify(h, 2, 8), 15, 8), (lambda h: ranking.rebalance_unscored(h, 2), 2, 99)])
def test_ranked_lists_keep_their_bounds(ranked, make, per_file, total):
    by = {}
    for r in make(ranked).collect():
        by.setdefault(r.query_id, []).append(r)
    for rows in by.values():
        assert sorted(r["rank"] for r in rows) == list(range(1, len(rows) + 1)) and len(rows) <= total
        assert len({r.id for r in rows}) == len(rows)
        assert all(sum(r.file_key == k for r in rows) <= per_file for k in range(4))


def test_fusion_of_one_list_keeps_it(ranked):
    got = ranking.reciprocal_rank_fusion([ranked]).orderBy("query_id", "rank").select("query_id", "id").collect()
    assert [tuple(r) for r in got] == [(r.query_id, r.id) for r in ranked.orderBy("query_id", "rank").collect()]


def test_vector_top_k_handles_zero_and_none(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0, 1.0])], "id int, vector array<double>")
    q = spark.createDataFrame([(9, [1.0, 0.0])], "query_id int, vector array<double>")
    assert [(r.id, r.score) for r in retrieval.vector_top_k(v, q, 5).orderBy("rank").collect()] == [(1, 1.0), (3, 0.707107), (2, 0.0)]
    assert retrieval.vector_top_k(v, q.limit(0), 5).collect() == []


def test_filters(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "b", "2024-01-05"), (3, None, "2024-02-01")], "n int, file_type string, created_at string")
    ids = lambda c: [r.n for r in df.where(c).orderBy("n").collect()]
    assert ids(filters.where_clause({"$or": [{"n": 1}, {"file_type": {"$ne": "a"}}]})) == [1, 2, 3]
    assert ids(filters.where_clause({"n": {"$gt": 1, "$lt": 3}})) == [2]
    assert ids(filters.post_filter({"date_range": {"$gte": "2024-01-31"}})) == [1, 3]
    assert ids(filters.retrieval_filter({"unknown": 3})) == [1, 2, 3]


def test_file_categories(spark):
    cases = [("a.PDF", None, "unstructured_native"), ("a", "audio/x-new", "audio"), ("x.py", "application/unknown", "code"), ("n.ipynb", "", "notebook"), ("a.b.c.tar", None, "unsupported"), ("data.txt", " TEXT/X-PYTHON ", "code"), (".bashrc", None, "unsupported"), ("dir.md/file", None, "unsupported")]
    df = spark.createDataFrame([(n, m) for n, m, _ in cases], "n string, m string")
    assert [r[0] for r in df.select(R.file_category(F.col("n"), F.col("m"))).collect()] == [c for *_, c in cases]


def test_clock(spark):
    rows = spark.sql("select explode(array(0.0d, 59.9d, 61d, 3599d, 3661d, 86400d)) s").select(R.clock(F.col("s")).alias("c")).collect()
    assert [r.c for r in rows] == ["00:00", "00:59", "01:01", "59:59", "01:01:01", "24:00:00"]


def test_paths_stop_at_cycles(spark):
    folders = spark.createDataFrame([("a", None, "A"), ("b", "a", "B"), ("c", "b", "C"), ("x", "y", "X"), ("y", "x", "Y")], "id string, parent string, name string")
    assert {(r.id, r.path) for r in store.folder_paths(folders).collect()} == {("a", "A"), ("b", "A/B"), ("c", "A/B/C")}


def test_reachability_with_cycle(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 5)], "src int, dst int")
    s = spark.createDataFrame([(1,), (4,)], "id int")
    assert {tuple(r) for r in graph.reachable(e, s).collect()} == {(1, 1), (1, 2), (1, 3), (4, 4), (4, 5)}


def test_quotes_and_citations():
    assert T.best_quote("cats sleep all day", "Dogs bark. Cats sleep all the day. Birds sing.") == "Cats sleep all the day."
    assert T.sequence_similarity("abc", "xxabcxx") == 0.9
    rows = [("f", "1", "the same words here", 0.5), ("f", "2", "the same words here!", 0.9), ("g", "1", "the same words here", 0.4), ("f", "1", "other", 0.1)]
    assert T.distinct_citations(rows) == [1, 2, 3]
    assert T.parse_batch_summaries("FILE: A.pdf\nSUMMARY: one\ntwo\nFILE: zz\nSUMMARY: no", ["a.pdf"]) == {"a.pdf": "one two"}


def test_html_elements():
    assert elements("<h1>T</h1><script>no</script><p>a &amp; b<li>c") == [("Title", "T"), ("NarrativeText", "a & b"), ("ListItem", "c")]


def test_binary_listing(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_bytes("ä".encode("latin-1"))
    (tmp_path / "sub" / "b.txt").write_text("ok")
    flat = binary.list_files(spark, str(tmp_path), pattern="*.txt")
    deep = binary.list_files(spark, str(tmp_path), recursive=True)
    assert flat.count() == 1 and deep.count() == 2
    assert {r.t for r in deep.select(binary.decoded(F.col("content")).alias("t")).collect()} == {"ä", "ok"}


def test_replies_are_settled():
    from quillmere.functions.text import settled, without_query_json

    assert without_query_json('{"query_type": "x", "confidence": 1, "more": {"a": 1}} The sum is ten.') == "The sum is ten."
    assert without_query_json('{"a": {"b": 1}} stays') == '{"a": {"b": 1}} stays'
    assert settled("A river rises in green hills nearby. A river rises in green hills nearby! It ends far away at sea.") == "A river rises in green hills nearby. It ends far away at sea"
    assert settled("The old river rises high up in the hills of home. The old river rises high up in the hills at home.") == "The old river rises high up in the hills of home"
    assert settled("It was very very very cold that day in town.") == "It was very cold that day in town"
    assert settled("The bridge was built in spring and the bridge was built in stone.") == "The bridge was built in spring and stone"
    assert settled("Fine words stay as they are. foo(bar baz,qux broken") == "Fine words stay as they are"
    assert settled("") == ""


def test_ranges_and_lists_of_filters(spark):
    from datetime import date

    from quillmere.operators.filters import retrieval_filter

    rows = [(1, "2024-01-05", 10, "text/plain"), (2, "2024-02-05", 11, "text/plain"), (3, "2024-02-06", 10, "application/pdf")]
    df = spark.createDataFrame(rows, "id int, created_at string, page_number int, mime_type string")
    ids = lambda spec: [r.id for r in df.where(retrieval_filter(spec)).orderBy("id").collect()]
    assert ids({"mime_type": "text/plain"}) == [1, 2]
    assert ids({"page_number": [10, 12]}) == [1, 3]
    assert ids({"date_range": {"start": date(2024, 2, 1), "end": date(2024, 2, 5)}}) == [2]
    assert ids({"date_range": {"start": date(2024, 2, 1)}, "unknown": 1}) == [2, 3]


def test_late_events_of_a_stream(spark, tmp_path):
    from pyspark.sql import functions as F

    from quillmere.streaming.windows import windowed

    def batch(number, *times):
        spark.createDataFrame([("k", f"2024-01-01 {t}:00") for t in times], "key string, at string").coalesce(1).write.parquet(str(tmp_path / "in" / f"{number}"))

    batch(0, "10:01", "10:07", "10:12")
    batch(1, "10:40")
    batch(2, "10:41")
    batch(3, "10:05", "10:38")  # the first is later than its window's end by more than the lateness
    stream = spark.readStream.schema("key string, at string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    counted = windowed(stream.withColumn("at", F.to_timestamp("at")), ["key"], "at", [F.count(F.lit(1)).alias("n")], "10 minutes", lateness="5 minutes")
    run = counted.writeStream.format("memory").queryName("late_events").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    run.awaitTermination(100)
    out = {r.window_start.strftime("%H:%M"): r.n for r in spark.table("late_events").collect()}
    assert out == {"10:00": 2, "10:10": 1}
