"""Streams with state against replays over tables, and after restarts."""

import random

import pytest
from pyspark.sql import functions as F

from quillmere.streaming import caches, retry, sink

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def brute(requests, rules):
    """hit by ident: each scope a list of [key, filled] in the order of eviction."""
    held, out = {}, {}
    for scope, key, t, i in sorted(requests, key=lambda r: (r[2], r[3])):
        entries = held.setdefault(scope, [])
        at = next((n for n, (k, _) in enumerate(entries) if k == key), None)
        age = None if at is None else t - entries[at][1]
        out[i] = age is not None and (age <= rules.ttl if rules.inclusive else age < rules.ttl)
        if out[i]:
            entries.append(entries.pop(at))
            continue
        if at is not None:
            entries.pop(at)
        if rules.size is not None and len(entries) >= rules.size:
            entries.pop(0)
        entries.append([key, t])
    return out


def requests_of(seed, n=400):
    rng = random.Random(seed)
    return [(rng.randrange(4), f"k{rng.randrange(12)}", float(rng.randrange(3000)), i) for i in range(n)]


@pytest.mark.parametrize("rules", [caches.Rules(600, 3, inclusive=True), caches.Rules(100), caches.Rules(1e9, 5), caches.PROMPTS])
def test_replay_of_a_cache(spark, rules):
    rows = requests_of(1)
    df = spark.createDataFrame(rows, "scope int, k string, at double, i int")
    got = {r.i: r.hit for r in caches.replayed(df, rules, "scope", "k", "at", "i").collect()}
    assert got == brute(rows, rules)
    assert caches.replayed(df.limit(0), rules, "scope", "k", "at", "i").collect() == []


def test_cache_of_a_stream_equals_the_replay_over_restarts(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    rules, rows = caches.Rules(600, 3, inclusive=True), sorted(requests_of(2, 240), key=lambda r: (r[2], r[3]))
    schema = "scope int, k string, at double, i int"

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        timed = stream.withColumn("ts", F.timestamp_seconds("at")).withWatermark("ts", "1 second")
        out = caches.cached_stream(timed, rules, "scope", "k", "at", "i", "ts")
        q = out.writeStream.foreachBatch(sink.to_log(str(tmp_path / "out"))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(300)

    for n in range(4):  # each run starts from the checkpoint of the one before
        spark.createDataFrame(rows[60 * n : 60 * n + 60], schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"{n}"))
        run()
    got = {r.i: r.hit for r in sink.read_log(spark, str(tmp_path / "out"), "scope int, i int, hit boolean").collect()}
    assert got == brute(rows, rules)


def test_cache_state_is_bounded():
    cache = caches.Cache(caches.Rules(50, 10))
    for t in range(1000):
        cache.ask(f"k{t}", float(t))
        assert len(cache.entries) <= 10
    cache.expire(1049.5)
    assert not cache.entries


TOKENS = [(1, 0, "Hel", ["a.pdf"], False, False), (1, 1, "lo", None, True, False), (2, 0, "", [], False, False), (2, 1, "broken", None, True, True), (3, 0, "only", None, True, None)]
TOKEN_SCHEMA = "stream_id long, seq long, token string, citations array<string>, last boolean, failed boolean"
EVENTS = [(1, "status", "generating"), (1, "citations", '["a.pdf"]'), (1, "token", "Hel"), (1, "token", "lo"), (1, "done", "2"), (2, "status", "generating"), (2, "error", "broken"), (3, "status", "generating"), (3, "token", "only"), (3, "done", "1")]


def test_events_of_answers(spark):
    got = sink.answer_events(spark.createDataFrame(TOKENS, TOKEN_SCHEMA)).orderBy("stream_id", "seq").collect()
    assert [(r.stream_id, r.kind, r.payload) for r in got] == EVENTS


def test_a_crash_between_writing_and_committing_gives_no_event_twice(spark, tmp_path):
    for n in range(3):
        spark.createDataFrame(TOKENS[2 * n : 2 * n + 2], TOKEN_SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / f"{n}"))
    crashes = [1, 2]

    def crash(number):
        if number in crashes:
            crashes.remove(number)
            raise RuntimeError("lost after writing")

    def run(write, name):
        stream = spark.readStream.schema(TOKEN_SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        q = sink.answer_events(stream).writeStream.foreachBatch(write).option("checkpointLocation", str(tmp_path / f"cp-{name}")).trigger(availableNow=True).start()
        try:
            q.awaitTermination(120)
            return True
        except Exception:
            return False

    log = sink.to_log(str(tmp_path / "log"), crash)
    assert [run(log, "log") for _ in range(3)] == [False, False, True]
    schema = "stream_id long, seq long, kind string, payload string"
    rows = sink.read_log(spark, str(tmp_path / "log"), schema).orderBy("stream_id", "seq").collect()
    assert [(r.stream_id, r.kind, r.payload) for r in rows] == EVENTS

    crashes[:] = [0, 2]
    state = sink.latest_state(str(tmp_path / "state"), "stream_id", ["seq"], schema, crash)
    assert [run(state, "state") for _ in range(3)] == [False, False, True]
    last = spark.read.schema(schema).parquet(str(tmp_path / "state" / "batch=000000000002")).collect()
    assert {(r.stream_id, r.kind) for r in last} == {(1, "done"), (2, "error"), (3, "done")}


def test_attempts_and_pauses(spark):
    rows = spark.createDataFrame([(i, f"row {i}") for i in range(6)], "id int, payload string")
    # Row i fails in its first i attempts.
    step = lambda df: df.withColumn("error", F.when(F.col("attempt") < F.col("id"), F.concat(F.lit("failed "), F.col("attempt").cast("string"))))
    done, dead = retry.attempted(rows, step)
    assert {(r.id, r.attempts, r.waited) for r in done.collect()} == {(0, 1, 0.0), (1, 2, 1.0), (2, 3, 3.0), (3, 4, 7.0)}
    assert {(r.id, r.attempts, r.waited, r.error) for r in dead.collect()} == {(4, 4, 7.0, "failed 3"), (5, 4, 7.0, "failed 3")}
    done, dead = retry.attempted(rows.limit(0), step)
    assert done.count() == dead.count() == 0


def test_attempts_of_a_stream(spark, tmp_path):
    import time

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    spark.createDataFrame([(i % 2, f"{i}") for i in range(5)], "k int, payload string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k int, payload string").parquet(str(tmp_path / "in"))

    def step(payload, attempt):
        return f"failed {attempt}" if attempt < int(payload) else None

    out = retry.attempted_stream(stream, step, "k", retries=3, base=0.1)
    q = out.writeStream.foreachBatch(sink.to_log(str(tmp_path / "out"))).option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="1 second").start()
    want = {("0", "done", 1, None), ("1", "done", 2, None), ("2", "done", 3, None), ("3", "done", 4, None), ("4", "dead", 4, "failed 3")}
    got, until = set(), time.time() + 90
    while time.time() < until and got != want:
        time.sleep(2)
        try:
            got = {(r.payload, r.state, r.attempts, r.error) for r in sink.read_log(spark, str(tmp_path / "out"), "k int, payload string, state string, attempts int, error string").collect()}
        except Exception:
            continue
    q.stop()
    assert got == want


def test_workflow_runs_branches_and_resumes(spark, tmp_path):
    from quillmere.operators.workflow import Edge, Step, Workflow

    calls = []

    def said(name, change):
        def run(**given):
            calls.append(name)
            return change(**given)

        return run

    def flow(fails=()):
        def last(low, high):
            if "sum" in fails:
                raise RuntimeError("lost")
            return low.unionByName(high)

        return Workflow(
            Step("sum", said("sum", last), {"low": "low", "high": "high"}),
            Step("parse", said("parse", lambda rows: rows.withColumn("error", F.when(F.col("x") < 0, "negative"))), {"rows": "rows"}),
            Step("low", said("low", lambda r: r.withColumn("y", F.col("x") * 2)), {"r": Edge("parse", F.col("x") < 5)}),
            Step("high", said("high", lambda r: r.withColumn("y", F.col("x") * 3)), {"r": Edge("parse", F.col("x") >= 5)}),
            Step("failed", said("failed", lambda errors: errors), {"errors": Workflow.ERRORS}),
        )

    rows = spark.createDataFrame([(i,) for i in (-2, 1, 4, 5, 9)], "x int")
    folder = f"file://{tmp_path}/flow"
    with pytest.raises(RuntimeError):
        flow(["sum"]).run(spark, {"rows": rows}, folder)
    assert calls.count("parse") == 1
    out = flow().run(spark, {"rows": rows}, folder)
    assert calls.count("parse") == 1  # its result was read by two steps, so it was written and is not made again
    assert {(r.x, r.y) for r in out["sum"].collect()} == {(1, 2), (4, 8), (5, 15), (9, 27)}
    assert [(r.step, r.error, r.row) for r in out["failed"].collect()] == [("parse", "negative", '{"x":-2}')]
    with pytest.raises(ValueError):
        Workflow(Step("a", lambda r: r, {"r": "nowhere"})).run(spark, {}, folder)
    with pytest.raises(ValueError):
        Workflow(Step("a", lambda r: r, {"r": "b"}), Step("b", lambda r: r, {"r": "a"})).run(spark, {}, folder)
