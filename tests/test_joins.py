"""Names inside texts, the keyword index, joins along an order and common nodes, each against a plain version."""

import json
import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quillmere.functions.replies import repaired
from quillmere.operators import graph, timejoins
from quillmere.operators.keyword_index import KeywordIndex, index_of
from quillmere.operators.names import covered, names_within


@pytest.mark.parametrize("block_chars", [1_000_000, 40])
def test_names_within(spark, block_chars):
    """With blocks of forty characters the texts are read once for every block."""
    rng = random.Random(5)
    texts = [(i, "".join(rng.choice("ab ") for _ in range(rng.randint(0, 60)))) for i in range(80)] + [(90, None), (91, ""), (92, "x" * 100_000 + "needle"), (None, "ab"), (1, "abab")]
    names = ["".join(rng.choice("ab ") for _ in range(rng.randint(1, 6))) for _ in range(40)] + ["needle", "", "a.b", "x" * 500]
    t = spark.createDataFrame(texts, "id long, text string")
    n = spark.createDataFrame([(x,) for x in names] + [(None,), (names[0],)], "name string")
    got = Counter((r.id, r.name) for r in names_within(t, n, block_chars).collect())
    assert got == Counter((i, x) for i, text in texts for x in set(names) if x and text and x in text)
    assert names_within(t, n.limit(0)).collect() == [] and names_within(t.limit(0), n).collect() == []


def test_covered_names(spark):
    rng = random.Random(6)
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(2, 4))) for _ in range(30)]
    texts = [(f"f{i % 3}", i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 12)))) for i in range(60)]
    named = {(f"f{i % 3}", 100 + i, rng.choice(words)) for i in range(40) for _ in range(rng.randint(1, 6))}
    got = {(r.folder, r.id, r.target, r.found) for r in covered(spark.createDataFrame(texts, "folder string, id long, text string"), spark.createDataFrame(list(named), "folder string, target long, name string"), 0.5).collect()}
    of = defaultdict(set)
    for f, t, n in named:
        of[f, t].add(n)
    want = {(f, i, t, sum(n in text for n in ns)) for f, i, text in texts for (g, t), ns in of.items() if f == g and sum(n in text for n in ns) >= 0.5 * len(ns)}
    assert want and got == want


def exhaustive(docs, queries, k, k1=1.5, b=0.75, floor=0.25):
    held = {i: re.findall(r"[^ \t\n\x0b\f\r]+", t or "") for i, t in docs}
    n, mean = len(docs), sum(map(len, held.values())) / max(len(docs), 1)
    df = Counter(w for ws in held.values() for w in set(ws))
    idf = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    low = floor * sum(idf.values()) / max(len(idf), 1)
    out = {}
    for q, t in queries:
        scores = {}
        for i, ws in held.items():
            tf = Counter(ws)
            asked = [w for w in (t or "").split() if w in tf]
            if asked:
                scores[i] = round(sum((idf[w] if idf[w] >= 0 else low) * tf[w] * (k1 + 1) / (tf[w] + k1 * (1 - b + b * len(ws) / mean)) for w in asked), 6)
        out[q] = [(i, s) for i, s in sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:k]]
    return out


def test_keyword_index_over_increments(spark):
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdef") for _ in range(rng.randint(1, 3))) for _ in range(60)]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 30)))) for i in range(1300)] + [(2000, None), (2001, ""), (2002, "zz " * 50_000)]
    queries = [(q, " ".join(rng.choice(words) for _ in range(rng.randint(1, 8)))) for q in range(300)] + [(900, "nowhere"), (901, ""), (902, "zz zz a")]
    d = spark.createDataFrame(docs, "id long, text string")
    q = spark.createDataFrame(queries, "query_id long, text string")
    index = KeywordIndex.build(d.where("id < 700"))
    index.append(d.where("id >= 700 and id < 1000")).append(d.where("id >= 1000"))
    got = defaultdict(list)
    for r in index.top_k(q, 7).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.id, r.score))
    want = {k: v for k, v in exhaustive(docs, queries, 7).items() if v}
    assert got.keys() == want.keys()
    for k in want:
        assert [s for _, s in got[k]] == pytest.approx([s for _, s in want[k]], abs=2e-6)
    assert sum(got[k] == want[k] for k in want) > 0.98 * len(want)  # sums in another order may differ in the last digit
    assert index.top_k(q.limit(0), 3).collect() == []


def test_an_index_is_built_once(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("id"), "text")
    assert index_of(docs).path == index_of(docs).path


@pytest.mark.parametrize("strict", [False, True])
def test_as_of(spark, strict):
    rng = random.Random(8)
    key = lambda: None if rng.random() < 0.05 else (0 if rng.random() < 0.5 else rng.randrange(6))
    left = [(key(), None if rng.random() < 0.05 else rng.randrange(100), i) for i in range(300)]
    right = [(key(), None if rng.random() < 0.05 else rng.randrange(100), i) for i in range(300)]
    schema = "k int, t int, i int"
    out = timejoins.as_of(spark.createDataFrame(left, schema).repartition(3), spark.createDataFrame(right, schema).repartition(3), "k", "t", "i", strict).collect()
    for r in out:
        before = [(t, i) for k, t, i in right if k == r.k and t is not None and r.t is not None and (t < r.t if strict else t <= r.t)]
        assert (None if r.matched is None else (r.matched.t, r.matched.i)) == max(before, default=None)
    assert Counter((r.k, r.t, r.i) for r in out) == Counter(left)


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_previous_rows(spark, keys):
    rng = random.Random(9)
    rows = [(rng.choice([None, 0, 0, 0, 1, 2]), rng.choice([None, *range(40)]), i) for i in range(400)]
    out = timejoins.previous_rows(spark.createDataFrame(rows, "k int, t int, i int").repartition(4), keys, ["t", "i"]).collect()
    order = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
    last, want = {}, {}
    for r in order:
        own = r[0] if keys else "all"
        want[r[2]] = last.get(own)
        last[own] = r[2]
    assert {r.i: None if r.before is None else r.before.i for r in out} == want


@pytest.mark.parametrize("width,part_rows", [(10.0, 100_000), (3.0, 5), (1000.0, 20)])
def test_points_in_intervals(spark, width, part_rows):
    rng = random.Random(10)
    key = lambda: None if rng.random() < 0.05 else (0 if rng.random() < 0.6 else rng.randrange(4))
    some = lambda: None if rng.random() < 0.05 else rng.randrange(-30, 60)
    intervals = [(key(), some(), some(), i) for i in range(100)]
    points = [(key(), some(), i) for i in range(300)]
    out = timejoins.points_in_intervals(spark.createDataFrame(intervals, "k int, low int, high int, i int"), spark.createDataFrame(points, "k int, t int, p int"), "k", "low", "high", "t", width, part_rows)
    want = Counter((i, p) for k, a, b, i in intervals for j, t, p in points if None not in (k, a, b, t) and k == j and a <= t <= b)
    assert want and Counter((r.i, r.point.p) for r in out.collect()) == want


def test_common_nodes(spark):
    rng = random.Random(11)
    for size in (5, 12, 30):
        nodes = [f"d{i:02d}" for i in range(size)] + [f"e{i:02d}" for i in range(size)]
        edges = {(rng.choice(nodes), rng.choice(nodes)) for _ in range(int(size * 1.6))}
        reach = {n: {n} for n in nodes}
        for _ in nodes:
            for a, b in edges:
                reach[a] |= reach[b]
        want = set()
        for n in nodes:
            met = sorted({d for d in nodes if d[0] == "d" and (n in reach[d] or d in reach[n])})
            if n[0] == "e" and len(met) > 1:
                want.add((n, met[0], met[1]))
        e = spark.createDataFrame(list(edges), "src string, dst string")
        d = spark.createDataFrame([(n,) for n in nodes if n[0] == "d"], "id string")
        assert {tuple(r) for r in graph.common_nodes(e, d).collect()} == want


def test_replies_cut_anywhere():
    whole = {"a": [1, {"b": "x } ] \" y"}, "z"], "c": {"d": [True, None]}, "e": "f"}
    text = json.dumps(whole)
    assert json.loads(repaired(f"Sure! ```json\n{text}\n``` done")) == whole
    for cut in range(1, len(text)):
        got = json.loads(repaired(text[:cut]))
        assert isinstance(got, dict) and got.keys() <= whole.keys()
    assert repaired("none") is None and repaired(None) is None and repaired("") is None
    assert json.loads(repaired('{"x": 1, "y": [1, 2')) == {"x": 1, "y": [1, 2]}


def test_common_items_in_blocks(spark, monkeypatch):
    import random
    from itertools import combinations

    from quillmere.operators import relations as J

    monkeypatch.setattr(J, "HOLDERS", 16)
    draw = random.Random(3)
    sets = {i: {"everywhere", *draw.sample([f"w{n}" for n in range(400)], draw.randint(0, 4))} for i in range(240)}
    rows = [("f" if i % 3 else "g", i, w) for i, s in sets.items() for w in s]
    items = spark.createDataFrame(rows, "folder string, id long, item string")
    folder = {i: f for f, i, _ in rows}
    every = {(a, b): len(sets[a] & sets[b]) for a, b in combinations(sets, 2) if folder[a] == folder[b]}
    for least in (1, 2, 3):
        want = {(*p, n) for p, n in every.items() if n >= least}
        assert {(r.a, r.b, r.shared) for r in J.shared_items(items, least).collect()} == want
    found = J._meet(J._rarest(J._held(items), F.col("n") - 1)).count()
    assert found < len(every) / 20
    alike = {p for p in every if len(sets[p[0]] & sets[p[1]]) / len(sets[p[0]] | sets[p[1]]) > 0.5}
    assert {(r.a, r.b) for r in J.jaccard_pairs(items, 0.5).collect()} == alike
    assert J.shared_items(items.limit(0), 2).count() == 0


def test_pairs_of_sets_in_blocks(spark, monkeypatch):
    """What leaves a task are kept pairs only, whatever blocks, tiles and frequent items are."""
    from itertools import combinations

    from quillmere.operators import relations as J

    for name, value in {"BLOCK_ROWS": 40, "BLOCKS": 2, "MOST_ROWS": 60, "CELLS": 500}.items():
        monkeypatch.setattr(J, name, value)
    draw = random.Random(12)
    words = [f"w{n}" for n in range(60)]
    sets = {i * 3: set(draw.sample(words, draw.randint(0, 12))) | ({"everywhere"} if i % 9 else set()) for i in range(160)}
    folder = {i: None if i % 31 == 0 else "f" if i % 4 else "g" for i in sets}
    df = spark.createDataFrame([(folder[i], i, sorted(s)) for i, s in sets.items()], "folder string, id long, set array<string>")
    every = {(folder[a], a, b): len(sets[a] & sets[b]) for a, b in combinations(sets, 2) if folder[a] == folder[b] and folder[a] and sets[a] and sets[b]}
    assert {(r.folder, r.a, r.b, r.shared) for r in J.jaccard_of_sets(df, 0.3).collect()} == {(*p, n) for p, n in every.items() if n / (len(sets[p[1]] | sets[p[2]])) > 0.3}
    want = set()
    for f in "fg":
        ratios = sorted((-n / min(len(sets[a]), len(sets[b])), a, b) for (g, a, b), n in every.items() if g == f and n >= 2)
        want |= {(f, a, b, -r) for r, a, b in ratios if r < -0.1} & {(f, a, b, -r) for r, a, b in ratios[:10]}
    got = J.most_alike(df, 10, 2, 0.1)
    assert {(r.folder, r.a, r.b, r.ratio) for r in got.collect()} == want
    assert J.jaccard_of_sets(df.limit(0), 0.3).count() == 0


@pytest.mark.parametrize("pairs", [20_000_000, 3])
def test_pointed_at_once(spark, monkeypatch, pairs):
    from quillmere.operators import relations as J

    monkeypatch.setattr(J, "PAIRS", pairs)
    draw = random.Random(13)
    files = {i: f"doc_{i}.pdf" for i in range(40)}
    said = {(i, draw.choice(["doc_1", "doc_2", "doc_13", "doc_", "pdf", "see_doc_7.pdf_and_doc_8.pdf", "none"])) for i in range(30) for _ in range(3)}
    points = {(r, t, f) for _, r in said for t, f in files.items() if r in f or f in r}
    got = Counter(tuple(r) for r in J.pointed_at(spark.createDataFrame(list(said), "id long, ref string"), spark.createDataFrame(list(points), "ref string, target long, file string")).collect())
    assert got == Counter({(i, t) for i, r in said for x, t, _ in points if x == r and i != t})


def test_titles_alone_are_looked_for(spark, sf_dir, monkeypatch):
    from quillmere.plans import relations as plan

    asked = []
    monkeypatch.setattr(plan, "names_within", lambda texts, names: asked.append(names) or names_within(texts, names))
    assert plan.name_mention(spark, sf_dir).count() > 0
    assert asked[0].where("name like '%.txt'").count() == 0


def test_similar_pairs_some_rows_at_a_time(spark, monkeypatch):
    import numpy as np

    from quillmere.operators import retrieval

    monkeypatch.setattr(retrieval, "VECTOR_BLOCK", 60)
    monkeypatch.setattr(retrieval, "PAIR_ROWS", 7)
    rows = np.random.default_rng(14).normal(size=(150, 4))
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    want = {(a, b) for a in range(150) for b in range(a + 1, 150) if unit[a] @ unit[b] > 0.8}
    got = [(r.a, r.b) for r in retrieval.similar_pairs(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "id long, vector array<double>"), 0.8).collect()]
    assert len(got) == len(set(got)) and set(got) == want
