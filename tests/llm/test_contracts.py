"""The registered queries against plain-Python versions of their contracts."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from brute import base_scores, base_spans, best_edits, chat, components, quality, remove_repeats, shingle_set, targets, words
from pyspark.sql import functions as F

from quillmere.llm import decontaminate, html_text, langid, lm, mixing, pii, similar, simhash, substring
from quillmere.llm import queries as q


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source", "lang").collect()]


NASTY = [
    (1, None),
    (2, ""),
    (3, "   \n\t "),
    (4, "one"),
    (5, "one two"),
    (6, "É " * 40 + "tail"),
    (6, "É " * 40 + "tail"),
    (None, "no id here at all but some words follow it anyway yes"),
    (None, "no id here at all but some words follow it anyway yes"),
    (8, "a b c d e f g h i j k l m n o p q r s t u v w x y z " * 3),
    (9, "x" * 5000),
    (10, "line one two three four\nline one two three four\n\n \nline one two three four"),
    (11, "mail a.b@c.d_e@f.gh, ip 1.2.3.4.5.6.7.8 and 300.1.1.1 card 4111 1111 1111 1111 or 4111-1111-1111-1112 call +1 (743) 555-3824 x"),
    (12, "😀 a@b.co 😀 +49 30 1234567 token = \"24be64439e3e49cf46b2d7c90f3602a3d0b907ff\" 0010.020.003.255"),
    (13, "(at) me [at] home dot com joe [at] example [dot] com 743-555-3824 call"),
    (14, "1" * 4000 + " " + "1.2.3." * 300 + " " + "a.b" * 400 + "@" + " +" + "1 " * 500),
]


def nasty(spark):
    rows = [(i, t, "s", 0) for i, t in NASTY]
    return spark.createDataFrame(rows, "doc_id long, text string, kept string, h int")


def test_lm_base_and_gain(spark, sf_dir, docs):
    out = {r.doc_id: r for r in q.op1_lm_scoring(spark, sf_dir).collect()}
    want = base_scores([d[:2] for d in docs])
    assert len(out) == len(docs)
    for (i, *_), (held, n, known, total, base) in zip(docs, want):
        r = out[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total)
        assert r.base_score == pytest.approx(base, rel=1e-9)
    held = [r for r in out.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_lm_probabilities_add_up():
    model = lm.LogBilinear.fresh(np.array([0.5, 0.3, 0.2]), 4, 1)
    one, two, norm = model.tables()
    for a in range(4):
        for b in range(4):
            assert np.exp(one[a] + two[b] - norm[a, b]).sum() == pytest.approx(1, rel=1e-5)


def test_lm_scores_by_brute_force(spark):
    """Every word's probability after a context, written out, adds up to one and makes up the scores."""
    rng = random.Random(6)
    vocabulary = ["".join(rng.choice("abcde") for _ in range(rng.randint(1, 4))) for _ in range(60)]
    rows = [(i, " ".join(rng.choice(vocabulary[: 10 + i % 50]) for _ in range(rng.randint(0, 40)))) for i in range(80)]
    small = lm.Settings(own_classes=12, ending_classes=5, dimensions=4, rounds=2, shards=2, held_words=20)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    learn = F.col("doc_id") < 60
    counts = lm.count_words(df.where(learn).select("text"), small.ending_classes).cache()
    trained = lm.fit(df.where(learn).select("text"), counts, small)
    c = {bytes(r.word): r.c for r in counts.collect()}
    own = {w: k for w, k in zip(trained.held, trained.held_class.tolist()) if k < trained.own}
    of = lambda w: own.get(w, trained.own + lm.ending_class(w, small.ending_classes))
    members = defaultdict(list)
    for w in c:
        members[of(w)].append(w)
    model = trained.model
    start = len(model.context) - 1

    def chance(second, last):
        logits = model.context[second] @ model.weights[0] @ model.output.T + model.context[last] @ model.weights[1] @ model.output.T + model.bias
        p = np.exp(logits - logits.max())
        return p / p.sum()

    whole = lambda k: sum(c[m] + 1 for m in members[k]) + 1
    share = lambda w: 1.0 if of(w) < trained.own else (c.get(w, 0) + 1) / whole(of(w))
    for second, last in ((start, start), (0, 3), (start, 13)):
        p = chance(second, last)
        # The words seen in training, and one more of each shared class for all that were not.
        total = sum(p[of(w)] * share(w) for w in {*c, *own}) + sum(p[k] / whole(k) for k in range(trained.own, len(p)))
        assert total == pytest.approx(1, rel=1e-4)
    got = {r.id: r.score for r in lm.score_texts(df, learn, settings=small).collect()}
    for i, t in rows:
        tokens, want, second, last = [*t.lower().encode().split(), lm.END], 0.0, start, start
        for w in tokens:
            want += np.log10(chance(second, last)[of(w)] * share(w))
            second, last = last, of(w)
        assert got[i] == pytest.approx(want, rel=1e-4, abs=1e-3)


def test_lm_edges(spark):
    small = lm.Settings(own_classes=8, ending_classes=4, dimensions=4, rounds=1, shards=2, held_words=5)
    from quillmere.llm.common import id_remainder

    out = lm.score_texts(nasty(spark), id_remainder("doc_id", 7) != 2, settings=small).collect()
    want = base_scores(NASTY)
    key = lambda r: tuple(-1e18 if x is None else x for x in r)
    got = sorted([(r.id, r.held_out, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in out], key=key)
    assert got == sorted([(i, h, n, k, round(b, 6)) for (i, _), (h, n, k, _, b) in zip(NASTY, want)], key=key)
    assert lm.score_texts(nasty(spark).limit(0), F.lit(True), settings=small).collect() == []


def test_substring(spark, sf_dir, docs):
    out = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in q.op2_substring_dedup(spark, sf_dir).collect()}
    assert out == dict(zip([d[0] for d in docs], remove_repeats([d[1] for d in docs])))


@pytest.mark.parametrize("window,seed", [(5, None), (7, 2), (35, None), (20, 5), (1, None)])
def test_substring_edges(spark, window, seed):
    rng = random.Random(window)
    rows = [*NASTY, *[(100 + i, " ".join(rng.choice("ab") for _ in range(rng.randint(0, 60)))) for i in range(30)]]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r.id, r.n_words, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in substring.remove_repeats(df, window=window, seed_words=seed).collect())
    assert got == Counter((i, *r) for (i, _), r in zip(rows, remove_repeats([t for _, t in rows], window)))
    assert substring.remove_repeats(df.limit(0)).collect() == []


def test_decontamination(spark, sf_dir, docs):
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    got = {(r.doc_id, r.item_id) for r in q.op3_decontamination(spark, sf_dir).collect()}
    norm = decontaminate.normalised
    exact = {(d[0], i) for d in docs for i, t in items if norm(t) in norm(d[1] or "")}
    assert exact and exact <= got


def test_decontamination_by_edits(spark):
    rng = random.Random(4)
    abc = "abcdefghij klmnop"
    item = lambda n: "".join(rng.choice(abc) for _ in range(n)).strip()
    items = [(k, item(n)) for k, n in enumerate((3, 9, 30, 60, 61, 120, 200))] + [(90, None), (91, "")]

    def edited(text, edits):
        t = list(text)
        for _ in range(edits):
            p = rng.randrange(len(t))
            roll = rng.random()
            if roll < 0.4:
                t[p] = "z"
            elif roll < 0.7:
                del t[p]
            else:
                t.insert(p, "y")
        return "".join(t)

    rows = [(0, None), (1, ""), (2, items[0][1]), (3, " ".join(t or "" for _, t in items))]
    for n in range(60):
        k = rng.randrange(1, 7)
        t = items[k][1]
        rows.append((10 + n, f"{item(rng.randrange(80))} {edited(t, rng.randrange(0, 2 + len(t) // 10))} {item(rng.randrange(80))}".strip()))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.id, r.item): r for r in decontaminate.find_items(df, bench).collect()}
    norm = decontaminate.normalised
    want = {}
    for i, t in rows:
        for k, b in items:
            b, x = norm(b or ""), norm(t or "")
            if not b or not x:
                continue
            e = best_edits(b, x) if len(b) >= decontaminate.GRAM else (0 if b == x else 9)
            if e <= decontaminate.edit_budget(len(b)):
                want[i, k] = e
    assert {k: r.edits for k, r in got.items()} == want
    clean = {r.doc_id for r in decontaminate.drop_contaminated(df, bench).collect()}
    assert clean == {i for i, _ in rows} - {i for i, _ in want}


def test_decontamination_with_shared_stems():
    rng = random.Random(21)
    letters = "abcdefghij klmnop"
    some = lambda n: "".join(rng.choice(letters) for _ in range(n)).strip() or "a"
    for front in (True, False):
        stem = some(77)
        tails = [some(38) for _ in range(1300)]
        items = decontaminate.Items([(i, f"{stem} {t}" if front else f"{t} {stem}") for i, t in enumerate(tails)])
        parts = [stem if n % 3 else some(60) for n in range(210)]
        held = {7: items.texts[7], 1234: items.texts[1234][:50] + "zz" + items.texts[1234][53:]}
        parts[100], parts[200] = held.values()
        found = {(i, e) for _, i, _, _, e in items.search([decontaminate.normalised(" ".join(parts)), "nothing here"])}
        assert {i for i, _ in found} == set(held) and (7, 0) in found


def test_decontamination_edges(spark):
    rows = [(1, None, "x", 1), (2, "", "x", 1), (3, "the very text of the item, word by word", "x", 1), (3, "the very text of the item, word by word", "x", 1), (4, "padding " * 200_000 + "the very text of the item, word by word", None, 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, item_id string, start int")
    bench = spark.createDataFrame([(9, "The very text of the item,  word by word", 1), (10, None, 1), (11, "", 1)], "item_id long, text string, doc_id int")
    assert sorted((r.id, r.item, r.edits) for r in decontaminate.find_items(df, bench).collect()) == [(3, 9, 0), (3, 9, 0), (4, 9, 0)]
    assert sorted(r.doc_id for r in decontaminate.drop_contaminated(df, bench).collect()) == [1, 2]
    assert decontaminate.find_items(df, bench.limit(0)).count() == 0 and decontaminate.drop_contaminated(df, bench.limit(0)).count() == 5
    assert decontaminate.drop_contaminated(df.limit(0), bench).collect() == []


def test_simhash(spark, sf_dir, docs):
    got = sorted((r.doc_id, r.fingerprint, r.component_id) for r in q.op4_simhash(spark, sf_dir).collect())
    assert got == sorted(components([d[:2] for d in docs]))


def test_simhash_edges(spark):
    rng = random.Random(2)
    base = [rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(200)]
    rows = [*NASTY]
    for i in range(40):
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(200)] = "new"
        rows.append((200 + i, " ".join(w)))
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, fp int")
    key = lambda r: tuple("" if x is None else str(x) for x in r)
    got = sorted([(r.id, f"{r.fp & (1 << 64) - 1:016x}", r.component_id) for r in simhash.near_duplicates(df).collect()], key=key)
    assert got == sorted(components(rows), key=key)
    assert simhash.near_duplicates(df.limit(0)).collect() == []


def test_similar_stage(spark):
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    rows, groups = [], []
    for g in range(60):
        w = [rng.choice(vocabulary) for _ in range(300)]
        own = [(1000 * g, " ".join(w))]
        if g % 2:
            for c in range(1, 4):
                x = list(w)
                for _ in range(rng.choice([0, 1, 2, 3])):
                    x[rng.randrange(300)] = rng.choice(vocabulary)
                own.append((1000 * g + c, " ".join(x).upper()))
        rows += own
        groups.append(own)
    rows += [(7, None), (8, None), (9, ""), (None, "lonely text"), (0, rows[0][1])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, sketch string")
    kept = similar.keep_one_of_similar(df)
    assert kept.columns == df.columns
    ids = Counter(r.doc_id for r in kept.collect())
    for own in groups:
        assert ids[own[0][0]] == 1
        for i, t in own[1:]:
            a, b = shingle_set(own[0][1]), shingle_set(t)
            if len(a & b) / len(a | b) >= 0.82:
                assert i not in ids
    assert ids[7] == 1 and ids[8] == ids[9] == 0 and ids[None] == 1
    assert similar.keep_one_of_similar(df.limit(0)).count() == 0


def test_similar_stage_keeps_what_is_less_alike(spark):
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 9))) for _ in range(4000)]
    rows, alike = [], {}
    for g in range(60):
        w = [rng.choice(vocabulary) for _ in range(300)]
        x = list(w)
        for at in rng.sample(range(300), rng.randint(6, 11)):
            x[at] = rng.choice(vocabulary)
        rows += [(2 * g, " ".join(w)), (2 * g + 1, " ".join(x))]
        a, b = shingle_set(rows[-2][1]), shingle_set(rows[-1][1])
        alike[2 * g + 1] = len(a & b) / len(a | b)
    kept = {r.doc_id for r in similar.keep_one_of_similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept >= {2 * g for g in range(60)} | {i for i, j in alike.items() if j < 0.8}
    assert len(kept) < len(rows)


def test_similar_stage_pairs_crowded_buckets_wholly(spark):
    """One set of words in many orders: all fingerprints of the word set are equal, two orders at a time are alike."""
    rng = random.Random(12)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(80)]
    rows = []
    for g in range(30):
        w = rng.sample(vocabulary, len(vocabulary))
        rows += [(2 * g, " ".join(w)), (2 * g + 1, " ".join([*w[:-2], w[-1], w[-2]]))]
    kept = {r.doc_id for r in similar.keep_one_of_similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == {2 * g for g in range(30)}


def test_similar_stage_finds_added_text_and_short_texts(spark):
    rng = random.Random(13)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(4000)]
    rows = []
    for g in range(300):
        n = rng.randint(10, 20) if g % 2 else rng.randint(30, 500)
        w = [rng.choice(vocabulary) for _ in range(n)]
        x = [*w, *(rng.choice(vocabulary) for _ in range(1 + int(rng.random() * 0.25 * (n - 4))))]
        rows += [(2 * g, " ".join(w)), (2 * g + 1, " ".join(x))]
    kept = {r.doc_id for r in similar.keep_one_of_similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = [shingle_set(t) for _, t in rows]
    alike = {i for i, _ in rows[1::2] if len(sets[i - 1] & sets[i]) >= 0.8 * len(sets[i - 1] | sets[i])}
    assert len(alike) > 200 and kept == {i for i, _ in rows} - alike


def test_similar_stage_compares_what_shares_much_but_too_little(spark):
    """A crowd of one frame, 0.7 alike, in which two at a time are near copies."""
    rng = random.Random(14)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(4000)]
    frame, rows = [rng.choice(vocabulary) for _ in range(150)], []
    for g in range(40):
        w = [*frame, *(rng.choice(vocabulary) for _ in range(30))]
        rows += [(2 * g, " ".join(w)), (2 * g + 1, " ".join([*w, rng.choice(vocabulary)]))]
    kept = {r.doc_id for r in similar.keep_one_of_similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == {2 * g for g in range(40)}


def test_similar_stage_settles_one_large_group(spark):
    """Thousands of copies of one text, edited more and less, against all pairs."""
    rng = random.Random(16)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(4000)]
    base = [rng.choice(vocabulary) for _ in range(120)]
    rows = []
    for i in range(2000):
        w = list(base)
        for _ in range(rng.choice([1, 1, 1, 2, 2, 3, 5])):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        rows.append((i, " ".join(w)))
    sets = [shingle_set(t) for _, t in rows]
    number = {g: k for k, g in enumerate(sorted(set().union(*sets)))}
    holds = np.zeros((len(rows), len(number)), np.float32)
    for i, own in enumerate(sets):
        holds[i, [number[g] for g in own]] = 1
    both, size = holds @ holds.T, holds.sum(1)
    linked = both + 1e-6 >= 0.8 * (size[:, None] + size[None, :] - both)
    root = np.arange(len(rows))
    while True:
        least = np.where(linked, root[None, :], len(rows)).min(1)
        if (least == root).all():
            break
        root = least
    kept = {r.doc_id for r in similar.keep_one_of_similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = set(root.tolist())
    assert 1 < len(want) < 1500 and want <= kept
    assert len(kept - want) <= 0.01 * (len(rows) - len(want))


def test_similar_stage_ties(spark):
    rows = [(1, "one text of nine words that stands quite alone"), (1, "one text of nine words that stands quite alone"), (1, "One text of nine words that stands quite alone"), (1, "another text under the very same id as the first"), (None, None), (None, ""), (2, "one  text of nine words that stands quite alone")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = Counter((r.doc_id, " ".join((r.text or "").lower().split())) for r in similar.keep_one_of_similar(df).collect())
    assert kept == Counter([(1, rows[0][1]), (1, rows[3][1]), (None, "")])


def test_min_hash_bands_collide_as_often_as_sets_are_alike():
    rng = np.random.default_rng(15)
    hits = []
    for n in (10, 100):
        for _ in range(150):
            x = rng.integers(0, 1 << 63, n + n // 5, dtype=np.uint64)
            one, two = similar.min_hash_bands([x[:n], x[n // 5 :]], 40, 1)
            hits.append((one == two).mean())
    assert abs(np.mean(hits) - 2 / 3) < 0.02


def test_sketch_bounds_enclose_the_threshold():
    for similarity in (0.5, 0.8, 0.95):
        sure, possible = similar.sketch_bounds(similarity, 1024)
        assert 0 <= sure < possible < 1024


def test_language_of_one_copied_text_has_a_model(spark):
    rows = [(lang, text) for i in range(12) for lang, text in [(f"l{i}", f"only text of language {chr(97 + i)} and nothing else " * 20)] for _ in range(50)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, lang string, text string")
    for id_col in (None, "doc_id"):
        models = langid.fit(df, "text", "lang", sample_chars=900, id_col=id_col)
        assert models.languages == sorted({lang for lang, _ in rows})


def test_mixing(spark, sf_dir, docs):
    out = q.op5_mixing(spark, sf_dir).collect()
    sizes = defaultdict(int)
    for _, t, s, _ in docs:
        sizes[s] += len(words(t))
    want = targets(sizes)
    source, size = {d[0]: d[2] for d in docs}, {d[0]: len(words(d[1])) for d in docs}
    taken = defaultdict(int)
    assert len(out) == len(docs)
    for r in out:
        s = source[r.doc_id]
        assert r.size == size[r.doc_id] and r.source_size == sizes[s] and r.target == pytest.approx(want[s])
        assert 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)
    assert sorted(out) == sorted(q.op5_mixing(spark, sf_dir).collect())


def test_mixing_edges(spark):
    rows = [(1, "a b c", None, 5), (1, "a b c", None, 5), (None, "d", "x", 6), (2, None, "x", 7), (3, "w " * 500, "y", 8), (4, "", "z", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    out = mixing.mix_sources(df)
    assert out.columns == ["doc_id", "text", "source", "size", "size_", "source_size", "target", "taken"]
    got = out.collect()
    assert len(got) == len(rows)
    want = targets({None: 6, "x": 1, "y": 500, "z": 0})
    for r in got:
        assert r.target == pytest.approx(want[r.source]) and r.taken <= 2 * r.size_
    assert mixing.mix_sources(df.limit(0)).collect() == []


def test_language(spark, sf_dir, docs):
    out = {r.doc_id: r for r in q.op6_language_id(spark, sf_dir).collect()}
    assert len(out) == len(docs)
    right = total = 0
    for i, t, _, lang in docs:
        r = out[i]
        assert r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1
        if not any(c.isalpha() for c in t or ""):
            assert r.lang_pred == "und"
        elif r.held_out and len(t) > 20:
            right, total = right + (r.lang_pred == lang), total + 1
    assert right / total > 0.97


def test_language_model_is_normalised():
    models = langid.Models({"a": ["abc abd abe", "bab"], "b": ["ccc ddd"]})
    import numpy as np

    alphabet = sorted(set("abcde "))
    for context in ("abc", "zz a", "bab"):
        for j in range(2):
            total = 0.0
            for ch in alphabet:
                codes, owner = langid.letters([context + ch if ch != " " else context + " q"])
                hashes = {o: langid._hashes(codes, owner, o) for o in range(1, langid.ORDER + 1)}
                total += float(np.exp(models._logs(hashes, np.array([len(context) + 1]), langid.ORDER)[0, j]))
            assert total <= 1.0001


def test_language_edges(spark):
    df = spark.createDataFrame([(i, t, "xx" if i != 4 else None) for i, t in NASTY], "doc_id long, text string, lang string")
    out = langid.identify(df, F.lit(True)).collect()
    assert len(out) == len(NASTY)
    assert {r.lang_pred for r in out if r.id in (1, 2, 3)} == {"und"} and {r.lang_pred for r in out if r.id == 6} == {"xx"}
    assert langid.identify(df.limit(0), F.lit(True)).collect() == []
    assert {r.lang_pred for r in langid.identify(df, F.lit(False)).collect()} == {"und"}


def digest(spans):
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()


def test_pii(spark, sf_dir, docs):
    out = {r.doc_id: r for r in q.op7_pii(spark, sf_dir).collect()}
    assert len(out) == len(docs)
    for i, t, *_ in docs:
        want, r = base_spans(t), out[i]
        assert r.base_sha256 == digest(want), (i, want, r)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == kind for k, *_ in want) for kind in ("email", "ip", "card", "phone"))
        got = r.spans.split(",") if r.spans else []
        assert {f"{k}:{s}:{e}" for k, s, e in want} <= set(got)


def test_long_arrays(spark):
    from quillmere.llm.arrays import cut, fold, running

    rng = random.Random(3)
    lists = [[], [5], *[[rng.randrange(100) for _ in range(n)] for n in (255, 256, 257, 1000)]]
    texts = ["", "ab", "é😀x" * 70_000]
    spans = [(a, rng.randrange(a, 210_001)) for a in (rng.randrange(210_000) for _ in range(30))] + [(0, 210_000), (65_536, 131_072), (7, 7), (210_000, 210_000)]
    add = lambda x, y: x + y
    out = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "i int, x array<int>").select(
        "i",
        running(F.col("x"), add, F.lit(0)).alias("sums"),
        running(F.col("x"), F.greatest, F.lit(0)).alias("tops"),
        fold(F.col("x"), F.lit(0), lambda at, x: F.struct(F.greatest(at, x).alias("state"), F.when(x > at, F.array(x)).otherwise(F.array_repeat(x, 0)).alias("out")), "int").alias("rises"),
    )
    for r in out.collect():
        x = lists[r.i]
        assert r.sums == [sum(x[:k]) for k in range(len(x))] and r.tops == [max(x[:k], default=0) for k in range(len(x))]
        assert r.rises == [v for k, v in enumerate(x) if v > max(x[:k], default=0)]
    cuts = spark.createDataFrame([(i, t, [s for s in spans if s[1] <= len(t)]) for i, t in enumerate(texts)], "i int, t string, s array<struct<start:int,end:int>>")
    for r in cuts.select("i", "s", cut(F.col("t"), F.col("s")).alias("c")).collect():
        assert r.c == [texts[r.i][s.start : s.end] for s in r.s]


def test_pii_of_a_long_text(spark):
    text = " ".join(f"a{i}@b{i}.example.org and 10.0.{i % 250}.7" for i in range(1_000))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    (r,) = pii.find_spans(df).collect()
    assert [(pii.KINDS[s.kind], s.start, s.end) for s in r.base] == base_spans(text)
    (r,) = pii.redact(df).collect()
    assert r.text == " ".join(["[EMAIL] and [IP]"] * 1_000)


def test_pii_edges(spark):
    rows = {(r.id, len(r.base)): [(pii.KINDS[s.kind], s.start, s.end) for s in r.base] for r in pii.find_spans(nasty(spark)).collect()}
    for i, t in NASTY:
        want = base_spans(t)
        assert rows[i, len(want)] == want
    text = {r.doc_id: r.text for r in pii.redact(nasty(spark)).collect()}
    assert text[11].startswith("mail [EMAIL][EMAIL], ip [IP].[IP] and 300.1.1.1 card [CARD] or ") and text[11].endswith(" call [PHONE] x")
    assert "[SECRET]" in text[12] and text[1] is None and text[4] == "one"
    assert pii.redact(nasty(spark)).columns == nasty(spark).columns
    assert pii.redact(nasty(spark).limit(0)).collect() == [] and pii.find_spans(nasty(spark).limit(0)).collect() == []


def test_html_field_on_fresh_pages():
    right = total = 0
    for html, main in html_text.labelled_pages(80, seed=1234):
        got = html_text.main_text(html, html_text.trained_field())
        total += 1
        right += got == main
    assert right / total > 0.85


def test_html_pages(spark, sf_dir):
    import html as h
    import re

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    for r in q.op8_html_text(spark, sf_dir).collect():
        m = re.search(r"<article>(.*?)(</article>|$)", pages[r.page_id], re.S)
        want = " ".join(h.unescape(re.sub(r"<[^>]*>", " ", m[1])).split())
        assert r.text == want and r.n_chars == len(want)


PROSE = "The body of it, which is long enough to be prose."


@pytest.mark.parametrize(
    "page,want",
    [
        (f"<head><title>T</title><meta charset=utf-8><body><article><h1>Some title here</h1><p>{PROSE}</p></article>", f"Some title here {PROSE}"),
        (f"<!doctype html><title>T</title><article><p>{PROSE}</p></article>", PROSE),
        (f"<head><title>T</title><style>p{{}}</style><article><p>{PROSE}</p></article>", PROSE),
        (f"<body><nav><ul><li><a href=x>a</a></ul></nav><select><option>q<option>r<article><p>{PROSE}</p></article></body>", PROSE),
        (f"<body><button>Menu<article><p>{PROSE}</p><button>Go</button></article></body>", PROSE),
        (f"<body><article><svg><text>x</text></svg><noscript><p>none</p></noscript><p>{PROSE}</p></article>", PROSE),
        (f"<body><article><header><h1>Some title here</h1><p class=byline>by me</p></header><p>{PROSE}</p></article><footer>x</footer>", f"Some title here {PROSE}"),
        (f"<body><header><h1>Site</h1></header><article><p>{PROSE}</p></article>", PROSE),
        (f"<article><p>{PROSE}</p></article><script>var a = '<p>{PROSE}</p>'", PROSE),
    ],
)
def test_html_missing_end_tags(page, want):
    assert html_text.main_text(page, html_text.trained_field()) == want


@pytest.mark.parametrize("unit", [f"<font><p>{PROSE}</p>", f"</b><p>{PROSE}", f"<div class=a><p>{PROSE}</p>", f"<svg><p>{PROSE}</p>"])
def test_html_very_long_pages(unit):
    page = f"<article>{unit * (5_000_000 // len(unit))}</article>"
    assert html_text.main_text(page, html_text.trained_field()).count(PROSE) == page.count(PROSE)


def test_html_clashing_columns(spark):
    df = spark.createDataFrame([(1, "u", f"<article><p>{PROSE}</p></article>", "x", 5), (1, "u", f"<article><p>{PROSE}</p></article>", None, 5)], "page_id long, url string, html string, text string, id int")
    assert [tuple(r) for r in html_text.extract_main_text(df).collect()] == [(1, "u", PROSE)] * 2


def test_html_edges(spark):
    df = spark.createDataFrame([(1, None, None), (2, "u", ""), (3, "u", "<p>"), (4, "u", "<article><p>a&amp;b <i>c</i>d<br>e</p><script>x</script></article><p><"), (4, "u", "plain")], "page_id long, url string, html string")
    out = [(r.id, r.text) for r in html_text.extract_main_text(df).collect()]
    assert out[:4] == [(1, ""), (2, ""), (3, ""), (4, "a&b cd e")]
    assert html_text.extract_main_text(df.limit(0)).collect() == []


def test_quality(spark, sf_dir, docs):
    out = {r.doc_id: r for r in q.op9_quality_rules(spark, sf_dir).collect()}
    for i, t, *_ in docs:
        r = out[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == quality(t)
        assert not (r.kept and r.base_failed)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    good = [out[i] for i, g in labels.items() if g == 1 and not out[i].base_failed]
    assert sum(r.kept for r in good) >= 0.99 * len(good)


def test_quality_edges(spark):
    from quillmere.llm.quality import assess, keep_good

    df = nasty(spark)
    got = Counter(tuple(r)[:7] for r in assess(df).collect())
    assert got == Counter((i, *quality(t)) for i, t in NASTY)
    assert assess(df.limit(0)).collect() == [] and keep_good(df.limit(0)).columns == df.columns
    kept = Counter(r.doc_id for r in keep_good(df).collect())
    assert kept == Counter(r.id for r in assess(df).collect() if r.kept)


def test_chat(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    said = "</s>[INST] ok [/INST]"
    want = chat([*rows, (-1, 0, "user", said), (-1, 1, "assistant", said)])
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in q.op10_chat_format(spark, sf_dir).collect()}
    assert got == want


def test_chat_edges(spark):
    from quillmere.llm.chat import CONTROLS, format_chats, read_back

    nasty_texts = ["", None, "%3C %253C %25 %", "".join(CONTROLS), "a\nb", "%", "%2", "5B[INST]", "😀<|im_end|>"]
    rows = [(k % 3 if k % 5 else None, k % 4, ["user", "assistant", None, "odd\nrole<|turn|>", "assistant"][k % 5], nasty_texts[k % len(nasty_texts)], 1) for k in range(60)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, turns int")
    want = chat([r[:4] for r in rows])
    for r in read_back(format_chats(df)).collect():
        n, sha, chars, loss = want[r.conv_id]
        assert len(r.turns) == n and hashlib.sha256("".join(f"{t.role}\n{t.text}\n" for t in r.turns).encode()).hexdigest() == sha
        assert len(r.loss_text) == chars and hashlib.sha256(r.loss_text.encode()).hexdigest() == loss
    assert format_chats(df.limit(0)).collect() == []


def test_chat_of_a_long_conversation(spark):
    from quillmere.llm.chat import format_chats, read_back

    rows = [(1, k, ["user", "assistant", "assistant"][k % 3], f"turn {k} [INST] " * 5) for k in range(3_000)]
    (r,) = read_back(format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()
    assert [(t.role, t.text) for t in r.turns] == [(x[2], x[3]) for x in rows]
    assert r.loss_text == "".join(x[3] for x in rows if x[2] == "assistant")
