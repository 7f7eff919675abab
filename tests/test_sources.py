"""Files of a folder, elements of marked-up texts, sketches that merge."""

from pyspark.sql import functions as F

from quillmere.operators.mmr import select
from quillmere.operators.retrieval import vector_top_k
from quillmere.operators.sketches import rolled_up, sketched
from quillmere.sources.elements import csv_elements, markdown_elements, xml_elements
from quillmere.sources.folder import FolderSource, PruningReader


def _elements(df):
    return [(r.id, r.category, r.text) for r in df.orderBy("id", "position").collect()]


def test_markdown(spark):
    texts = [
        (1, "# Top\nOne line\nand one more\n\nNext.\n* a\n- b\n3) c\n|x|y|\n|1|2|\n```py\nx = 1\n\ny\n```\nafter"),
        (2, None),
        (3, "  \n\n\t\n"),
        (4, "## Only\r\nprose\r\n \r\nprose"),
        (5, "```\nnever closed\n# no title"),
    ]
    want = [
        (1, "Title", "Top"), (1, "NarrativeText", "One line and one more"), (1, "NarrativeText", "Next."), (1, "ListItem", "a"), (1, "ListItem", "b"), (1, "ListItem", "c"),
        (1, "Table", "|x|y|\n|1|2|"), (1, "CodeSnippet", "x = 1\n\ny"), (1, "NarrativeText", "after"), (4, "Title", "Only"), (4, "NarrativeText", "prose"), (4, "NarrativeText", "prose"), (5, "CodeSnippet", "never closed\n# no title"),
    ]
    got = [(i, c, t.strip("\n")) for i, c, t in _elements(markdown_elements(spark.createDataFrame(texts, "id long, text string")))]
    assert got == want


def test_csv_and_xml(spark):
    tables = spark.createDataFrame([(1, 'a,"b ""q""\nc"\n,,\n1, 2\n'), (2, None), (3, ",\n"), (4, "x" * 200_000)], "id long, text string")
    assert _elements(csv_elements(tables)) == [(1, "Table", 'a b "q" c\n1 2'), (4, "Table", "x" * 200_000)]
    pages = spark.createDataFrame([(1, "<d xmlns='u'><Title>T &amp; U</Title><p>one\n two</p><p/></d>"), (2, "<broken> text"), (3, ""), (4, None)], "id long, text string")
    assert _elements(xml_elements(pages)) == [(1, "Title", "T & U"), (1, "NarrativeText", "one two"), (2, "UncategorizedText", "<broken> text")]


def test_folder(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    contents = {"a.txt": b"alpha", "b.csv": b"1,2\n", "sub/c.txt": b"gamma" * 10, "sub/d.docx": b"", "e": b"\xff"}
    for name, content in contents.items():
        (tmp_path / name).write_bytes(content)
    spark.dataSource.register(FolderSource)
    word = "application/vnd.openxmlformats-officedocument.wordprocessingml.document"
    files = spark.read.format("folder").option("path", str(tmp_path)).option("exports", f"{word}=application/pdf").option("partitionBytes", "20").load()
    assert files.rdd.getNumPartitions() > 1
    rows = {r.path[len(str(tmp_path)) + 1 :]: r for r in files.collect()}
    assert {k: bytes(r.content) for k, r in rows.items()} == contents
    assert rows["sub/d.docx"].export_mime == "application/pdf" and rows["a.txt"].export_mime == "text/plain" and rows["e"].mime_type == "application/octet-stream"
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        some = spark.read.format("folder").option("path", str(tmp_path)).option("prune", "true").load().where((F.col("name") == "c.txt") & (F.col("size") > 10))
        assert [bytes(r.content) for r in some.collect()] == [b"gamma" * 10]
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_folder_filters_prune(tmp_path):
    from pyspark.sql.datasource import EqualTo, GreaterThan, IsNotNull

    for i in range(5):
        (tmp_path / f"{i}.txt").write_bytes(b"x" * i)
    reader = PruningReader(str(tmp_path), {}, 3)
    kept = list(reader.pushFilters([IsNotNull(("name",)), GreaterThan(("size",), 1), EqualTo(("content",), b"")]))
    assert len(kept) == 2
    assert [[r[1] for r in p.rows] for p in reader.partitions()] == [["2.txt"], ["3.txt"], ["4.txt"]]
    gone = reader.partitions()[0]
    (tmp_path / "2.txt").unlink()
    assert [b.to_pylist()[0]["content"] for b in reader.read(gone)] == [None]


def test_sketches(spark):
    rows = spark.range(40_000).select((F.col("id") % 3).alias("a"), F.when(F.col("id") % 5 > 0, F.col("id") % 2).alias("b"), (F.col("id") % 9000).alias("v"), F.col("id").alias("x"))
    first, second = sketched(rows.where("x < 10000"), ["a", "b"], F.col("v"), F.col("x")), sketched(rows.where("x >= 10000"), ["a", "b"], F.col("v"), F.col("x"))
    got = {(r.a, r.b, r.grouping): r for r in rolled_up(first.unionByName(second), ["a", "b"], [0.1, 0.9]).collect()}
    want = rows.cube("a", "b").agg(F.grouping_id().alias("g"), F.count_distinct("v").alias("d"), F.count(F.lit(1)).alias("n"), F.percentile("x", F.array(F.lit(0.1), F.lit(0.9))).alias("q")).collect()
    assert len(got) == len(want)
    for r in want:
        found = got[(r.a, r.b, r.g)]
        assert found.n == r.n and abs(found["distinct"] - r.d) <= 0.06 * r.d
        assert all(abs(one - two) < 1000 for one, two in zip(found.quantiles, r.q, strict=True))
    assert rolled_up(sketched(rows.where("false"), ["a"], F.col("v"), F.col("x")), ["a"], [0.5]).where("n > 0").count() == 0


def test_vector_search_inside_a_file(spark):
    import numpy as np

    random = np.random.default_rng(5)
    rows = [(i, random.normal(size=6).tolist(), None if i % 11 == 0 else i % 4) for i in range(300)] + [(900, None, 1), (901, [0.0] * 6, 1)]
    asked = [(q, random.normal(size=6).tolist(), None if q == 3 else q % 5) for q in range(9)]
    v, q = spark.createDataFrame(rows, "id long, vector array<double>, file long"), spark.createDataFrame(asked, "query_id long, vector array<double>, file long")
    for within in (None, "file"):
        want = set()
        for i, a, f in asked:
            own = [(x, r) for x, r, g in rows if r is not None and (within is None or (g is not None and g == f))]
            cos = sorted((-round(float(np.dot(a, r) / (np.linalg.norm(a) * np.linalg.norm(r) or 1)), 6), x) for x, r in own)
            want |= {(i, x, n + 1) for n, (_, x) in enumerate(cos[:7])}
        assert {(r.query_id, r.id, r["rank"]) for r in vector_top_k(v, q, 7, within=within).collect()} == want
    assert vector_top_k(v, q.where("false"), 7).count() == 0 and vector_top_k(v.where("false"), q, 7).count() == 0


def test_mmr_takes_the_unlike():
    import numpy as np

    rows = np.array([[1.0, 0.0], [1.0, 0.0], [0.8, 0.6], [0.0, 0.0]])
    assert select(rows, np.array([1.0, 0.1]), np.array([0.9, 0.9, 0.8, 0.1]), 2, 0.5) == [0, 2]


def test_links_titles_and_frames(spark):
    from quillmere.functions import text as T

    known = spark.createDataFrame([("a", "A.pdf", "https://files.example/A.pdf", 3), ("b", None, None, None)], "id string, title string, url string, page int")
    texts = spark.createDataFrame([(1, "x [cid:b] y [cid:zz][cid:a] z [cid:b]"), (2, "plain"), (3, None), (4, ""), (5, "[cid:a]")], "k int, t string")
    link = lambda url, title, n: f'<sup><a href="{url}" target="_blank" rel="noopener noreferrer" class="citation-link" title="{title}">[{n}]</a></sup>'
    b, a = link("#", "Unknown", 1), link("https://files.example/A.pdf", "A.pdf, p.3", 3)
    got = {r.k: r.t for r in T.with_links(texts, "k", "t", known).collect()}
    assert got == {1: f'x {b} y <sup class="citation-missing">[?]</sup>{a} z {b}', 2: "plain", 3: None, 4: "", 5: a.replace("[3]", "[1]")}

    pages = [
        ("            Centred title here\nbody", "Centred title here"),
        ("a short one\nthe longest line here wins it\nsecond longest wins", "the longest line here wins it"),
        ("x" * 200 + "\nTitle Case Words Win", "Title Case Words Win"),
        ("x" * 200 + "\nno title case but fair in length", "no title case but fair in length"),
        ("tiny", None), ("", None), (None, None),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(pages)], "k int, t string")
    assert {r.k: r.title for r in df.select("k", T.page_title(F.col("t")).alias("title")).collect()} == {i: w for i, (_, w) in enumerate(pages)}

    replies = [
        ("I'm here to help you. Rain falls.", "Rain falls."),
        ("# Head\nText stays.", "Text stays."),
        ("# Head\n# Two\nText", "# Head\n# Two\nText"),
        ("Regarding a.pdf: It rains. I hope this helps!", "It rains. I hope this helps!"),
        ("It rains. I hope this helps.", "It rains"),
        ("It rains\nFeel free to ask if you have any questions.\nmore", "It rains\nmore"),
        (None, None),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(replies)], "k int, t string")
    assert {r.k: r.c for r in df.select("k", T.without_meta(F.col("t")).alias("c")).collect()} == {i: w for i, (_, w) in enumerate(replies)}


def test_best_sentence(spark):
    from quillmere.operators.models import best_sentence

    rows = [("where does the river rise", "Hills are high. The river does rise there! A river rise.", "The river does rise there!"), ("river", "Nothing here.", None), (None, "Text.", None), ("river", None, None), ("", "", None)]
    df = spark.createDataFrame([(i, q, t) for i, (q, t, _) in enumerate(rows)], "k int, q string, t string")
    assert {r.k: r.s for r in df.select("k", best_sentence(F.col("q"), F.col("t")).alias("s")).collect()} == {i: w for i, (_, _, w) in enumerate(rows)}
