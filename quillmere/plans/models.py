"""Queries through the model slots (stand-in models), and the remaining text operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.chunking import SENTENCE_END
from ..operators import models as M
from ..operators import ranking as K
from ..operators.retrieval import vector_top_k
from ..registry import query
from ..functions.replies import repaired_json
from ..sources.tables import CHUNKS_SQL, FILES_SQL, chunks, dressed, dressed_sql, files, read
from .retrieval import _BM25_SQL, bm25


def _pairs(spark, sf_dir):
    q = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return K.with_texts(bm25(spark, sf_dir).select("query_id", "id").join(q, "query_id"), d)


@query("k07_scorer_rerank")
def scorer_rerank(spark, sf_dir):
    scored = M.score_pairs(_pairs(spark, sf_dir), M.overlap_scorer).withColumn("score", F.round("score", 6))
    return K.renumber(scored, F.col("score").desc(), "id").where("rank <= 5").select("query_id", "id", "rank", "score")


@query("k11_multi_query")
def multi_query(spark, sf_dir):
    """Paraphrases of every question searched together, each hit once at its best."""
    docs = M.embed(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), M.hashed_embedder())
    asked = M.expand_queries(read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text"), lambda t: [t.lower(), " ".join(w for w in t.split() if len(w) > 4)])
    vectors = M.embed(asked.select((F.col("query_id") * 10 + F.col("variant")).alias("id"), "text"), M.hashed_embedder()).withColumnRenamed("id", "query_id")
    found = vector_top_k(docs, vectors, 5)
    return found.groupBy(F.floor(F.col("query_id") / 10).alias("query_id"), "id").agg(F.max("score").alias("score"))


@query(
    "k12_compression",
    f"""with {_BM25_SQL}, ks as (select query_id, id, list_distinct(list_filter(regexp_split_to_array(lower(b.text), '[^a-z]+'), lambda x: length(x) > 3)) as ws,
  list_filter(list_transform(string_split(regexp_replace(d.text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: s <> '') as ss from bm25 join benchmark b on item_id = query_id join documents d on doc_id = id),
e as (select query_id, id, i, ss[i] as s, len(list_filter(ws, lambda x: list_contains(regexp_split_to_array(lower(ss[i]), '[^a-z]+'), x))) as n from (select *, unnest(range(1, len(ss) + 1)) as i from ks))
select query_id, id, first(case when n > 0 then s end order by n desc, i) as passage from e group by query_id, id""",
)
def compression(spark, sf_dir):
    """The sentence of each whole hit that shares the most of the question's words; none if it shares none."""
    return _pairs(spark, sf_dir).select("query_id", "id", M.best_sentence(F.col("question"), F.col("text")).alias("passage"))


@query("e01_processor_route", f"with {FILES_SQL} select file_id, case when mime_type like 'audio/%' then 'transcriber' when mime_type like 'image/%' then 'reader' when mime_type like 'text/%' or mime_type = 'application/pdf' then 'partitioner' end as processor from files")
def processor_route(spark, sf_dir):
    m, known = F.col("mime_type"), M.Processors()
    known.register("transcriber", m.startswith("audio/"))
    known.register("reader", m.startswith("image/"))
    known.register("partitioner", m.startswith("text/") | (m == "application/pdf"))
    return files(spark, sf_dir).select("file_id", known.route().alias("processor"))


@query("e02_embedding_slot")
def embedding_slot(spark, sf_dir):
    return M.embed(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), M.hashed_embedder()).select("id", F.size("vector").alias("size"), F.round(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x), 6).alias("norm"))


@query(
    "k28_context_packing",
    f"""with {_BM25_SQL}, dd as (select query_id, bm25.rank, left(text, 1200) as t, length(text) as full_length from bm25 join documents on id = doc_id where bm25.rank <= 3),
c as (select query_id, rank, case when full_length <= 1200 then t when length(t) - strpos(reverse(t), '.') + 1 > 841 and contains(t, '.') then left(t, length(t) - strpos(reverse(t), '.') + 1) else t || '...' end as t from dd),
u as (select *, sum(length(t)) over (partition by query_id order by rank) as upto from c), g as (select *, min(case when upto > 2400 then rank end) over (partition by query_id) as stop from u)
select query_id, rank, md5(case when upto <= 2400 then t else left(t, cast(2400 - (upto - length(t)) as bigint)) || '...' end) as packed from g where stop is null or rank < stop or (rank = stop and 2400 - (upto - length(t)) > length(t) * 0.5)""",
)
def context_packing(spark, sf_dir):
    """Three documents at most, each cut at a sentence, within one budget; the last in part if half fits."""
    most, budget = 1200, 2400
    d = K.with_texts(bm25(spark, sf_dir, 3), read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"))
    t = F.left("text", F.lit(most))
    dot = F.length(t) - F.locate(".", F.reverse(t)) + 1
    cut = F.when(F.length("text") <= most, F.col("text")).when(F.contains(t, F.lit(".")) & (dot > most * 0.7 + 1), F.left(t, dot)).otherwise(F.concat(t, F.lit("...")))
    c = d.select("query_id", "rank", cut.alias("t"))
    c = c.withColumn("upto", F.sum(F.length("t")).over(Window.partitionBy("query_id").orderBy("rank")))
    c = c.withColumn("stop", F.min(F.when(F.col("upto") > budget, F.col("rank"))).over(Window.partitionBy("query_id")))
    room = budget - (F.col("upto") - F.length("t"))
    kept = c.where(F.col("stop").isNull() | (F.col("rank") < F.col("stop")) | ((F.col("rank") == F.col("stop")) & (room > F.length("t") * 0.5)))
    packed = F.when(F.col("upto") <= budget, F.col("t")).otherwise(F.concat(F.left("t", room), F.lit("...")))
    return kept.select("query_id", "rank", F.md5(packed.cast("binary")).alias("packed"))


@query(
    "w15_informative_chunks",
    f"""with {CHUNKS_SQL}, m as (select chunk_id, doc_id, chunk_index, content, len(list_filter(regexp_extract_all(content, '[\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_full_match(w, '[A-Z][a-z]{{2,}}|[A-Z]{{2,}}'))) as caps, regexp_split_to_array(trim(lower(content)), '\\s+') as ws,
  length(regexp_replace(content, '[^\\p{{L}}]', '', 'g')) as alpha, length(trim(content)) as n from chunks),
s as (select *, floor(caps * 0.3) + case when n > 0 then floor(len(list_distinct(ws)) / len(ws) * 10) + case when alpha / n > 0.6 then floor((alpha / n - 0.6) * 20) else 0 end else 0 end as score from m),
p as (select *, row_number() over o as place, sum(length(content)) over (o rows unbounded preceding) as upto from s window o as (partition by doc_id order by score desc, chunk_index))
select chunk_id, cast(score as bigint) as score, place, upto <= 4000 or upto - length(content) < 2800 as packed from p""",
)
def informative_chunks(spark, sf_dir):
    """Chunks scored by capitalised words, variety and letters, best first within a file.

    The best are packed into 4,000 characters, one more while under 2,800; as the
    first that does not fit ends it, what is packed is a prefix of the order.
    """
    words, n = F.split(F.trim(F.lower("content")), r"\s+"), F.length(F.trim("content"))
    alpha = F.length(F.regexp_replace("content", r"[^\p{L}]", "")) / n
    names = F.filter(F.regexp_extract_all("content", F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), lambda w: w.rlike("^(?:[A-Z][a-z]{2,}|[A-Z]{2,})$"))
    score = F.floor(F.size(names) * 0.3) + F.when(n > 0, F.floor(F.size(F.array_distinct(words)) / F.size(words) * 10) + F.when(alpha > 0.6, F.floor((alpha - 0.6) * 20)).otherwise(0)).otherwise(0)
    s = chunks(spark, sf_dir).withColumn("score", score.cast("long"))
    order = Window.partitionBy("doc_id").orderBy(F.col("score").desc(), "chunk_index")
    upto = F.sum(F.length("content")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    packed = (upto <= 4000) | (upto - F.length("content") < 2800)
    return s.select("chunk_id", "score", F.row_number().over(order).alias("place"), packed.alias("packed"))


_PAGES = ["            Centred Title Of It\nbody line that is long enough to count.", "A Title Case Line Here\nsmall rest", "an ordinary first line of thirty or more letters\nx", ""]


@query(
    "t03_page_title",
    f"""with p as (select pid, list_filter(string_split(t, chr(10)), lambda s: trim(s) <> '') as ls from {dressed_sql('pid', _PAGES)})
select pid, coalesce(trim(list_filter(ls, lambda s: regexp_matches(s, '^ {{10,}}\\S'))[1]), trim(list_filter(ls, lambda s: regexp_matches(trim(s), '^(\\p{{Lu}}\\S*\\s+){{2,}}\\p{{Lu}}\\S*$'))[1]), trim(list_filter(ls, lambda s: length(trim(s)) between 20 and 150)[1])) as title from p""",
)
def page_title(spark, sf_dir):
    """A centred line, else one in title case, else the first of 20 to 150 characters."""
    ls = F.filter(F.split("t", "\n"), lambda s: F.trim(s) != "")
    pick = lambda rule: F.trim(F.get(F.filter(ls, rule), 0))
    title = F.coalesce(pick(lambda s: s.rlike(r"^ {10,}\S")), pick(lambda s: F.trim(s).rlike(r"^(\p{Lu}\S*\s+){2,}\p{Lu}\S*$")), pick(lambda s: F.length(F.trim(s)).between(20, 150)))
    return dressed(spark, sf_dir, "pid", _PAGES).select("pid", title.alias("title"))


_FIRST_PAGES = [
    "                    A Centred Line Of Words\nbody",
    "Page 1 of 7\nthe longest line of them all without an end\nA Shorter Title Case Line",
    "                    page 7 is no title at all\n" + "x" * 160 + "\nSome Title Case Line Here\nmore of it",
    "tiny\nwww.example.org and more words here\n" + "y" * 170,
    "A sentence that is long, and that ends with a full stop like all.\nshort",
]


def _title_sql(words: list[str], line: str) -> str:
    return "(" + " or ".join(f"contains(lower({line}), '{w}')" for w in words) + ")"


@query(
    "t03_first_page_title",
    f"""with p as (select pid, string_split(t, chr(10)) as raw, list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(x)), lambda x: x <> '') as ls from {dressed_sql('pid', _FIRST_PAGES)}),
f as (select *, list_filter(raw[1:15], lambda x: regexp_matches(x, '^ {{11,}}\\S') and length(trim(x)) > 15 and length(trim(x)) < 150 and not {_title_sql(T.NO_CENTRED_TITLE, 'x')}) as ce,
  list_filter(ls[1:10], lambda x: length(x) >= 15 and not {_title_sql(T.NO_TITLE, 'x')} and not (x like '%.' and length(x) > 50)) as fit,
  list_filter(ls[1:8], lambda x: length(x) > 15 and length(x) < 150 and len(list_filter(regexp_split_to_array(x, '\\s+'), lambda w: regexp_matches(w, '^\\p{{Lu}}'))) >= len(regexp_split_to_array(x, '\\s+')) * 0.6 and not regexp_matches(x, '[.!?]$')) as cased,
  list_filter(ls[1:5], lambda x: length(x) > 20 and length(x) < 150) as fair from p),
m as (select *, list_max(list_transform(fit, lambda x: length(x))) as longest from f)
select pid, coalesce(trim(ce[1]), case when longest < 150 then list_filter(fit, lambda x: length(x) = longest)[1] end, cased[1], fair[1]) as title from m""",
)
def first_page_title(spark, sf_dir):
    return dressed(spark, sf_dir, "pid", _FIRST_PAGES).select("pid", T.page_title(F.col("t")).alias("title"))


_JSONS = ['ok ```json\n{"entities": ["a", "b"]}\n``` done', 'noise {"entities": ["c"]} noise', "{broken", '{"entities": []}', '{"entities": ["a", "b", "c", "cut', '{"of": {"x": 1}, "entities": ["a", {"b": 1}, "d"']
#: How many entities these hold once repaired, worked out by hand.
_ENTITIES = [2, 1, 0, 0, 3, 3]


@query("t23_json_repair", f"select jid, list_extract({_ENTITIES!r}, variant + 1)::bigint as n from {dressed_sql('jid', _JSONS)}")
def json_repair(spark, sf_dir):
    """Entities of a reply's JSON, whether fenced, cut off or nested; none if it does not parse."""
    entities = F.from_json(repaired_json("t"), "entities array<string>")["entities"]
    return dressed(spark, sf_dir, "jid", _JSONS).select("jid", F.coalesce(F.size(entities), F.lit(0)).cast("long").alias("n")).withColumn("n", F.greatest("n", F.lit(0).cast("long")))


@query("s13_vector_store", "select label, count(*) as n, cast(min(len(embedding)) as bigint) as narrowest, cast(max(len(embedding)) as bigint) as widest from embeddings group by label")
def vector_store(spark, sf_dir):
    """What opening a collection checks: rows and width of vectors."""
    size = F.size("embedding").cast("long")
    return read(spark, sf_dir, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.min(size).alias("narrowest"), F.max(size).alias("widest"))


@query("e09_folder_pipeline", f"with {FILES_SQL}, f as (select folder_id, count(*) as files, cast(sum(size) as bigint) as bytes from files group by folder_id), s as (select source, cast(sum(len(list_filter(list_transform(regexp_split_to_array(text, '[.!?]+\\s+'), lambda x: trim(x)), lambda x: x <> ''))) as bigint) as sentences from documents group by source) select folder_id, files, bytes, sentences from f join s on folder_id = source")
def folder_pipeline(spark, sf_dir):
    """Inventory and text statistics of every folder in one plan."""
    f = files(spark, sf_dir).groupBy("folder_id").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))
    n = F.size(F.filter(F.transform(F.split("text", SENTENCE_END), lambda x: F.trim(x)), lambda x: x != ""))
    s = read(spark, sf_dir, "documents").groupBy(F.col("source").alias("folder_id")).agg(F.sum(n).alias("sentences"))
    return f.join(s, "folder_id")


@query("g01_entity_graph", "with e as (select distinct doc_id, unnest(regexp_extract_all(text, '[A-Z][a-z]{7,}')) as entity from documents) select entity, count(*) as documents, min(doc_id) as first from e group by entity")
def entity_graph(spark, sf_dir):
    """Entity nodes and their documents, from extracted (here: pattern) entities."""
    e = read(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Z][a-z]{7,}"), F.lit(0)))).alias("entity"))
    return e.groupBy("entity").agg(F.count(F.lit(1)).alias("documents"), F.min("doc_id").alias("first"))
