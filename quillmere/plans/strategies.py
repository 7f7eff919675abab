"""Queries of whole retrieval strategies: expansion and compression, comparisons, overviews."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import routing as R
from ..functions.chunking import sentences_with_marks
from ..operators import adaptive as A
from ..operators import ranking as K
from ..operators.keyword_index import index_of
from ..operators.retrieval import vector_top_k
from ..registry import query
from ..sources.tables import read
from .retrieval import _ASKED_SQL, _diverse_sql, _hits_sql, asked, bm25_sql, hits, questions_of_vectors, vectors
from .routing import _any_sql


def _searched(spark, sf_dir, queries, k):
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return index_of(docs).top_k(queries, k)


_LETTERS = r"regexp_extract_all(lower(question), '[a-z]{6,}')"


def _bearing(question, text):
    """The sentences that hold a word of the question of six letters or more."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(question), F.lit("[a-z]{6,}"), F.lit(0)))
    return F.array_join(F.filter(sentences_with_marks(text), lambda s: F.exists(words, lambda w: F.contains(F.lower(s), w))), " ")


@query(
    "k13_hybrid_expanded",
    f"""with {_hits_sql(10)}, {_ASKED_SQL}, texts as (select item_id * 50 as query_id, text from benchmark where item_id * 50 in (select vec_id from embeddings)),
variants as (select query_id * 1000 as query_id, text from texts union all select query_id * 1000 + 1, lower(text) from texts union all select query_id * 1000 + 2, array_to_string(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: length(w) > 4), ' ') from texts),
{bm25_sql('variants')},
u as (select v.query_id, h.id, 0 as l, h.rank from variants v join hits h on v.query_id // 1000 = h.query_id union all select query_id, id, 1, rank from bm25),
fu as (select query_id, id, round(sum(0.5::double / (60 + rank)), 9) as score, min(l * 1000 + rank) as first from u group by all),
fr as (select query_id, id, row_number() over (partition by query_id order by score desc, first) as rank from fu),
fi as (select query_id // 1000 as query_id, id, min((query_id % 1000) * 1000 + rank) as first from fr where rank <= 10 group by all),
li as (select query_id, id, row_number() over (partition by query_id order by first, id) as rank from fi),
pa as (select li.query_id, id, rank, list_distinct({_LETTERS}) as ws, list_filter(list_transform(string_split(regexp_replace(d.text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: s <> '') as ss
  from li join asked a on a.query_id = li.query_id join documents d on d.doc_id = id),
cu as (select query_id, id, rank, array_to_string(list_filter(ss, lambda s: len(list_filter(ws, lambda w: contains(lower(s), w))) > 0), ' ') as passage from pa)
select query_id, id, row_number() over (partition by query_id order by rank) as rank, md5(passage) as passage from cu where passage <> ''""",
)
def hybrid_expanded(spark, sf_dir):
    """The hybrid search of every variant of a question, united, each hit cut to the sentences that bear on it."""
    questions = questions_of_vectors(spark, sf_dir)
    long = F.array_join(F.filter(F.split("text", r"\s+"), lambda w: F.length(w) > 4), " ")
    variants = questions.select("query_id", F.posexplode(F.array("text", F.lower("text"), long)).alias("variant", "text"))

    def search(queries):
        of = queries.select("query_id", F.floor(F.col("query_id") / 1000).alias("of"))
        near = hits(spark, sf_dir, 10).withColumnRenamed("query_id", "of").join(of, "of").drop("of")
        return K.reciprocal_rank_fusion([near, _searched(spark, sf_dir, queries, 10)], [0.5, 0.5], first_rank=1).where("rank <= 10")

    texts = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    out = A.compressed(A.multi_query(variants, search), questions, texts, _bearing)
    return out.select("query_id", "id", "rank", F.md5(F.col("passage").cast("binary")).alias("passage"))


#: Questions that name two files, two capitalised words, or nothing.
_COMPARED_SQL = """compared as (select item_id * 50 as query_id, case item_id % 3 when 0 then 'compare file_' || (item_id % 10) || ' with file_' || (item_id * 7 % 10 + 3) % 10 || ' on ' || text when 1 then 'Differences between Erst and Andthe: ' || text else lower(text) end as question from benchmark where item_id * 50 in (select vec_id from embeddings)),
named as (select *, list_distinct(fs) as fd, list_distinct(es) as ed from (select *, regexp_extract_all(question, 'file_([0-9]+)', 1) as fs, regexp_extract_all(question, '\\b[A-Z][a-z]{3,}') as es from compared)),
ways as (select *, case when len(fd) >= 2 then 'files' when len(ed) >= 2 then 'entities' else 'plain' end as way,
  list_filter(fs, lambda x, i: list_position(fs, x) = i) as fo, list_filter(es, lambda x, i: list_position(es, x) = i) as eo from named)"""


@query(
    "k19_comparison_balanced",
    f"""with {_hits_sql(8)}, {_COMPARED_SQL},
qf as (select query_id, 0 as side, fo[1]::bigint as file_key from ways where way = 'files' union all select query_id, 1, fo[2]::bigint from ways where way = 'files'),
fh as (select *, row_number() over (partition by query_id, side order by score desc, id) as rank from (select qf.query_id, side, b.vec_id as id, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) as score from qf join embeddings a on a.vec_id = qf.query_id join embeddings b on b.label::bigint = qf.file_key)),
variants as (select query_id * 1000 as query_id, question || ' ' || eo[1] as text from ways where len(eo) >= 2 union all select query_id * 1000 + 1, question || ' ' || eo[2] from ways where len(eo) >= 2),
{bm25_sql('variants')},
fp as (select query_id, id, row_number() over (partition by query_id order by rank, side) as rank from fh where rank <= 3),
ep as (select query_id // 1000 as query_id, id, row_number() over (partition by query_id // 1000 order by rank, query_id % 1000) as rank from bm25 where rank <= 2 and query_id // 1000 in (select query_id from ways where way = 'entities')),
{_diverse_sql(0.15)}, dt as (select *, row_number() over (partition by query_id, file_key order by rank) as turn from diverse where query_id in (select query_id from ways where way = 'plain'))
select query_id, id, rank from fp where rank <= 4 union all select query_id, id, rank from ep
union all select * from (select query_id, id, row_number() over (partition by query_id order by rank) as rank from dt where turn <= 2) where rank <= 4""",
)
def comparison_balanced(spark, sf_dir):
    """Comparisons of two files, two entities, or of neither, four rows each."""
    i = F.col("query_id") / 50
    files = F.concat(F.lit("compare file_"), (i % 10).cast("int").cast("string"), F.lit(" with file_"), (((i * 7) % 10 + 3) % 10).cast("int").cast("string"), F.lit(" on "), F.col("text"))
    dressed = F.when(i % 3 == 0, files).when(i % 3 == 1, F.concat(F.lit("Differences between Erst and Andthe: "), F.col("text"))).otherwise(F.lower("text"))
    questions = questions_of_vectors(spark, sf_dir).select("query_id", dressed.alias("question"))
    found = lambda pattern, group: F.array_distinct(F.regexp_extract_all("question", F.lit(pattern), F.lit(group)))
    questions = questions.select("query_id", "question", found(r"file_([0-9]+)", 1).alias("files"), found(r"\b[A-Z][a-z]{3,}", 0).alias("entities"))
    sided = lambda names: questions.where(F.size(names) >= 2).select("query_id", "question", F.posexplode(F.slice(names, 1, 2)).alias("side", "name"))
    key = (F.col("query_id") * 1000 + F.col("side")).alias("query_id")
    apart = lambda h: h.select(F.floor(F.col("query_id") / 1000).alias("query_id"), "id", "rank", (F.col("query_id") % 1000).alias("side"))
    inside = sided("files").join(asked(spark, sf_dir), "query_id").select(key, "vector", F.col("name").cast("long").alias("file_key"))
    in_file = vector_top_k(vectors(spark, sf_dir), inside, 3, within="file_key")
    of_entity = _searched(spark, sf_dir, sided("entities").select(key, F.concat_ws(" ", "question", "name").alias("text")), 10)
    return A.comparison(questions, apart(in_file), apart(of_entity), hits(spark, sf_dir, 8), 4)


@query(
    "k21_overview_strategy",
    f"""with {_hits_sql(16, 'wide')}, asked_for as (select item_id * 50 as query_id, case when item_id % 2 = 0 then 'Summarize ' else '' end || text as question from benchmark where item_id * 50 in (select vec_id from embeddings)),
known as (select w.*, {_any_sql('lower(question)', R.OVERVIEW_PHRASES)} as overview from wide w join asked_for a on a.query_id = w.query_id),
hits as (select * from known where rank <= 8 or overview), {_diverse_sql(0.21)},
tt as (select d.*, overview, row_number() over (partition by d.query_id, d.file_key order by d.rank) as turn from diverse d join (select distinct query_id, overview from known) o on o.query_id = d.query_id),
no as (select query_id, id, row_number() over (partition by query_id order by rank) as rank from tt where not overview and turn <= 2),
ov as (select *, row_number() over (partition by query_id order by turn > 1, rank) as place from tt where overview and turn <= 3)
select query_id, id, rank from no where rank <= 4 union all select query_id, id, row_number() over (partition by query_id order by place) from ov where turn = 1 or place <= 4""",
)
def overview_strategy(spark, sf_dir):
    """General questions, every second one for an overview of the folder."""
    even = (F.col("query_id") / 50) % 2 == 0
    questions = questions_of_vectors(spark, sf_dir).select("query_id", F.concat(F.when(even, "Summarize ").otherwise(""), F.col("text")).alias("question"))
    return A.general(questions, hits(spark, sf_dir, 16), 4)
