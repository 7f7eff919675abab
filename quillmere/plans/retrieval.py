"""Queries of search and of the algebra of ranked lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import routing as R
from ..operators import adaptive as A
from ..operators import ranking as K
from ..operators.mmr import rerank as mmr_rerank
from ..operators.keyword_index import index_of
from ..operators.retrieval import vector_top_k
from ..registry import query
from ..sources.tables import read
from .routing import _case_sql

TOP = 20
#: "Now" for recency, just after the last event.
NOW = "2024-02-01"


def vectors(spark, sf_dir):
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.col("label").cast("long").alias("file_key"))


def asked(spark, sf_dir):
    """Every fiftieth vector is a query against all."""
    return vectors(spark, sf_dir).where("id % 50 = 0").select(F.col("id").alias("query_id"), "vector")


def hits(spark, sf_dir, k=TOP):
    """The vector search's ranked list, with the file of each hit."""
    v = vectors(spark, sf_dir)
    return vector_top_k(v, asked(spark, sf_dir), k).join(v.select("id", "file_key"), "id").select("query_id", "id", "file_key", "rank", "score")


def _hits_sql(k=TOP, name="hits"):
    return f"""{name} as (select q as query_id, id, file_key, rank, score from (select q, id, file_key, score, row_number() over (partition by q order by score desc, id) as rank
  from (select a.vec_id as q, b.vec_id as id, b.label::bigint as file_key, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) as score
        from embeddings a, embeddings b where a.vec_id % 50 = 0)) where rank <= {k})"""


_COLS = "query_id, id, file_key, rank, score"
_out = lambda df: df.select("query_id", "id", "file_key", "rank", "score")


@query("k01_vector_topk", f"with {_hits_sql()} select query_id, id, rank, score from hits")
def vector_topk(spark, sf_dir):
    return vector_top_k(vectors(spark, sf_dir), asked(spark, sf_dir), TOP)


@query(
    "k02_scored_topk",
    f"""with {_hits_sql(15)}, s as (select query_id, id, rank, greatest(0, least(1, score)) as s from hits where rank <= 5), m as (select *, min(s) over (partition by query_id) as lo, max(s) over (partition by query_id) as hi from s)
select query_id, id, rank, round((s - lo) / case when hi = lo then 1 else hi - lo end, 5) as score from m""",
)
def scored_topk(spark, sf_dir):
    """Over-fetch, turn distances to similarities, keep k, spread to [0, 1]."""
    h = hits(spark, sf_dir, 15).withColumn("score", R.similarity(F.round(1 - F.col("score"), 6)))
    return K.min_max(h.where("rank <= 5")).select("query_id", "id", "rank", F.round("score", 5).alias("score"))


def bm25_sql(asked: str, name: str = "bm25") -> str:
    """BM25 of the texts of ``asked`` (query_id, text) over all documents, ten hits each."""
    return f"""t as (select doc_id as id, list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '') as ts from documents),
p as (select id, len, term, count(*) as tf from (select id, len(ts) as len, unnest(ts) as term from t) group by all),
s as (select count(*) as n, avg(len(ts)) as mean from t),
f as (select term, ln(n - df + 0.5) - ln(df + 0.5) as idf from (select term, count(*) as df from p group by term), s),
a as (select query_id, term, count(*) as times from (select query_id, unnest(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) as term from {asked}) group by all),
w as (select query_id, a.term, times, case when idf < 0 then 0.25 * (select avg(idf) from f) else idf end as idf from a join f on a.term = f.term),
b as (select query_id, id, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / mean))), 6) as score from p join w on p.term = w.term, s group by query_id, id),
{name} as (select * from (select query_id, id, row_number() over (partition by query_id order by score desc, id) as rank, score from b) where rank <= 10)"""


_BM25_SQL = bm25_sql("(select item_id as query_id, text from benchmark)")


def bm25(spark, sf_dir, k=10):
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return index_of(docs).top_k(read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text"), k)


@query("k04_bm25_topk", f"with {_BM25_SQL} select query_id, id, bm25.rank, bm25.score, 'Source: doc_' || id || ' (' || source || ')' as citation from bm25 join documents on id = doc_id where bm25.rank <= 5")
def bm25_topk(spark, sf_dir):
    """The flagship: passages searched in the documents, five hits each, cited."""
    found = bm25(spark, sf_dir, 5)
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source")
    cited = F.concat(F.lit("Source: doc_"), F.col("id").cast("string"), F.lit(" ("), F.col("source"), F.lit(")"))
    return found.join(docs, "id").select("query_id", "id", "rank", "score", cited.alias("citation"))


@query("k05_bm25_retriever", f"with {_BM25_SQL} select query_id, id, rank from bm25")
def bm25_retriever(spark, sf_dir):
    return bm25(spark, sf_dir).select("query_id", "id", "rank")


#: The question behind a query vector: a benchmark text, by turns plain, a comparison and an exact one.
_ASKED_SQL = f"""asked as (select item_id * 50 as query_id, case item_id % 3 when 1 then 'compare ' when 2 then 'function ' else '' end || text as question from benchmark where item_id * 50 in (select vec_id from embeddings)),
routed as (select *, {_case_sql('lower(question)', R.STRATEGIES, 'conceptual')} as strategy from asked)"""
_KEYWORD_SQL = f"""{_BM25_SQL}, kw as (select query_id * 50 as query_id, id, coalesce(label::bigint, id % 10) as file_key, rank, score from bm25 left join embeddings on vec_id = id where query_id * 50 in (select vec_id from embeddings))"""


def questions_of_vectors(spark, sf_dir):
    """(query_id, question, strategy, text): the questions whose vectors ``asked`` has."""
    b = read(spark, sf_dir, "benchmark").select((F.col("item_id") * 50).alias("query_id"), "text", F.when(F.col("item_id") % 3 == 1, "compare ").when(F.col("item_id") % 3 == 2, "function ").otherwise("").alias("head"))
    q = b.join(vectors(spark, sf_dir).select(F.col("id").alias("query_id")), "query_id", "left_semi").withColumn("question", F.concat("head", "text"))
    return q.withColumn("strategy", R.first_rule(F.lower("question"), R.STRATEGIES, "conceptual"))


def keyword_hits(spark, sf_dir, k=10):
    """The keyword leg: BM25 over all documents for the same questions, in the vector list's columns."""
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    found = index_of(docs).top_k(questions_of_vectors(spark, sf_dir).select("query_id", "text"), k)
    files = vectors(spark, sf_dir).select("id", "file_key")
    return _out(found.join(files, "id", "left").withColumn("file_key", F.coalesce("file_key", F.col("id") % 10)))


@query(
    "k09_rank_fusion",
    f"""with {_hits_sql()}, {_KEYWORD_SQL}, u as (select query_id, id, 0 as l, rank from hits union all select query_id, id, 1, rank from kw),
fu as (select query_id, id, round(sum(1.0::double / (60 + rank - 1)), 9) as score, min(l * 1000 + rank) as first from u group by all)
select query_id, id, row_number() over (partition by query_id order by score desc, first) as rank, score from fu""",
)
def rank_fusion(spark, sf_dir):
    return K.reciprocal_rank_fusion([hits(spark, sf_dir), keyword_hits(spark, sf_dir)])


@query(
    "k10_weighted_ensemble",
    f"""with {_hits_sql()}, {_KEYWORD_SQL}, u as (select query_id, id, 0 as l, rank, 0.7::double as w from hits union all select query_id, id, 1, rank, 0.3::double from kw),
fu as (select query_id, id, round(sum(w / (60 + rank)), 9) as score, min(l * 1000 + rank) as first from u group by all)
select query_id, id, row_number() over (partition by query_id order by score desc, first) as rank, score from fu""",
)
def weighted_ensemble(spark, sf_dir):
    return K.reciprocal_rank_fusion([hits(spark, sf_dir), keyword_hits(spark, sf_dir)], [0.7, 0.3], first_rank=1)


@query("a19_min_max", f"with {_hits_sql()}, m as (select *, min(score) over (partition by query_id) as lo, max(score) over (partition by query_id) as hi from hits) select query_id, id, round((score - lo) / case when hi = lo then 1 else hi - lo end, 5) as score from m")
def min_max(spark, sf_dir):
    return K.min_max(hits(spark, sf_dir)).select("query_id", "id", F.round("score", 5).alias("score"))


@query("w04_cap_per_file", f"with {_hits_sql()}, t as (select *, row_number() over (partition by query_id, file_key order by rank) as turn from hits), k as (select query_id, id, file_key, score, row_number() over (partition by query_id order by rank) as rank from t where turn <= 2) select {_COLS} from k where rank <= 8")
def cap_per_file(spark, sf_dir):
    return _out(K.cap_per_file(hits(spark, sf_dir), 2, 8))


@query(
    "w05_overview_cap",
    f"""with {_hits_sql()}, t as (select *, row_number() over (partition by query_id, file_key order by rank) as turn from hits), k as (select *, row_number() over (partition by query_id order by turn > 1, rank) as place from t where turn <= 3)
select query_id, id, file_key, row_number() over (partition by query_id order by place) as rank, score from k where turn = 1 or place <= 10""",
)
def overview_cap(spark, sf_dir):
    return _out(K.overview_cap(hits(spark, sf_dir), 3, 10))


@query(
    "w06_diversify",
    f"""with {_hits_sql()}, f as (select query_id, count(distinct file_key) as files from hits group by query_id),
t as (select h.*, case when files * 2 <= 10 then 2 else greatest(1, 10 // files) end as slots, row_number() over (partition by h.query_id, file_key order by rank) as turn from hits h join f on h.query_id = f.query_id),
k as (select *, row_number() over (partition by query_id order by (turn <= slots) desc, case when turn <= slots then file_key end nulls first, rank) as place from t)
select query_id, id, file_key, row_number() over (partition by query_id order by rank) as rank, score from k where place <= 10""",
)
def diversify(spark, sf_dir):
    return _out(K.diversify(hits(spark, sf_dir), 2, 10))


@query(
    "w07_rebalance",
    f"""with {_hits_sql()}, c as (select *, count(*) over (partition by query_id, file_key) as n from hits), s as (select query_id, id, file_key, rank as r0, round(case when n > 1 then score / sqrt(n) else score end, 9) as score from c),
t as (select *, row_number() over (partition by query_id, file_key order by score desc, r0) as turn from s)
select query_id, id, file_key, row_number() over (partition by query_id order by score desc, id) as rank, score from t where turn <= 5""",
)
def rebalance(spark, sf_dir):
    return _out(K.rebalance(hits(spark, sf_dir)))


@query(
    "w08_rebalance_unscored",
    f"""with {_hits_sql()}, t as (select *, row_number() over (partition by query_id, file_key order by rank) as turn, min(rank) over (partition by query_id, file_key) as seen from hits)
select query_id, id, file_key, row_number() over (partition by query_id order by seen, turn) as rank, score from t where turn <= 3""",
)
def rebalance_unscored(spark, sf_dir):
    return _out(K.rebalance_unscored(hits(spark, sf_dir), 3))


def _diverse_sql(weight):
    return f"""c as (select *, count(*) over (partition by query_id, file_key) as n, row_number() over (partition by query_id, file_key order by rank) as place from hits),
dp as (select query_id, id, file_key, round(score * (1 - (n / max(n) over (partition by query_id)) * (place / n) * {weight}), 9) as score from c),
diverse as (select query_id, id, file_key, row_number() over (partition by query_id order by score desc, id) as rank, score from dp)"""


@query("w09_diversity_rerank", f"with {_hits_sql()}, {_diverse_sql(0.3)} select {_COLS} from diverse")
def diversity_rerank(spark, sf_dir):
    return _out(K.diversity_rerank(hits(spark, sf_dir)))


@query(
    "w10_interleave",
    f"""with {_hits_sql()}, a as (select query_id, id, row_number() over (partition by query_id order by rank) as rank, 0 as side from hits where file_key % 2 = 0 union all
  select query_id, id, row_number() over (partition by query_id order by rank), 1 from hits where file_key % 2 = 1)
select query_id, id, row_number() over (partition by query_id order by rank, side) as rank from a""",
)
def interleave(spark, sf_dir):
    h = hits(spark, sf_dir)
    return K.interleave(K.renumber(h.where("file_key % 2 = 0"), "rank"), K.renumber(h.where("file_key % 2 = 1"), "rank")).select("query_id", "id", "rank")


@query("f07_relevance_threshold", f"with {_hits_sql()} select query_id, id, rank from (select query_id, id, row_number() over (partition by query_id order by rank) as rank from hits where score >= 0.3) where rank <= 10")
def relevance_threshold(spark, sf_dir):
    return K.threshold_top(hits(spark, sf_dir), 0.3, 10).select("query_id", "id", "rank")


_KEY_SQL = """k as (select item_id as query_id, doc_id as id, lower(b.text) as q, lower(d.text) as t, list_distinct(list_filter(regexp_split_to_array(lower(b.text), '\\s+'), lambda w: w <> '')) as ws
  from bm25 x join benchmark b on x.query_id = item_id join documents d on x.id = doc_id),
keyed as (select query_id, id, round(len(list_filter(ws, lambda w: contains(t, w))) / len(ws) + case when contains(t, q) then 0.3 else 0 end, 6)::double as score from k)"""


def _keyword_scored(spark, sf_dir):
    q = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    found = K.with_texts(bm25(spark, sf_dir).select("query_id", "id").join(q, "query_id"), d)
    return found.select("query_id", "id", F.round(K.keyword_score(F.col("question"), F.col("text")), 6).alias("score"))


@query("k06_keyword_rerank", f"with {_BM25_SQL}, {_KEY_SQL} select query_id, id, score from keyed")
def keyword_rerank(spark, sf_dir):
    return _keyword_scored(spark, sf_dir)


@query("k08_rerank_threshold", f"with {_BM25_SQL}, {_KEY_SQL} select * from (select query_id, id, row_number() over (partition by query_id order by score desc, id) as rank, score from keyed where score >= 0.3) where rank <= 4")
def rerank_threshold(spark, sf_dir):
    return K.threshold_top(K.renumber(_keyword_scored(spark, sf_dir), F.col("score").desc(), "id"), 0.3, 4).select("query_id", "id", "rank", "score")


@query(
    "k13_hybrid_weights",
    f"""with {_hits_sql(10)}, {_KEYWORD_SQL}, u as (select query_id, id, 0 as l, rank, 0.6::double as w from hits union all select query_id, id, 1, rank, 0.4::double from kw),
fu as (select query_id, id, round(sum(w / (60 + rank)), 9) as score, min(l * 1000 + rank) as first from u group by all),
e as (select query_id, id, row_number() over (partition by query_id order by score desc, first) as rank from fu)
select 0.0::double as weight, query_id, id, rank from hits union all select 0.4::double, query_id, id, rank from e where rank <= 10""",
)
def hybrid_weights(spark, sf_dir):
    """A weight of zero removes the keyword leg before anything is planned; otherwise both legs are fused."""
    h, kw = hits(spark, sf_dir, 10), keyword_hits(spark, sf_dir)
    one = lambda w: A.hybrid(h, kw, w).where("rank <= 10").select(F.lit(w).alias("weight"), "query_id", "id", "rank")
    return one(0.0).unionByName(one(0.4))


def mmr_sql(listed: str, k: int, trade: float = 0.7) -> str:
    """``picked`` (query_id, id, rank): maximal marginal relevance over the list ``listed`` (query_id, id, rank), a step a pick."""
    dot = lambda a, b: f"list_dot_product({a}, {b})"
    steps = "".join(
        f""", s{t} as (select c.query_id, c.id, c.place, row_number() over (partition by c.query_id order by round({trade} * coalesce(c.relevance, 0) - {1 - trade} * max(coalesce(l.likeness, 0)), 9) desc, c.place) as o
  from mmr_c c join p{t - 1} p on p.query_id = c.query_id left join mmr_l l on l.query_id = c.query_id and l.one = c.id and l.two = p.id
  where c.n > {k} and (c.query_id, c.id) not in (select query_id, id from p{t - 1}) group by c.query_id, c.id, c.place, c.relevance),
p{t} as (select * from p{t - 1} union all select query_id, id, {t} from s{t} where o = 1)"""
        for t in range(2, k + 1)
    )
    return f"""mmr_v as (select vec_id, embedding::double[] as e, sqrt({dot('embedding::double[]', 'embedding::double[]')}) + 1e-8 as norm from embeddings),
mmr_c as (select x.query_id, x.id, row_number() over (partition by x.query_id order by x.rank) as place, count(*) over (partition by x.query_id) as n, v.e, v.norm, {dot('v.e', 'q.e')} / (v.norm * q.norm) as relevance from {listed} x join mmr_v q on q.vec_id = x.query_id left join mmr_v v on v.vec_id = x.id),
mmr_l as (select a.query_id, a.id as one, b.id as two, {dot('a.e', 'b.e')} / (a.norm * b.norm) as likeness from mmr_c a join mmr_c b on a.query_id = b.query_id where a.e is not null and b.e is not null),
p1 as (select query_id, id, 1 as rank from mmr_c where n > {k} and place = 1){steps},
picked as (select query_id, id, rank from p{k} union all select query_id, id, place from mmr_c where n <= {k})"""


def _adaptive_sql(k, rebalanced, by_likeness=False):
    spread = mmr_sql("ba", k) + "\nselect query_id, id, rank from picked"
    if not by_likeness:
        spread = f"""nf as (select query_id, count(distinct file_key) as files from ba group by query_id),
sl as (select ba.*, case when files * 2 <= {k} then 2 else greatest(1, {k} // files) end as slots, row_number() over (partition by ba.query_id, file_key order by rank) as turn from ba join nf on ba.query_id = nf.query_id),
pl as (select *, row_number() over (partition by query_id order by (turn <= slots) desc, case when turn <= slots then file_key end nulls first, rank) as place from sl)
select query_id, id, row_number() over (partition by query_id order by rank) as rank from pl where place <= {k}"""
    balanced = f"""c as (select *, count(*) over (partition by query_id, file_key) as n from wk), bs as (select query_id, id, file_key, rank as r0, round(case when n > 1 then score / sqrt(n) else score end, 9) as score from c),
y as (select *, row_number() over (partition by query_id, file_key order by score desc, r0) as turn from bs),
ba as (select * from (select query_id, id, file_key, row_number() over (partition by query_id order by score desc, id) as rank from y where turn <= 5) where rank <= {2 * k})"""
    return f"""with {_hits_sql(3 * k)}, {_KEYWORD_SQL}, {_ASKED_SQL},
v2 as (select * from hits where rank <= {2 * k} and query_id in (select query_id from routed where strategy = 'complex')), k2 as (select * from kw where query_id in (select query_id from routed where strategy = 'complex')),
u as (select query_id, id, file_key, 0 as l, rank from v2 union all select query_id, id, file_key, 1, rank from k2),
g as (select query_id, id, min(file_key) as file_key, round(sum(1.0::double / (60 + rank - 1)), 9) as score, min(l * 1000 + rank) as first from u group by query_id, id),
m as (select * from (select query_id, id, file_key, row_number() over (partition by query_id order by score desc, first) as rank from g) where rank <= {3 * k}),
x as (select m.query_id, m.id, file_key, m.rank, lower(question) as q, lower(text) as t, list_distinct(list_filter(regexp_split_to_array(lower(question), '\\s+'), lambda w: w <> '')) as ws from m join routed r on m.query_id = r.query_id join documents on doc_id = m.id),
z as (select query_id, id, file_key, rank as r0, round(len(list_filter(ws, lambda w: contains(t, w))) / len(ws) + case when contains(t, q) then 0.3 else 0 end, 6)::double as score from x),
wk as (select * from (select query_id, id, file_key, score, row_number() over (partition by query_id order by score desc, r0) as rank from z where score >= {0.1 if rebalanced else 0.0}) where rank <= {2 * k}),
{balanced if rebalanced else 'ba as (select * from wk)'},
{spread}
union all select query_id, id, rank from kw where rank <= {k} and query_id in (select query_id from routed where strategy = 'exact_match')
union all select query_id, id, rank from hits where rank <= {k} and query_id in (select query_id from routed where strategy = 'conceptual')"""


def _adaptive(spark, sf_dir, k, rebalanced, by_likeness=False):
    texts = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    asked_ = questions_of_vectors(spark, sf_dir).select("query_id", "question", "strategy")
    return A.adaptive(asked_, hits(spark, sf_dir, 3 * k), keyword_hits(spark, sf_dir), texts, k, rebalanced=rebalanced, spread_by=(vectors(spark, sf_dir), asked(spark, sf_dir)) if by_likeness else None)


@query("k14_adaptive_retrieval", _adaptive_sql(5, True))
def adaptive_retrieval(spark, sf_dir):
    """The legs by the question's kind; complex ones fused, reranked, rebalanced and spread over files."""
    return _adaptive(spark, sf_dir, 5, True)


@query("k14_adaptive_mmr", _adaptive_sql(5, True, True))
def adaptive_mmr(spark, sf_dir):
    """The same, complex questions' candidates picked by maximal marginal relevance."""
    return _adaptive(spark, sf_dir, 5, True, True)


@query("k15_serving_retrieval", _adaptive_sql(4, False))
def serving_retrieval(spark, sf_dir):
    """The serving path: no rebalancing, no threshold."""
    return _adaptive(spark, sf_dir, 4, False)


@query("k16_mmr", f"with {_hits_sql()}, {mmr_sql('hits', 5)} select query_id, id, rank from picked")
def mmr(spark, sf_dir):
    v = vectors(spark, sf_dir)
    found = hits(spark, sf_dir).join(v.select("id", "vector"), "id").join(asked(spark, sf_dir).withColumnRenamed("vector", "query_vector"), "query_id")
    return mmr_rerank(found.select("query_id", "id", "rank", "score", "vector", "query_vector"), 5)


@query("k17_factual_strategy", f"with {_hits_sql(50)} select * from (select query_id, id, row_number() over (partition by query_id order by rank) as rank from hits where file_key = 3) where rank <= 4")
def factual_strategy(spark, sf_dir):
    return K.renumber(hits(spark, sf_dir, 50).where("file_key = 3"), "rank").where("rank <= 4").select("query_id", "id", "rank")


@query("k18_relationship_strategy", f"with {_hits_sql(16)}, {_diverse_sql(0.3)}, t as (select *, row_number() over (partition by query_id, file_key order by rank) as turn from diverse) select * from (select query_id, id, row_number() over (partition by query_id order by rank) as rank from t where turn <= 2) where rank <= 4")
def relationship_strategy(spark, sf_dir):
    return K.cap_per_file(K.diversity_rerank(hits(spark, sf_dir, 16)), 2, 4).select("query_id", "id", "rank")


@query(
    "k19_comparison_strategy",
    f"""with {_hits_sql(50)}, a as (select query_id, id, row_number() over (partition by query_id order by rank) as rank, 0 as side from hits where file_key = 1 union all select query_id, id, row_number() over (partition by query_id order by rank), 1 from hits where file_key = 2)
select query_id, id, row_number() over (partition by query_id order by rank, side) as rank from a where rank <= 3""",
)
def comparison_strategy(spark, sf_dir):
    """Two named files, k / 2 + 1 hits of each, interleaved."""
    h = hits(spark, sf_dir, 50)
    side = lambda key: K.renumber(h.where(F.col("file_key") == key), "rank").where("rank <= 3")
    return K.interleave(side(1), side(2)).select("query_id", "id", "rank")


#: Hits with whether their document's text holds the first capitalised word of the question.
_NAMED_SQL = """ent as (select query_id, lower(regexp_extract(question, '[A-Z][a-z]{3,}')) as entity from asked),
held as (select h.*, coalesce(entity <> '' and contains(lower(d.text), entity), false) as named from hits h left join ent on h.query_id = ent.query_id left join documents d on d.doc_id = h.id),
boosted as (select query_id, id, file_key, row_number() over (partition by query_id order by score desc, id) as rank, score from (select query_id, id, file_key, round(case when named then score * 1.3 else score end, 9) as score from held))"""


def _named(spark, sf_dir, h):
    """``h`` with the columns ``entity``, of its question, and ``named``, whether the text holds it."""
    entity = F.lower(F.regexp_extract("question", "[A-Z][a-z]{3,}", 0))
    asked_ = questions_of_vectors(spark, sf_dir).select("query_id", entity.alias("entity"))
    texts = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    held = K.with_texts(h.select("query_id", "id").join(asked_.where("entity <> ''"), "query_id"), texts)
    named = held.where(F.contains(F.lower("text"), F.col("entity"))).select("query_id", "id", F.lit(True).alias("named")).distinct()
    joined = h.join(asked_, "query_id", "left").join(named, ["query_id", "id"], "left")
    return joined.withColumn("named", F.coalesce("named", F.lit(False)))


@query(
    "k20_entity_strategy",
    f"""with {_hits_sql()}, {_ASKED_SQL}, {_NAMED_SQL},
t as (select *, row_number() over (partition by query_id, file_key order by rank) as turn from boosted) select * from (select query_id, id, row_number() over (partition by query_id order by rank) as rank from t where turn <= 1) where rank <= 4""",
)
def entity_strategy(spark, sf_dir):
    """Hits whose text holds the question's entity are raised; one of every file."""
    return K.cap_per_file(K.boost(_named(spark, sf_dir, hits(spark, sf_dir)), F.col("named")), 1, 4).select("query_id", "id", "rank")


@query("k21_general_strategy", f"with {_hits_sql(8)}, {_diverse_sql(0.21)}, t as (select *, row_number() over (partition by query_id, file_key order by rank) as turn from diverse) select * from (select query_id, id, row_number() over (partition by query_id order by rank) as rank from t where turn <= 2) where rank <= 4")
def general_strategy(spark, sf_dir):
    return K.cap_per_file(K.diversity_rerank(hits(spark, sf_dir, 8), 0.3 * 0.7), 2, 4).select("query_id", "id", "rank")


def _age():
    """Days since a hit was written; null where its date can't be read."""
    written = F.when(F.col("id") % 4 == 0, "junk").otherwise(F.concat(F.lit("2024-01-"), F.lpad((F.col("id") % 28 + 1).cast("string"), 2, "0")))
    return F.datediff(F.lit(NOW).cast("date"), F.try_to_timestamp(written, F.lit("yyyy-MM-dd")))


@query(
    "k22_recency_rerank",
    f"""with {_hits_sql()}, s as (select query_id, id, round(score * coalesce(1 + 0.2 / (date_diff('day', try_cast(case id % 4 when 0 then 'junk' else '2024-01-' || lpad(cast(id % 28 + 1 as varchar), 2, '0') end as date), date '{NOW}') + 1), 1), 9) as score from hits)
select query_id, id, row_number() over (partition by query_id order by score desc, id) as rank, score from s""",
)
def recency_rerank(spark, sf_dir):
    """The first readable date counts; a row without one keeps its score."""
    return K.recency_rerank(hits(spark, sf_dir), _age()).select("query_id", "id", "rank", "score")


@query("k23_entity_boost", f"with {_hits_sql()}, {_ASKED_SQL}, {_NAMED_SQL} select query_id, id, rank, score from boosted")
def entity_boost(spark, sf_dir):
    return K.boost(_named(spark, sf_dir, hits(spark, sf_dir)), F.col("named")).select("query_id", "id", "rank", "score")


_AGE_SQL = f"coalesce(1 + 0.2 / (date_diff('day', try_cast(case id % 4 when 0 then 'junk' else '2024-01-' || lpad(cast(id % 28 + 1 as varchar), 2, '0') end as date), date '{NOW}') + 1), 1)"
_BY_CLASS = lambda rows, classes: f"select query_id, id, rank from {rows} where query_id in (select query_id from cls where class in ({', '.join(repr(c) for c in classes)}))"
_SPREAD = ("comparison", "relationship", "factual_general")


@query(
    "k24_rerank_by_type",
    f"""with {_hits_sql()}, {_ASKED_SQL}, {_NAMED_SQL},
cls as (select h.query_id, coalesce(max({_case_sql('lower(question)', R.QUESTION_CLASSES, 'factual_general')}), 'factual_general') as class from hits h left join asked on h.query_id = asked.query_id group by h.query_id),
{_diverse_sql("(select case class when 'comparison' then 0.15 when 'factual_general' then 0.21 else 0.3 end::double from cls where cls.query_id = c.query_id)")},
recent as (select query_id, id, row_number() over (partition by query_id order by round(score * {_AGE_SQL}, 9) desc, id) as rank from hits)
{_BY_CLASS('hits', ['factual_specific'])} union all {_BY_CLASS('diverse', _SPREAD)} union all {_BY_CLASS('recent', ['temporal'])} union all {_BY_CLASS('boosted', ['entity_search'])}""",
)
def rerank_by_type(spark, sf_dir):
    """Specific questions stay as they are; the others are spread (comparisons by half the weight, general ones by 0.7), freshened or boosted."""
    h = hits(spark, sf_dir)
    kind = questions_of_vectors(spark, sf_dir).select("query_id", R.first_rule(F.lower("question"), R.QUESTION_CLASSES, "factual_general").alias("class"))
    of = h.join(kind, "query_id", "left").withColumn("class", F.coalesce("class", F.lit("factual_general")))
    some = lambda *classes: of.where(F.col("class").isin(*classes))
    weight = F.when(F.col("class") == "comparison", 0.3 * 0.5).when(F.col("class") == "factual_general", 0.3 * 0.7).otherwise(0.3)
    parts = [some("factual_specific"), K.diversity_rerank(some(*_SPREAD), weight), K.recency_rerank(some("temporal"), _age()), K.boost(_named(spark, sf_dir, some("entity_search")), F.col("named"))]
    out = parts[0].select("query_id", "id", "rank")
    for p in parts[1:]:
        out = out.unionByName(p.select("query_id", "id", "rank"))
    return out


@query("k31_hit_at_5", f"with {_BM25_SQL}, h as (select query_id, max(case when contains(d.text, b.text) then 1 else 0 end) as hit from bm25 join documents d on id = doc_id join benchmark b on query_id = item_id where bm25.rank <= 5 group by query_id) select count(*) as queries, cast(sum(hit) as bigint) as hits, round(avg(hit), 6)::double as hit_rate from h")
def hit_at_5(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("found"))
    q = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    h = K.with_texts(bm25(spark, sf_dir, 5).join(q, "query_id"), d).groupBy("query_id").agg(F.max(F.contains("found", F.col("text")).cast("int")).alias("hit"))
    return h.agg(F.count(F.lit(1)).alias("queries"), F.sum("hit").alias("hits"), F.round(F.avg("hit"), 6).alias("hit_rate"))


@query("u01_union_of_lists", f"with {_hits_sql()}, {_KEYWORD_SQL} select query_id, id, 'vector' as leg from hits union all select query_id, id, 'keyword' from kw where rank <= 5")
def union_of_lists(spark, sf_dir):
    one = hits(spark, sf_dir).select("query_id", "id", F.lit("vector").alias("leg"))
    return one.unionByName(keyword_hits(spark, sf_dir, 5).select("query_id", "id", F.lit("keyword").alias("leg")))


@query("j19_remaining", f"with {_hits_sql()} select query_id, id from hits where (query_id, id) not in (select query_id, id from hits where rank <= 5)")
def remaining(spark, sf_dir):
    h = hits(spark, sf_dir)
    return h.join(h.where("rank <= 5").select("query_id", "id"), ["query_id", "id"], "left_anti").select("query_id", "id")
