"""Queries of the metadata filter language."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from ..operators.filters import post_filter, restricts_content, retrieval_filter, search_filter, where_clause
from ..registry import query
from ..sources.tables import CHUNKS_SQL, FILES_SQL, chunks, files, read


def _notes(spark, sf_dir):
    """Documents with the metadata that filters look at."""
    created = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 365).cast("int")), "yyyy-MM-dd")
    return read(spark, sf_dir, "documents").select(
        "doc_id",
        F.col("source").alias("folder_id"),
        F.col("lang").alias("element_type"),
        (F.col("n_chars") % 10).alias("page_number"),
        F.when(F.col("doc_id") % 7 != 0, created).alias("created_at"),
        (F.col("n_chars") % 600).alias("timestamp_start"),
        F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("file_id"),
        F.concat(F.lit("Note_"), (F.col("doc_id") % 40).cast("string"), F.lit(".txt")).alias("file_name"),
        F.when(F.col("doc_id") % 3 == 0, "PDF").when(F.col("doc_id") % 3 == 1, "text").otherwise("Audio").alias("file_type"),
        F.when(F.col("doc_id") % 2 == 0, "text/plain").otherwise("application/pdf").alias("mime_type"),
    )


_NOTES = """notes as (select doc_id, source as folder_id, lang as element_type, n_chars % 10 as page_number,
  case when doc_id % 7 <> 0 then strftime(date '2024-01-01' + cast(doc_id % 365 as int), '%Y-%m-%d') end as created_at, n_chars % 600 as timestamp_start,
  'f' || doc_id as file_id, 'Note_' || (doc_id % 40) || '.txt' as file_name, case doc_id % 3 when 0 then 'PDF' when 1 then 'text' else 'Audio' end as file_type, case doc_id % 2 when 0 then 'text/plain' else 'application/pdf' end as mime_type from documents)"""
_SPEC = {"folder_id": {"$eq": "src3"}, "page_number": [0, 1, 2, 3, 4], "date_range": {"start": date(2024, 2, 1), "end": date(2024, 11, 30)}, "timestamp_range": {"start": 50}, "mime_type": "text/plain", "element_type": ["en", "fr"], "no_such_key": 1}


@query("f01_retrieval_filter", f"with {_NOTES} select doc_id from notes where folder_id = 'src3' and page_number < 5 and created_at between '2024-02-01' and '2024-11-30' and timestamp_start >= 50 and element_type in ('en', 'fr') and mime_type = 'text/plain'")
def retrieval(spark, sf_dir):
    return _notes(spark, sf_dir).where(retrieval_filter(_SPEC)).select("doc_id")


@query("f02_post_filter", f"with {_NOTES} select doc_id from notes where element_type = 'de' and (created_at is null or created_at between '2024-03-01' and '2024-09-30')")
def post(spark, sf_dir):
    return _notes(spark, sf_dir).where(post_filter({"element_type": "de", "date_range": {"$gte": "2024-03-01", "$lte": "2024-09-30"}})).select("doc_id")


@query("f03_content_type_filter", f"with {_NOTES} select doc_id from notes where lower(file_type) in ('pdf', 'audio') and folder_id = 'src1'")
def content_type(spark, sf_dir):
    lowered = _notes(spark, sf_dir).withColumn("file_type", F.lower("file_type"))
    return lowered.where(where_clause({"$and": [{"file_type": {"$in": ["pdf", "audio"]}}, {"folder_id": "src1"}]})).select("doc_id")


_SPECS = [{"file_type": "pdf"}, {"$and": [{"file_type": "pdf"}, {"folder_id": "x"}]}, {"folder_id": "x"}, {"$and": [{"folder_id": "x"}]}]


@query("f04_restricts_content", "select conv_id * 100000 + turn as qid, (conv_id + turn) % 4 < 2 as restricts from conversations where role = 'user'")
def restricts(spark, sf_dir):
    """Whether the filter that a question comes with looks at contents."""
    known = F.array(*[F.lit(restricts_content(s)) for s in _SPECS])
    c, t = F.col("conv_id"), F.col("turn")
    return read(spark, sf_dir, "conversations").where("role = 'user'").select((c * 100000 + t).alias("qid"), F.element_at(known, ((c + t) % 4 + 1).cast("int")).alias("restricts"))


@query(
    "f05_filter_precedence",
    f"""with {_NOTES} select 'file' as asked, count(*) as n from notes where folder_id = 'src2' and file_id = 'f2' union all
select 'names', count(*) from notes where folder_id = 'src2' and file_name in ('Note_2.txt', 'Note_22.txt') union all
select 'type', count(*) from notes where folder_id = 'src2' and file_type = 'PDF' union all select 'folder', count(*) from notes where folder_id = 'src2'""",
)
def precedence(spark, sf_dir):
    asked = {
        "file": search_filter("src2", "f2", ["Note_2.txt"], {"file_type": "PDF"}),
        "names": search_filter("src2", None, ["Note_2.txt", "Note_22.txt"], {"file_type": "PDF"}),
        "type": search_filter("src2", None, None, {"file_type": "PDF"}),
        "folder": search_filter("src2"),
    }
    notes = _notes(spark, sf_dir)
    counts = notes.agg(*[F.count_if(where_clause(spec)).alias(name) for name, spec in asked.items()])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(n).alias("asked"), F.col(n).alias("n")) for n in asked])).alias("r")).select("r.*")


@query("f06_understanding_filter", f"with {_NOTES} select doc_id from notes where folder_id = 'src5' and file_type = 'text' and file_name in ('Note_5.txt', 'Note_25.txt')")
def understanding(spark, sf_dir):
    return _notes(spark, sf_dir).where(where_clause(search_filter("src5", None, ["Note_5.txt", "Note_25.txt"]) | {"file_type": "text"})).select("doc_id")


@query("f08_keyword_search", f"with {CHUNKS_SQL}, {FILES_SQL} select chunk_id, file_name from chunks join files using (doc_id) where content like '%the%' and folder_id = 'src6' order by chunk_id limit 50")
def keyword_search(spark, sf_dir):
    found = chunks(spark, sf_dir).where(F.contains("content", F.lit("the")))
    return found.join(files(spark, sf_dir).where("folder_id = 'src6'"), "doc_id").select("chunk_id", "file_name").orderBy("chunk_id").limit(50)


@query("f09_user_scope", "select o_orderkey from orders where o_custkey = 7 union all select o_orderkey from orders where o_custkey in (select c_custkey from customer where c_nationkey = 3) and o_orderstatus = 'O'")
def user_scope(spark, sf_dir):
    orders = read(spark, sf_dir, "orders")
    own = orders.where("o_custkey = 7").select("o_orderkey")
    team = read(spark, sf_dir, "customer").where("c_nationkey = 3").select(F.col("c_custkey").alias("o_custkey"))
    return own.unionAll(orders.where("o_orderstatus = 'O'").join(team, "o_custkey", "left_semi").select("o_orderkey"))


@query(
    "f10_graph_view",
    f"""with {_NOTES}, n as (select doc_id from notes where file_type in ('PDF', 'text')), e as (select doc_id as src, (doc_id * 7 + 3) % 900 as dst, case when doc_id % 2 = 0 then 'cites' else 'follows' end as relation from documents)
select src, dst from e where relation = 'cites' and src in (select doc_id from n) and dst in (select doc_id from n)""",
)
def graph_view(spark, sf_dir):
    """Edges of one relation, both ends visible: two semi-joins."""
    visible = _notes(spark, sf_dir).where(where_clause({"file_type": {"$in": ["PDF", "text"]}})).select("doc_id")
    edges = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("src"), ((F.col("doc_id") * 7 + 3) % 900).alias("dst"), F.when(F.col("doc_id") % 2 == 0, "cites").otherwise("follows").alias("relation"))
    return edges.where("relation = 'cites'").join(visible.withColumnRenamed("doc_id", "src"), "src", "left_semi").join(visible.withColumnRenamed("doc_id", "dst"), "dst", "left_semi").select("src", "dst")
