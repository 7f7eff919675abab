"""Queries of graphs, the metadata store, sources and streams."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import store as S
from ..registry import query
from ..sources.binary import decoded
from ..sources.tables import CHUNKS_SQL, FILES_SQL, chunks, files, read, values_sql
from ..streaming import limits as L
from ..streaming.think import filter_batch


def _n():
    return F.count(F.lit(1))


def edges(spark, sf_dir):
    """Orders that follow orders: every document points at two others."""
    d = F.col("doc_id")
    e = read(spark, sf_dir, "documents").select(d.alias("src"), F.explode(F.array(F.struct(((d * 7 + 3) % 900).alias("dst"), F.lit("cites").alias("relation")), F.struct(((d * d + 1) % 900).alias("dst"), F.when(d % 3 == 0, "gap").otherwise("cites").alias("relation")))).alias("e"))
    return e.select("src", "e.dst", "e.relation").where("src <> dst").distinct()


_EDGES = "edges as (select distinct src, dst, relation from (select doc_id as src, (doc_id * 7 + 3) % 900 as dst, 'cites' as relation from documents union all select doc_id, (doc_id * doc_id + 1) % 900, case when doc_id % 3 = 0 then 'gap' else 'cites' end from documents) where src <> dst)"


def _seeds(spark, sf_dir):
    return read(spark, sf_dir, "documents").where("doc_id % 50 = 0").select(F.col("doc_id").alias("id"))


@query(
    "g02_merge_graph",
    f"""with {_EDGES}, e as (select src % 50 as s, dst % 60 as d, relation, src as seq from edges), n as (select doc_id % 55 as id, lang as type, doc_id as seq from documents),
l as (select s, d from e group by all), k as (select id, max_by(type, seq) as type from n group by id)
select coalesce(k.id, x.id) as id, coalesce(type, 'unknown') as type from k full join (select s as id from l union select d from l) x on k.id = x.id""",
)
def merge_graph(spark, sf_dir):
    n = read(spark, sf_dir, "documents").select((F.col("doc_id") % 55).alias("id"), F.col("lang").alias("type"), F.col("doc_id").alias("seq"))
    e = edges(spark, sf_dir).select((F.col("src") % 50).alias("src"), (F.col("dst") % 60).alias("dst"), "relation", F.col("src").alias("seq"))
    return G.merge_graph(n, e)[0]


@query("g03_merge_relations", f"with {_EDGES} select src, dst, relation from edges union select src, dst, 'external' from (select doc_id as src, doc_id + 1 as dst, trim(case when doc_id % 4 = 0 then '  ' else ' x ' end) as r from documents) where r <> ''")
def merge_relations(spark, sf_dir):
    d = F.col("doc_id")
    more = read(spark, sf_dir, "documents").select(d.alias("src"), (d + 1).alias("dst"), F.trim(F.when(d % 4 == 0, "  ").otherwise(" x ")).alias("r")).where("r <> ''")
    return edges(spark, sf_dir).unionByName(more.select("src", "dst", F.lit("external").alias("relation"))).distinct()


_HOPS = f"""{_EDGES}, b as (select src, dst from edges union select dst, src from edges), h0 as (select doc_id as seed, doc_id as id from documents where doc_id % 50 = 0),
h1 as (select distinct seed, dst as id from h0 join b on h0.id = b.src where (seed, dst) not in (select seed, id from h0)),
h2 as (select distinct seed, dst as id from h1 join b on h1.id = b.src where (seed, dst) not in (select seed, id from h0 union all select seed, id from h1)),
hops as (select seed, id, 0 as hops from h0 union all select seed, id, 1 from h1 union all select seed, id, 2 from h2)"""


@query("g04_k_hop", f"with {_HOPS} select seed, id, hops from hops")
def k_hop(spark, sf_dir):
    return G.within_hops(G.both_ways(edges(spark, sf_dir)), _seeds(spark, sf_dir), 2)


@query("g04_k_hop_edges", f"with {_HOPS} select src, dst, relation from edges where src in (select id from hops where seed = 50) and dst in (select id from hops where seed = 50)")
def k_hop_edges(spark, sf_dir):
    e = edges(spark, sf_dir)
    seed = _seeds(spark, sf_dir).where("id = 50")
    return G.induced(e, G.within_hops(G.both_ways(e), seed, 2)).select("src", "dst", "relation")


@query(
    "g05_related_paths",
    f"""with recursive {_EDGES}, w as (select doc_id as seed, doc_id as id, [doc_id] as seen, cast([] as varchar[]) as rel from documents where doc_id % 50 = 0
union all select w.seed, e.dst, list_append(seen, e.dst), list_append(rel, e.relation) from w join edges e on w.id = e.src where len(rel) < 3 and not list_contains(seen, e.dst)),
p as (select seed, id, len(rel) as hops, array_to_string(rel, '>') as r from w where len(rel) > 0)
select seed, id, cast(hops as int) as hops, r as relations from (select *, row_number() over (partition by seed, id order by hops, r) as n from p) where n = 1""",
)
def related_paths(spark, sf_dir):
    return G.paths(edges(spark, sf_dir), _seeds(spark, sf_dir), 3)


@query("g06_reachability", f"with recursive {_EDGES}, r as (select doc_id as seed, doc_id as id from documents where doc_id % 50 = 0 union select r.seed, e.dst from r join edges e on r.id = e.src) select seed, count(*) as reached from r group by seed")
def reachability(spark, sf_dir):
    return G.reachable(edges(spark, sf_dir).select("src", "dst").distinct(), _seeds(spark, sf_dir)).groupBy("seed").agg(_n().alias("reached"))


@query("g07_contradictions", f"with {_EDGES} select src, dst, 'gap between ' || src || ' and ' || dst as description from edges where relation = 'gap'")
def contradictions(spark, sf_dir):
    return edges(spark, sf_dir).where("relation = 'gap'").select("src", "dst", F.concat(F.lit("gap between "), F.col("src").cast("string"), F.lit(" and "), F.col("dst").cast("string")).alias("description"))


@query("g08_occurrences", f"with {CHUNKS_SQL} select chunk_id from chunks where contains(lower(content), 'eriner')")
def occurrences(spark, sf_dir):
    return chunks(spark, sf_dir).where(F.contains(F.lower("content"), F.lit("eriner"))).select("chunk_id")


@query("g09_references_to_file", f"with {FILES_SQL}, {_EDGES} select src, dst from edges join files on dst = doc_id where file_name = 'doc_10.docx' or contains(file_name, 'doc_1')")
def references_to_file(spark, sf_dir):
    f = files(spark, sf_dir).where((F.col("file_name") == "doc_10.docx") | F.contains("file_name", F.lit("doc_1"))).select(F.col("doc_id").alias("dst"))
    return edges(spark, sf_dir).join(f, "dst", "left_semi").select("src", "dst")


@query("g10_mentioned_in", "select distinct lang as entity, 'doc_' || doc_id as document, 'mentioned_in' as relation from documents union all select distinct regexp_extract(text, '[A-Z][a-z]{7,}'), 'doc_' || doc_id, 'mentioned_in' from documents where regexp_matches(text, '[A-Z][a-z]{7,}')")
def mentioned_in(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select(F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("document"), "lang", F.regexp_extract("text", "[A-Z][a-z]{7,}", 0).alias("w"))
    named = d.select(F.col("lang").alias("entity"), "document").distinct().unionByName(d.where("w <> ''").select(F.col("w").alias("entity"), "document").distinct())
    return named.withColumn("relation", F.lit("mentioned_in"))


@query("g11_conflicts", f"with {_EDGES}, s as (select src, dst from edges group by all having count(distinct relation) > 1) select src, dst, 'several_relations' as kind from s union all select distinct a.src, a.dst, 'circular' from edges a join edges b on a.src = b.dst and a.dst = b.src and a.relation = b.relation where a.src < a.dst")
def conflicts(spark, sf_dir):
    return G.conflicts(edges(spark, sf_dir))


@query("g12_folder_closure", "select c_custkey, 'R' || n_regionkey || '/' || n_nationkey || '/' || c_custkey as path from customer join nation on c_nationkey = n_nationkey where n_regionkey = 2")
def folder_closure(spark, sf_dir):
    tree = S.folder_paths(_folders(spark, sf_dir))
    return tree.where("root = 'r2' and depth = 2").select(F.substring("id", 2, 20).cast("long").alias("c_custkey"), "path")


def _folders(spark, sf_dir):
    """Regions, nations and customers as a folder hierarchy."""
    n, c = read(spark, sf_dir, "nation"), read(spark, sf_dir, "customer")
    text = lambda p, x: F.concat(F.lit(p), F.col(x).cast("string"))
    roots = read(spark, sf_dir, "region").select(text("r", "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent"), text("R", "r_regionkey").alias("name"))
    mid = n.select(text("n", "n_nationkey").alias("id"), text("r", "n_regionkey").alias("parent"), text("", "n_nationkey").alias("name"))
    leaf = c.select(text("c", "c_custkey").alias("id"), text("n", "c_nationkey").alias("parent"), text("", "c_custkey").alias("name"))
    return roots.unionByName(mid).unionByName(leaf)


_TREE = "select 'R' || r_regionkey as path, 0 as depth from region union all select 'R' || n_regionkey || '/' || n_nationkey, 1 from nation union all select 'R' || n_regionkey || '/' || n_nationkey || '/' || c_custkey, 2 from customer join nation on c_nationkey = n_nationkey"


@query("s03_folder_tree", _TREE)
def folder_tree(spark, sf_dir):
    return S.folder_paths(_folders(spark, sf_dir)).select("path", "depth")


@query("t29_path_map", f"with t as ({_TREE}) select path, length(path) as n from t where depth > 0")
def path_map(spark, sf_dir):
    return S.folder_paths(_folders(spark, sf_dir)).where("depth > 0").select("path", F.length("path").cast("long").alias("n"))


@query("g13_entity_validation", "select p_partkey, case when length(p_name) < 2 then 0 when p_type is null then 0.5 when p_size < 10 then 0.6 else 1 end::double as score, concat_ws(',', case when p_size < 10 then 'low_confidence' end, case when length(p_name) > 25 then 'long' end) as flags from part")
def entity_validation(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    score = F.when(F.length("p_name") < 2, 0.0).when(F.col("p_type").isNull(), 0.5).when(F.col("p_size") < 10, 0.6).otherwise(1.0)
    return p.select("p_partkey", score.alias("score"), F.array_join(F.array_compact(F.array(F.when(F.col("p_size") < 10, "low_confidence"), F.when(F.length("p_name") > 25, "long"))), ",").alias("flags"))


@query("g14_relationship_score", "select event_id, round(case when user_id % 9 = 0 then 0 else least(value % 1 + case event_id % 3 when 0 then 0.2 when 1 then 0.1 else 0 end, 1) end, 6)::double as score from events")
def relationship_score(spark, sf_dir):
    e = F.col("event_id") % 3
    kind = F.when(e == 0, "entity_overlap").when(e == 1, "temporal").otherwise("other")
    return read(spark, sf_dir, "events").select("event_id", F.round(G.relationship_score(kind, F.col("value") % 1, F.col("user_id") % 9 != 0), 6).alias("score"))


@query("g15_conflict_resolution", f"with {_EDGES}, s as (select *, row_number() over (partition by src, dst order by case relation when 'cites' then 0.9 else 0.5 end desc, relation) as n from edges) select src, dst, relation, case when n = 1 then 'keep' else 'merge' end as action from s")
def conflict_resolution(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("src", "dst").orderBy(F.when(F.col("relation") == "cites", 0.9).otherwise(0.5).desc(), "relation")
    return edges(spark, sf_dir).withColumn("n", F.row_number().over(w)).select("src", "dst", "relation", F.when(F.col("n") == 1, "keep").otherwise("merge").alias("action"))


@query("g16_maintenance", f"with {_EDGES} select 'low_score' as reason, src, dst from edges where (src * dst) % 10 < 3 union all select 'invalid', src, dst from edges where relation = 'gap' and src % 2 = 0")
def maintenance(spark, sf_dir):
    e = edges(spark, sf_dir)
    low = e.where("(src * dst) % 10 < 3").select(F.lit("low_score").alias("reason"), "src", "dst")
    return low.unionByName(e.where("relation = 'gap' and src % 2 = 0").select(F.lit("invalid").alias("reason"), "src", "dst"))


@query("g17_cascade_delete", "select o_orderkey, count(l_orderkey) as lines from orders left join lineitem on o_orderkey = l_orderkey where o_custkey % 3 <> 0 group by o_orderkey")
def cascade_delete(spark, sf_dir):
    orders, lines = read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem").select("l_orderkey")
    gone = orders.where("o_custkey % 3 = 0").select("o_orderkey")
    kept, children = S.cascade_delete(orders, lines, gone, "o_orderkey", "l_orderkey")
    return kept.join(children, kept.o_orderkey == children.l_orderkey, "left").groupBy("o_orderkey").agg(F.count("l_orderkey").alias("lines"))


@query(
    "a18_common_entities",
    """with recursive e as (select 'd' || doc_id as src, 'e' || (doc_id // 3) as dst from documents where doc_id % 3 <> 0
  union select 'e' || (doc_id // 3), 'e' || (doc_id // 5 + 7) from documents where doc_id % 2 = 0 union select 'e' || (doc_id // 4), 'd' || doc_id from documents where doc_id % 11 = 0),
reach as (select distinct src as doc, dst as node from e where src like 'd%' union select doc, dst from reach join e on node = src),
led as (select distinct dst as doc, src as node from e where dst like 'd%' union select doc, src from led join e on node = dst),
met as (select doc, node from reach union select doc, node from led)
select node as entity, min(doc) as first_document, min(doc) filter (where doc > least_doc) as second_document
from (select *, min(doc) over (partition by node) as least_doc from met where node like 'e%') group by node having count(distinct doc) > 1""",
)
def common_entities(spark, sf_dir):
    """Entities that paths of any length join to two documents; documents cite entities, entities others and documents."""
    d = F.col("doc_id")
    name = lambda kind, number: F.concat(F.lit(kind), number.cast("long").cast("string"))
    docs = read(spark, sf_dir, "documents")
    cites = docs.where("doc_id % 3 <> 0").select(name("d", d).alias("src"), name("e", F.floor(d / 3)).alias("dst"))
    leads = docs.where("doc_id % 2 = 0").select(name("e", F.floor(d / 3)).alias("src"), name("e", F.floor(d / 5) + 7).alias("dst"))
    names = docs.where("doc_id % 11 = 0").select(name("e", F.floor(d / 4)).alias("src"), name("d", d).alias("dst"))
    e = cites.unionByName(leads).unionByName(names).distinct()
    sources = e.select(F.explode(F.array("src", "dst")).alias("id")).where("id like 'd%'").distinct()
    return G.common_nodes(e, sources).select(F.col("id").alias("entity"), F.col("first").alias("first_document"), F.col("second").alias("second_document"))


@query(
    "k30_graph_seeds",
    f"""with {_EDGES}, q as (select list_distinct(regexp_extract_all(lower(text), '[a-z]{{4,}}')) as ws, item_id from benchmark),
s as (select item_id, doc_id, len(list_intersect(ws, regexp_extract_all(lower(text), '[a-z]{{4,}}'))) as score from q, documents where list_has_any(ws, regexp_extract_all(lower(text), '[a-z]{{4,}}'))),
t as (select * from (select *, row_number() over (partition by item_id order by score desc, doc_id) as r from s) where r <= 3)
select item_id, doc_id as id from t union select item_id, dst from t join edges on doc_id = src union select item_id, src from t join edges on doc_id = dst""",
)
def graph_seeds(spark, sf_dir):
    """Three documents that share most words with a question, and their neighbours both ways."""
    from pyspark.sql import Window

    words = lambda: F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0)))).alias("w")
    asked = read(spark, sf_dir, "benchmark").select("item_id", words())
    score = read(spark, sf_dir, "documents").select("doc_id", words()).join(asked, "w").groupBy("item_id", "doc_id").agg(_n().alias("score"))
    top = score.withColumn("r", F.row_number().over(Window.partitionBy("item_id").orderBy(F.col("score").desc(), "doc_id"))).where("r <= 3").select("item_id", F.col("doc_id").alias("id"))
    e = G.both_ways(edges(spark, sf_dir))
    return top.unionByName(top.join(e, top.id == e.src).select("item_id", F.col("dst").alias("id"))).distinct()


@query("s01_folder_listing", f"with {FILES_SQL} select folder_id, file_id, file_name from files where folder_id in ('src1', 'src2')")
def folder_listing(spark, sf_dir):
    return files(spark, sf_dir).where(F.col("folder_id").isin("src1", "src2")).select("folder_id", "file_id", "file_name")


@query("s02_recursive_listing", "select n_regionkey as root, count(*) as folders, cast(sum(n) as bigint) as files from nation join (select c_nationkey, c_custkey, count(o_orderkey) as n from customer left join orders on c_custkey = o_custkey group by all) on n_nationkey = c_nationkey group by n_regionkey")
def recursive_listing(spark, sf_dir):
    tree = S.folder_paths(_folders(spark, sf_dir)).where("depth = 2").select(F.substring("root", 2, 9).cast("int").alias("root"), F.substring("id", 2, 20).cast("long").alias("o_custkey"))
    counts = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(_n().alias("n"))
    return tree.join(counts, "o_custkey", "left").groupBy("root").agg(_n().alias("folders"), F.sum(F.coalesce("n", F.lit(0))).alias("files"))


@query("s04_point_lookup", f"with {FILES_SQL} select file_id, file_name, size from files where file_id = 'f17'")
def point_lookup(spark, sf_dir):
    return files(spark, sf_dir).where("file_id = 'f17'").select("file_id", "file_name", "size")


_URLS = [(1, "https://x/drive/folders/abc_-9?usp=1"), (2, "https://x/open?id=ZZ9&y=1"), (3, "https://x/none"), (4, "https://x/folders/" + "q" * 70)]


@query("s06_folder_url", f"with u as (select uid, coalesce(nullif(regexp_extract(u, '/folders/([a-zA-Z0-9_-]+)', 1), ''), nullif(regexp_extract(u, '[?&]id=([a-zA-Z0-9_-]+)', 1), '')) as f from {values_sql(_URLS, 'u(uid, u)')}) select uid, case when length(f) <= 64 then f end as folder_id from u union all select page_id + 100, nullif(regexp_extract(url, '/([a-z]{{2}})/', 1), '') from pages")
def folder_url(spark, sf_dir):
    some = lambda c: F.when(c != "", c)
    f = F.coalesce(some(F.regexp_extract("u", "/folders/([a-zA-Z0-9_-]+)", 1)), some(F.regexp_extract("u", "[?&]id=([a-zA-Z0-9_-]+)", 1)))
    one = spark.createDataFrame(_URLS, "uid long, u string").select("uid", F.when(F.length(f) <= 64, f).alias("folder_id"))
    return one.unionByName(read(spark, sf_dir, "pages").select((F.col("page_id") + 100).alias("uid"), some(F.regexp_extract("url", "/([a-z]{2})/", 1)).alias("folder_id")))


_EXPORTS = {"application/vnd.google-apps.document": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "application/vnd.google-apps.spreadsheet": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "application/vnd.google-apps.presentation": "application/vnd.openxmlformats-officedocument.presentationml.presentation"}
_MIMES = [*_EXPORTS, "application/vnd.google-apps.drawing", "text/plain"]


@query("s07_export_mime", f"select doc_id, coalesce(e.t, 'application/pdf') as export_mime from (select doc_id, list_extract({_MIMES!r}, cast(doc_id % 5 + 1 as int)) as m from documents) m left join {values_sql(list(_EXPORTS.items()), 'e(m, t)')} on m.m = e.m")
def export_mime(spark, sf_dir):
    table = F.create_map(*[F.lit(x) for kv in _EXPORTS.items() for x in kv])
    mime = F.element_at(F.array(*[F.lit(m) for m in _MIMES]), (F.col("doc_id") % 5 + 1).cast("int"))
    return read(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.try_element_at(table, mime), F.lit("application/pdf")).alias("export_mime"))


@query("s08_decoded_text", "select doc_id, md5(case doc_id % 4 when 2 then regexp_replace(text, '[^\\x00-\\x{FF}]', '?', 'g') when 3 then '' else text end) as decoded from documents")
def decoded_text(spark, sf_dir):
    """Whole texts back from bytes: UTF-8, with a byte-order mark, Latin-1, none."""
    k = F.col("doc_id") % 4
    content = F.when(k == 1, F.concat(F.lit(b"\xef\xbb\xbf"), F.encode("text", "UTF-8"))).when(k == 2, F.encode(F.regexp_replace("text", r"[^\x{0}-\x{FF}]", "?"), "ISO-8859-1")).when(k == 3, F.lit(b"")).otherwise(F.encode("text", "UTF-8"))
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(decoded(content).cast("binary")).alias("decoded"))


@query("s12_dispatch", f"with {FILES_SQL} select case when size > 20000 then 'too_large' when mime_type like 'audio/%' or mime_type like 'video/%' then 'audio' when mime_type = 'application/pdf' then 'pdf' when mime_type like 'text/%' then 'text' when mime_type = 'application/octet-stream' then 'none' else 'universal' end as route, count(*) as n from files group by 1")
def dispatch(spark, sf_dir):
    m = F.col("mime_type")
    route = F.when(F.col("size") > 20000, "too_large").when(m.startswith("audio/") | m.startswith("video/"), "audio").when(m == "application/pdf", "pdf").when(m.startswith("text/"), "text").when(m == "application/octet-stream", "none").otherwise("universal")
    return files(spark, sf_dir).groupBy(route.alias("route")).agg(_n().alias("n"))


@query("s14_vector_upsert", "select vec_id as id, label::bigint as file_key, 0 as seq from embeddings where vec_id % 3 <> 0 union all select vec_id, -1, 1 from embeddings where vec_id % 3 = 0 union all select vec_id + 1000000, -1, 1 from embeddings where vec_id % 3 = 0")
def vector_upsert(spark, sf_dir):
    v = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("file_key"), F.lit(0).alias("seq"))
    change = v.where("id % 3 = 0").select(F.explode(F.array(F.col("id"), F.col("id") + 1000000)).alias("id"), F.lit(-1).cast("long").alias("file_key"), F.lit(1).alias("seq"))
    return S.upsert(v, change, ["id"])


@query("s15_vector_append", "select count(*) as n, count(distinct vec_id) as ids from (select vec_id from embeddings union all select vec_id from embeddings where label = 3)")
def vector_append(spark, sf_dir):
    v = read(spark, sf_dir, "embeddings").select("vec_id", "label")
    return v.select("vec_id").unionAll(v.where("label = 3").select("vec_id")).agg(_n().alias("n"), F.count_distinct("vec_id").alias("ids"))


@query("s16_vector_rows", f"with {FILES_SQL} select file_id, file_id as source_file_id, size % 60 as timestamp_start, size % 60 as timestamp_end, coalesce(case when doc_id % 2 = 0 then 'audio' end, 'unstructured_native') as file_type from files")
def vector_rows(spark, sf_dir):
    f = files(spark, sf_dir).withColumns({"timestamp_start": F.col("size") % 60, "timestamp_end": F.lit(None).cast("long"), "category": F.when(F.col("doc_id") % 2 == 0, "audio")})
    return S.vector_rows(f).select("file_id", "source_file_id", "timestamp_start", "timestamp_end", "file_type")


@query("s17_vector_delete", "select vec_id from embeddings where vec_id not in (select doc_id from documents where doc_id % 7 = 0) and label <> 2")
def vector_delete(spark, sf_dir):
    gone = read(spark, sf_dir, "documents").where("doc_id % 7 = 0").select(F.col("doc_id").alias("vec_id"))
    return S.delete(read(spark, sf_dir, "embeddings"), gone, ["vec_id"]).where("label <> 2").select("vec_id")


@query("s18_collection_info", "select 'embeddings' as name, count(*) as n, cast(max(len(embedding)) as bigint) as dimensions from embeddings")
def collection_info(spark, sf_dir):
    return read(spark, sf_dir, "embeddings").agg(F.lit("embeddings").alias("name"), _n().alias("n"), F.max(F.size("embedding")).cast("long").alias("dimensions"))


@query("s19_file_upsert", f"with {FILES_SQL} select file_id, file_name, case when doc_id % 5 = 0 then size + 1 else size end as size from files")
def file_upsert(spark, sf_dir):
    f = files(spark, sf_dir).select("file_id", "file_name", "size", "doc_id", F.lit(0).alias("seq"))
    changed = f.where("doc_id % 5 = 0").withColumns({"size": F.col("size") + 1, "seq": F.lit(1)})
    return S.upsert(f, changed, ["file_id"]).select("file_id", "file_name", "size")


@query("s20_chunk_upsert", f"with {CHUNKS_SQL} select chunk_id, case when chunk_index = 0 then 'new' else md5(content) end as version from chunks")
def chunk_upsert(spark, sf_dir):
    c = chunks(spark, sf_dir).select("chunk_id", F.md5(F.col("content").cast("binary")).alias("version"), "chunk_index", F.lit(0).alias("seq"))
    return S.upsert(c, c.where("chunk_index = 0").withColumns({"version": F.lit("new"), "seq": F.lit(1)}), ["chunk_id"]).select("chunk_id", "version")


@query("s21_message_append", "select conv_id, count(*) + 1 as messages, max(turn) + 1 as last_turn from conversations group by conv_id")
def message_append(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = c.groupBy("conv_id").agg((F.max("turn") + 1).alias("turn")).select("conv_id", "turn", F.lit("assistant").alias("role"), F.to_json(F.struct(F.lit("a.pdf").alias("file"))).alias("text"))
    return c.unionByName(more).groupBy("conv_id").agg(_n().alias("messages"), F.max("turn").alias("last_turn"))


@query("s22_graph_roundtrip", f"with {_EDGES} select src, dst, relation from edges where src % 10 = 0")
def graph_roundtrip(spark, sf_dir):
    """Edges through their stored JSON form and back."""
    e = edges(spark, sf_dir).where("src % 10 = 0")
    stored = e.select(F.to_json(F.struct("src", "dst", "relation")).alias("j"))
    return stored.select(F.from_json("j", "src long, dst long, relation string").alias("r")).select("r.*")


@query("s23_cache_expiry", "select user_id, count(*) as live, cast(sum(cast(floor(value) as bigint)) as bigint) as size from events where ts + interval 240 hours > timestamp '2024-02-01' group by user_id")
def cache_expiry(spark, sf_dir):
    live = read(spark, sf_dir, "events").where("ts + interval 240 hours > timestamp_ntz '2024-02-01 00:00:00'")
    return live.groupBy("user_id").agg(_n().alias("live"), F.sum(F.floor("value").cast("long")).alias("size"))


@query("s24_graph_export", f"with {_EDGES} select src, count(*) as links, string_agg(dst || ':' || relation, ',' order by dst, relation) as exported from edges group by src")
def graph_export(spark, sf_dir):
    shown = F.transform(F.array_sort(F.collect_list(F.struct("dst", "relation"))), lambda x: F.concat(x["dst"].cast("string"), F.lit(":"), x["relation"]))
    return edges(spark, sf_dir).groupBy("src").agg(_n().alias("links"), F.array_join(shown, ",").alias("exported"))


@query("w17_token_bucket")
def token_bucket(spark, sf_dir):
    seconds = F.unix_timestamp(F.col("ts").cast("timestamp"))
    return L.token_bucket(read(spark, sf_dir, "events"), "user_id", seconds, "event_id", 1 / 86400, 3)


@query("w18_adaptive_rate")
def adaptive_rate(spark, sf_dir):
    def fold(g: pd.DataFrame) -> pd.DataFrame:
        outcomes = ["limited" if v > 95 else "error" if v > 80 else "ok" for v in g["value"]]
        return pd.DataFrame({"user_id": [g["user_id"].iloc[0]], "rate": [L.adaptive_rates(outcomes)[-1]]})

    return L.per_key(read(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value"), "user_id", fold, "user_id long, rate double")


@query("x01_think_filter")
def think_filter(spark, sf_dir):
    """Token streams of three characters a token, half of them with a thinking region."""
    c = read(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("stream_id"), F.when(F.col("turn") % 2 == 1, F.concat(F.lit("plan <think>secret "), F.col("text"), F.lit("</think>"), F.left("text", F.lit(30)))).otherwise(F.col("text")).alias("t"))
    tokens = c.select("stream_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.floor(F.length("t") / 3).cast("int")), lambda i: F.substring("t", i * 3 + 1, F.lit(3)))).alias("seq", "token"))
    return filter_batch(tokens)


@query("x04_latest_progress", "select user_id, max_by(event_type, (ts, event_id)) as last_type, max(ts) as last_ts from events group by user_id")
def latest_progress(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("last_type"), F.max("ts").alias("last_ts"))


@query("x08_cache_replay")
def cache_replay(spark, sf_dir):
    def fold(g: pd.DataFrame) -> pd.DataFrame:
        keys = [(t.timestamp(), k) for t, k in zip(g["ts"], g["event_type"], strict=True)]
        hits = L.lru_replay(keys, 2, 7 * 86400)
        return pd.DataFrame({"user_id": [g["user_id"].iloc[0]], "hits": [sum(hits)], "misses": [len(hits) - sum(hits)]})

    return L.per_key(read(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type"), "user_id", fold, "user_id long, hits long, misses long")
