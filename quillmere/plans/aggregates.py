"""Queries of aggregations, windows and the metadata store's reads."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import routing as R
from ..registry import query
from ..sources.tables import CHUNKS_SQL, FILES_SQL, chunks, files, read
from ..streaming.windows import sessions, windowed
from .relations import _items_sql, items
from .retrieval import _hits_sql, hits


def _n():
    return F.count(F.lit(1))


@query("a01_chunks_per_file", f"with {CHUNKS_SQL} select doc_id, count(*) as n from chunks group by doc_id")
def chunks_per_file(spark, sf_dir):
    return chunks(spark, sf_dir).groupBy("doc_id").agg(_n().alias("n"))


@query("a02_file_distribution", f"with {_hits_sql()} select query_id, coalesce(case when file_key <> 3 then 'file_' || file_key end, 'Unknown') as file_name, count(*) as n from hits group by all")
def file_distribution(spark, sf_dir):
    name = F.coalesce(F.when(F.col("file_key") != 3, F.concat(F.lit("file_"), F.col("file_key").cast("string"))), F.lit("Unknown"))
    return hits(spark, sf_dir).groupBy("query_id", name.alias("file_name")).agg(_n().alias("n"))


@query("a03_files_per_folder", "select source as folder_id, count(doc_id) as n from documents group by source")
def files_per_folder(spark, sf_dir):
    return read(spark, sf_dir, "documents").groupBy(F.col("source").alias("folder_id")).agg(F.count("doc_id").alias("n"))


@query("a04_type_distribution", f"with {FILES_SQL}, c as (select folder_id, case when mime_type like 'text/%' then 'text' when mime_type like 'image/%' then 'image' else 'other' end as kind, count(*) as n from files group by all) select folder_id, string_agg(kind || '=' || n, ',' order by kind) as types from c group by folder_id")
def type_distribution(spark, sf_dir):
    m = F.col("mime_type")
    kind = F.when(m.startswith("text/"), "text").when(m.startswith("image/"), "image").otherwise("other")
    counted = files(spark, sf_dir).groupBy("folder_id", kind.alias("kind")).agg(_n().alias("n"))
    return counted.groupBy("folder_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("kind", "n"))), lambda x: F.concat(x["kind"], F.lit("="), x["n"].cast("string"))), ",").alias("types"))


@query("a05_entity_counts", "with e as (select source, unnest(regexp_extract_all(text, '[A-Z][a-z]{5,}')) as entity from documents), c as (select source, entity, count(*) as n from e group by all having count(*) >= 2) select * from (select source, entity, n, row_number() over (partition by source order by n desc, entity) as place from c) where place <= 10")
def entity_counts(spark, sf_dir):
    e = read(spark, sf_dir, "documents").select("source", F.explode(F.regexp_extract_all("text", F.lit("[A-Z][a-z]{5,}"), F.lit(0))).alias("entity"))
    c = e.groupBy("source", "entity").agg(_n().alias("n")).where("n >= 2")
    return c.withColumn("place", F.row_number().over(Window.partitionBy("source").orderBy(F.col("n").desc(), "entity"))).where("place <= 10")


# Capitalised words that are no key terms.
COMMON_TERMS = ["The", "This", "That", "These", "Those", "There", "They", "From", "With", "Have", "Has", "Had", "Will", "Would", "Should", "Could", "Can", "May", "Might", "Must"]


@query("a06_key_terms", "with e as (select doc_id, unnest(l) as term, generate_subscripts(l, 1) as pos from (select doc_id, list_filter(regexp_extract_all(text, '[\\p{L}\\p{N}_]+'), lambda w: regexp_full_match(w, '[A-Z][a-z]{2,}|[A-Z]{2,}')) as l from documents)), c as (select doc_id, term, count(*) as n, min(pos) as first from e where term not in " + repr(tuple(COMMON_TERMS)) + " group by all) select doc_id, term, n from (select *, row_number() over (partition by doc_id order by n desc, first) as r from c) where r <= 5")
def key_terms(spark, sf_dir):
    """Most frequent capitalised terms, ties by first appearance."""
    e = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.filter(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), lambda w: w.rlike("^(?:[A-Z][a-z]{2,}|[A-Z]{2,})$"))).alias("pos", "term"))
    c = e.where(~F.col("term").isin(COMMON_TERMS)).groupBy("doc_id", "term").agg(_n().alias("n"), F.min("pos").alias("first"))
    return c.withColumn("r", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("n").desc(), "first"))).where("r <= 5").select("doc_id", "term", "n")


@query("a07_shared_themes", f"with {_items_sql()}, c as (select folder, item, count(distinct id) as files from items group by all having count(distinct id) >= 2) select folder, item, files from (select *, row_number() over (partition by folder order by files desc, item) as r from c) where r <= 10")
def shared_themes(spark, sf_dir):
    c = items(spark, sf_dir).groupBy("folder", "item").agg(_n().alias("files")).where("files >= 2")
    return c.withColumn("r", F.row_number().over(Window.partitionBy("folder").orderBy(F.col("files").desc(), "item"))).where("r <= 10").drop("r")


@query("a08_file_summaries", f"with {CHUNKS_SQL}, k as (select doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z]{{12,}}')) as l from documents) select c.doc_id, count(*) as n_chunks, cast(sum(length(content)) as bigint) as chars, array_to_string(list_slice(list_sort(any_value(l)), 1, 5), ',') as topics from chunks c join k on c.doc_id = k.doc_id group by c.doc_id")
def file_summaries(spark, sf_dir):
    topics = F.array_join(F.slice(F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{12,}"), F.lit(0)))), 1, 5), ",")
    k = read(spark, sf_dir, "documents").select("doc_id", topics.alias("topics"))
    return chunks(spark, sf_dir).groupBy("doc_id").agg(_n().alias("n_chunks"), F.sum(F.length("content")).alias("chars")).join(k, "doc_id")


@query("a09_folder_insights", f"with {FILES_SQL} select folder_id, count(*) as files, count(distinct mime_type) as types, cast(sum(size) as bigint) as bytes, max(size) as largest from files group by folder_id")
def folder_insights(spark, sf_dir):
    return files(spark, sf_dir).groupBy("folder_id").agg(_n().alias("files"), F.count_distinct("mime_type").alias("types"), F.sum("size").alias("bytes"), F.max("size").alias("largest"))


@query("a10_graph_statistics", "with e as (select l_orderkey as src, l_partkey as dst, l_returnflag as relation from lineitem) select (select count(*) from (select src as id from e union select dst from e)) as nodes, count(*) as edges, count(distinct relation) as relations from e")
def graph_statistics(spark, sf_dir):
    e = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"), F.col("l_returnflag").alias("relation"))
    nodes = e.select(F.explode(F.array("src", "dst")).alias("id")).distinct().agg(_n().alias("nodes"))
    return nodes.crossJoin(e.agg(_n().alias("edges"), F.count_distinct("relation").alias("relations")))  # two single rows


@query("a11_capabilities", f"with {FILES_SQL}, c as (select folder_id, count(*) filter (where mime_type = 'application/pdf') as p, count(*) filter (where mime_type like 'audio/%') as a, count(*) filter (where mime_type like 'image/%') as i, count(*) as n from files group by folder_id) select folder_id, concat_ws(',', case when p > 0 then 'search_pdf' end, case when a > 3 then 'transcribe' end, case when i > 0 then 'ocr' end, case when n > 40 then 'summarise' end) as abilities from c")
def capabilities(spark, sf_dir):
    m = F.col("mime_type")
    c = files(spark, sf_dir).groupBy("folder_id").agg(F.count_if(m == "application/pdf").alias("p"), F.count_if(m.startswith("audio/")).alias("a"), F.count_if(m.startswith("image/")).alias("i"), _n().alias("n"))
    rules = F.array_compact(F.array(F.when(F.col("p") > 0, "search_pdf"), F.when(F.col("a") > 3, "transcribe"), F.when(F.col("i") > 0, "ocr"), F.when(F.col("n") > 40, "summarise")))
    return c.select("folder_id", F.array_join(rules, ",").alias("abilities"))


_QUALITY_SQL = "select doc_id % 20 as folder, avg(quality) as valid, avg(n_chars % 100 / 100) as score, avg(toxic) as conflict from documents join labels using (doc_id) group by 1"


@query("a12_quality_assessment", f"with q as ({_QUALITY_SQL}) select folder, round(valid * 0.4 + score * 0.4 + (1 - least(conflict, 1)) * 0.2, 6)::double as quality, concat_ws(',', case when valid < 0.7 then 'validity' end, case when score < 0.7 then 'scores' end, case when conflict > 0.1 then 'conflicts' end) as advice from q")
def quality_assessment(spark, sf_dir):
    joined = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id")
    q = joined.groupBy((F.col("doc_id") % 20).alias("folder")).agg(F.avg("quality").alias("valid"), F.avg(F.col("n_chars") % 100 / 100).alias("score"), F.avg("toxic").alias("conflict"))
    total = F.col("valid") * 0.4 + F.col("score") * 0.4 + (1 - F.least("conflict", F.lit(1.0))) * 0.2
    advice = F.array_compact(F.array(F.when(F.col("valid") < 0.7, "validity"), F.when(F.col("score") < 0.7, "scores"), F.when(F.col("conflict") > 0.1, "conflicts")))
    return q.select("folder", F.round(total, 6).alias("quality"), F.array_join(advice, ",").alias("advice"))


@query("a13_cache_statistics", "select user_id, count(*) filter (where value > 50) as hits, count(*) filter (where not value > 50) as misses, round(100.0 * count(*) filter (where value > 50) / count(*), 2)::double as hit_rate from events group by user_id")
def cache_statistics(spark, sf_dir):
    hit = F.col("value") > 50
    return read(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(hit).alias("hits"), F.count_if(~hit).alias("misses"), F.round(100.0 * F.count_if(hit) / _n(), 2).alias("hit_rate"))


@query("a14_debug_metrics", f"with {_hits_sql()} select query_id, count(*) as n, round(avg(case when rank % 4 <> 0 then score end), 6) as mean_score, (select array_to_string(list_transform(list_slice(embedding, 1, 5), lambda x: cast(round(cast(x as double) * 1000) as bigint)), ',') from embeddings where vec_id = query_id) as preview from hits group by query_id")
def debug_metrics(spark, sf_dir):
    preview = F.array_join(F.transform(F.slice("embedding", 1, 5), lambda x: F.round(x.cast("double") * 1000).cast("long").cast("string")), ",")
    v = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), preview.alias("preview"))
    return hits(spark, sf_dir).groupBy("query_id").agg(_n().alias("n"), F.round(F.avg(F.when(F.col("rank") % 4 != 0, F.col("score"))), 6).alias("mean_score")).join(v, "query_id")


@query("a15_elements_by_type", "with t as (select page_id, unnest(regexp_extract_all(html, '<(p|h1|li|article|footer)[ >]', 1)) as element from pages) select element, count(*) as n, count(distinct page_id) as pages from t group by element")
def elements_by_type(spark, sf_dir):
    t = read(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit("<(p|h1|li|article|footer)[ >]"), F.lit(1))).alias("element"))
    return t.groupBy("element").agg(_n().alias("n"), F.count_distinct("page_id").alias("pages"))


@query("a16_context_by_file", f"with {_hits_sql()}, f as (select query_id, file_key, min(rank) as first, string_agg(id, ' ' order by rank) as ids from hits group by all) select query_id, string_agg(n || ':' || file_key || ':' || ids, '|' order by n) as context from (select *, row_number() over (partition by query_id order by first) as n from f) group by query_id")
def context_by_file(spark, sf_dir):
    """Hits grouped by file in order of first appearance, numbered from one."""
    ids = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"].cast("string")), " ")
    f = hits(spark, sf_dir).groupBy("query_id", "file_key").agg(F.min("rank").alias("first"), ids.alias("ids"))
    f = f.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("first")))
    shown = F.transform(F.array_sort(F.collect_list(F.struct("n", "file_key", "ids"))), lambda x: F.concat_ws(":", x["n"].cast("string"), x["file_key"].cast("string"), x["ids"]))
    return f.groupBy("query_id").agg(F.array_join(shown, "|").alias("context"))


@query("a17_citation_rollup", f"with {_hits_sql()} select query_id, file_key, array_to_string(list_sort(list_distinct(list(id % 30))), ',') as pages, string_agg(rank, ',' order by rank) as numbers from hits group by all")
def citation_rollup(spark, sf_dir):
    as_text = lambda a: F.array_join(F.transform(a, lambda x: x.cast("string")), ",")
    return hits(spark, sf_dir).groupBy("query_id", "file_key").agg(as_text(F.array_sort(F.collect_set(F.col("id") % 30))).alias("pages"), as_text(F.array_sort(F.collect_list("rank"))).alias("numbers"))


@query("a20_classifier_accuracy", "with p as (select case when length(text) > 1500 then 1 else 0 end as guess, quality from documents join labels using (doc_id)) select count(*) as total, cast(sum(case when guess = quality then 1 else 0 end) as bigint) as correct, avg(case when guess = quality then 1 else 0 end) >= 0.8 as passed from p")
def classifier_accuracy(spark, sf_dir):
    joined = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id")
    right = (F.when(F.length("text") > 1500, 1).otherwise(0) == F.col("quality")).cast("int")
    return joined.select(right.alias("right")).agg(_n().alias("total"), F.sum("right").alias("correct"), (F.avg("right") >= 0.8).alias("passed"))


@query("a21_folder_progress", "with c as (select o_custkey, count(*) as n, max(o_orderstatus) as status from orders group by o_custkey) select o_custkey, round(case status when 'F' then 1 when 'O' then least(0.9, n / greatest(2 * n, 1)) when 'P' then 0.5 else 0 end, 6)::double as progress from c")
def folder_progress(spark, sf_dir):
    c = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(_n().alias("n"), F.max("o_orderstatus").alias("status"))
    s = F.col("status")
    progress = F.when(s == "F", 1.0).when(s == "O", F.least(F.lit(0.9), F.col("n") / F.greatest(2 * F.col("n"), F.lit(1)))).when(s == "P", 0.5).otherwise(0.0)
    return c.select("o_custkey", F.round(progress, 6).alias("progress"))


@query("a22_rollup", "select coalesce(lang, '*') as lang, coalesce(source, '*') as source, count(*) as n, cast(sum(n_chars) as bigint) as chars from documents group by rollup (lang, source)")
def rollup(spark, sf_dir):
    return read(spark, sf_dir, "documents").rollup("lang", "source").agg(_n().alias("n"), F.sum("n_chars").alias("chars")).select(F.coalesce("lang", F.lit("*")).alias("lang"), F.coalesce("source", F.lit("*")).alias("source"), "n", "chars")


_CTX = "partition by doc_id order by chunk_index"


@query("w01_context_window", f"with {CHUNKS_SQL} select chunk_id, coalesce(right(lag(content) over ({_CTX}), 150), '') as before, coalesce(left(lead(content) over ({_CTX}), 150), '') as after from chunks")
def context_window(spark, sf_dir):
    w = Window.partitionBy("doc_id").orderBy("chunk_index")
    return chunks(spark, sf_dir).select("chunk_id", F.coalesce(F.right(F.lag("content").over(w), F.lit(150)), F.lit("")).alias("before"), F.coalesce(F.left(F.lead("content").over(w), F.lit(150)), F.lit("")).alias("after"))


@query("w02_section_window", f"with {CHUNKS_SQL}, s as (select chunk_id, doc_id, chunk_index, '[Section: ' || (chunk_index // 3) || '] ' || content as content, chunk_index // 3 as section from chunks) select chunk_id, coalesce(right(lag(content) over (partition by doc_id, section order by chunk_index), 30), '') as before, coalesce(left(lead(content) over (partition by doc_id, section order by chunk_index), 30), '') as after from s")
def section_window(spark, sf_dir):
    c = chunks(spark, sf_dir).withColumn("section", F.floor(F.col("chunk_index") / 3))
    c = c.withColumn("content", F.concat(F.lit("[Section: "), F.col("section").cast("string"), F.lit("] "), F.col("content")))
    w = Window.partitionBy("doc_id", "section").orderBy("chunk_index")
    return c.select("chunk_id", F.coalesce(F.right(F.lag("content").over(w), F.lit(30)), F.lit("")).alias("before"), F.coalesce(F.left(F.lead("content").over(w), F.lit(30)), F.lit("")).alias("after"))


@query("w03_chunk_numbers", f"with {CHUNKS_SQL} select chunk_id, row_number() over ({_CTX}) - 1 as idx, count(*) over (partition by doc_id) as total, row_number() over (partition by doc_id, chunk_index // 3 order by chunk_index) - 1 as idx_in_section, count(*) over (partition by doc_id, chunk_index // 3) as section_total from chunks")
def chunk_numbers(spark, sf_dir):
    c = chunks(spark, sf_dir).withColumn("section", F.floor(F.col("chunk_index") / 3))
    doc, part = Window.partitionBy("doc_id"), Window.partitionBy("doc_id", "section")
    return c.select("chunk_id", (F.row_number().over(doc.orderBy("chunk_index")) - 1).alias("idx"), _n().over(doc).alias("total"), (F.row_number().over(part.orderBy("chunk_index")) - 1).alias("idx_in_section"), _n().over(part).alias("section_total"))


@query("w11_window_memory", "select conv_id, turn, role from (select *, row_number() over (partition by conv_id order by turn desc) as r from conversations) where r <= 4")
def window_memory(spark, sf_dir):
    """The last two exchanges of every conversation."""
    w = Window.partitionBy("conv_id").orderBy(F.col("turn").desc())
    return read(spark, sf_dir, "conversations").withColumn("r", F.row_number().over(w)).where("r <= 4").select("conv_id", "turn", "role")


@query("w12_trimmed_history", "select conv_id, string_agg(role || ':' || turn, ' ' order by turn) as history from (select *, row_number() over (partition by conv_id order by turn desc) as r from conversations) where r <= 3 group by conv_id")
def trimmed_history(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy(F.col("turn").desc())
    kept = read(spark, sf_dir, "conversations").withColumn("r", F.row_number().over(w)).where("r <= 3")
    return kept.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: F.concat(x["role"], F.lit(":"), x["turn"].cast("string"))), " ").alias("history"))


@query("w13_token_budget", "select conv_id, turn from (select conv_id, turn, sum(length(text) // 4) over (partition by conv_id order by turn desc rows unbounded preceding) as used from conversations) where used <= 200")
def token_budget(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy(F.col("turn").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return read(spark, sf_dir, "conversations").withColumn("used", F.sum(R.token_estimate(F.col("text"))).over(w)).where("used <= 200").select("conv_id", "turn")


@query("w14_chunk_sampling", f"with {CHUNKS_SQL}, p as (select chunk_id, doc_id, content, chunk_index as i, count(*) over (partition by doc_id) as n from chunks), s as (select *, row_number() over (partition by doc_id, left(content, 100) order by i) as r from p where n <= 5 or (n <= 10 and i in (0, 1, n // 2, n // 2 + 1, n - 1)) or (n > 10 and i in (0, 1, n // 4, n // 2, 3 * n // 4, n - 1))) select chunk_id from s where r = 1")
def chunk_sampling(spark, sf_dir):
    n, i = F.col("n"), F.col("chunk_index")
    part = lambda a, b: F.floor(n * a / b)
    p = chunks(spark, sf_dir).withColumn("n", _n().over(Window.partitionBy("doc_id")))
    few = (i == 0) | (i == 1) | (i == n - 1)
    chosen = (n <= 5) | ((n <= 10) & (few | (i == part(1, 2)) | (i == part(1, 2) + 1))) | ((n > 10) & (few | (i == part(1, 4)) | (i == part(1, 2)) | (i == part(3, 4))))
    s = p.where(chosen).withColumn("r", F.row_number().over(Window.partitionBy("doc_id", F.left("content", F.lit(100))).orderBy("chunk_index")))
    return s.where("r = 1").select("chunk_id")


@query("w16_rate_window", "select event_id, count(*) over (partition by user_id order by ts range between interval 1 hour preceding and current row) as last_hour, count(*) over (partition by user_id order by ts range between interval 100 hours preceding and current row) > 3 as limited from events")
def rate_window(spark, sf_dir):
    return read(spark, sf_dir, "events").selectExpr(
        "event_id",
        "count(*) over (partition by user_id order by ts range between interval 1 hour preceding and current row) as last_hour",
        "count(*) over (partition by user_id order by ts range between interval 100 hours preceding and current row) > 3 as limited",
    )


@query("k25_conversation_list", "select conv_id, max(turn) as last_turn, count(*) as messages from conversations group by conv_id order by last_turn desc, conv_id")
def conversation_list(spark, sf_dir):
    return read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max("turn").alias("last_turn"), _n().alias("messages")).orderBy(F.col("last_turn").desc(), "conv_id")


@query("k26_message_list", "select conv_id, turn, role from (select *, row_number() over (partition by conv_id order by turn) as r from conversations) where r <= 3")
def message_list(spark, sf_dir):
    return read(spark, sf_dir, "conversations").withColumn("r", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))).where("r <= 3").select("conv_id", "turn", "role")


@query("k27_user_folders", "select o_custkey, o_orderkey from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey) as r from orders where o_orderstatus <> 'P') where r <= 5")
def user_folders(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy(F.col("o_orderdate").desc(), "o_orderkey")
    return read(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").withColumn("r", F.row_number().over(w)).where("r <= 5").select("o_custkey", "o_orderkey")


@query("k29_context_cut", "with c as (select doc_id, text, left(text, 400) as t from documents), p as (select *, length(t) - strpos(reverse(t), '.') + 1 as dot from c) select doc_id, case when length(text) <= 400 then text when strpos(t, '.') > 0 and dot > 320 then left(t, dot) else t || '...' end as cut from p")
def context_cut(spark, sf_dir):
    """Text cut to a budget, back to the last period if that keeps most of it."""
    t = F.left("text", F.lit(400))
    dot = F.length(t) - F.locate(".", F.reverse(t)) + 1
    cut = F.when(F.length("text") <= 400, F.col("text")).when(F.contains(t, F.lit(".")) & (dot > 320), F.left(t, dot)).otherwise(F.concat(t, F.lit("...")))
    return read(spark, sf_dir, "documents").select("doc_id", cut.alias("cut"))


@query("e13_top_chunks", f"with {CHUNKS_SQL} select doc_id, chunk_id, n from (select doc_id, chunk_id, length(content) as n, row_number() over (partition by doc_id order by length(content) desc, chunk_index) as r from chunks) where r <= 2")
def top_chunks(spark, sf_dir):
    w = Window.partitionBy("doc_id").orderBy(F.col("n").desc(), "chunk_index")
    return chunks(spark, sf_dir).withColumn("n", F.length("content")).withColumn("r", F.row_number().over(w)).where("r <= 2").select("doc_id", "chunk_id", "n")


@query("x06_progress_counter", "select event_id, round(row_number() over (partition by user_id order by ts, event_id) / count(*) over (partition by user_id), 6)::double as progress from events")
def progress_counter(spark, sf_dir):
    done = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) / _n().over(Window.partitionBy("user_id"))
    return read(spark, sf_dir, "events").select("event_id", F.round(done, 6).alias("progress"))


@query("x12_idle_sessions", "with g as (select user_id, ts, case when ts <= lag(ts) over w + interval 1 hour then 0 else 1 end as fresh from events window w as (partition by user_id order by ts)), s as (select *, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as n from g) select user_id, min(ts) as started, count(*) as events from s group by user_id, n")
def idle_sessions(spark, sf_dir):
    """Sessions that an hour without events ends."""
    e = read(spark, sf_dir, "events")
    return e.groupBy("user_id", F.session_window("ts", "1 hour").alias("s")).agg(_n().alias("events")).select("user_id", F.col("s.start").cast("timestamp_ntz").alias("started"), "events")


@query("x13_state_reducers", "select conv_id, string_agg(role, ',' order by turn) as appended, array_to_string(list_sort(list_distinct(list(role))), ',') as united, max_by(text, turn) as replaced from conversations group by conv_id")
def state_reducers(spark, sf_dir):
    """Lists append, sets unite, scalars are replaced by the last."""
    c = read(spark, sf_dir, "conversations")
    appended = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]), ",")
    return c.groupBy("conv_id").agg(appended.alias("appended"), F.array_join(F.array_sort(F.collect_set("role")), ",").alias("united"), F.max_by("text", "turn").alias("replaced"))


@query("x14_tumbling_windows", "select event_type, time_bucket(interval 1 day, ts, timestamp '1970-01-01') as day, count(*) as n, round(sum(value), 4) as total from events group by all")
def tumbling_windows(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return e.groupBy("event_type", F.window("ts", "1 day").alias("w")).agg(_n().alias("n"), F.round(F.sum("value"), 4).alias("total")).select("event_type", F.col("w.start").cast("timestamp_ntz").alias("day"), "n", "total")


@query(
    "x14_sliding_windows",
    """with e as (select event_type, ts, value, unnest([0, 6, 12, 18]) as back from events), w as (select event_type, value, time_bucket(interval 6 hours, ts, timestamp '1970-01-01') - to_hours(back) as start from e)
select event_type, start as window_start, count(*) as n, round(sum(value), 4) as total from w group by all""",
)
def sliding_windows(spark, sf_dir):
    """A day wide, every six hours; the watermark takes effect on a stream."""
    e = read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    w = windowed(e, ["event_type"], "ts", [_n().alias("n"), F.round(F.sum("value"), 4).alias("total")], "1 day", "6 hours", "1 hour")
    return w.select("event_type", F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n", "total")


@query(
    "x14_sessions",
    """with l as (select user_id, ts, lag(ts) over (partition by user_id order by ts) as before from events), s as (select *, sum(case when before is null or ts >= before + interval 2 hours then 1 else 0 end) over (partition by user_id order by ts rows unbounded preceding) as s from l)
select user_id, min(ts) as session_start, count(*) as n from s group by user_id, s""",
)
def user_sessions(spark, sf_dir):
    """Runs of a user's events less than two hours apart."""
    e = read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return sessions(e, ["user_id"], "ts", "2 hours").select("user_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"), "n")
