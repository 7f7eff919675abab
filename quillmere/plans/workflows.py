"""Queries of whole workflows, of caches, events and retries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import routing as R
from ..operators import ranking as K
from ..operators.graph import shared_folder
from ..operators.keyword_index import index_of
from ..operators.workflow import Edge, Step, Workflow
from ..registry import ORACLES, QUERIES, query
from ..sources.tables import read
from ..streaming import caches, retry, sink
from . import graph as _graph  # noqa: F401  its queries are composed here
from . import relations as _relations  # noqa: F401
from .retrieval import _ASKED_SQL, _BM25_SQL, _KEYWORD_SQL, _hits_sql, hits, keyword_hits, questions_of_vectors
from .routing import _case_sql


def _folder(spark, name):
    return f"{shared_folder(spark)}/quillmere/{name}-{uuid.uuid4().hex}"


_INTENT_SQL = _case_sql("lower(question)", R.INTENTS, "factual")


@query(
    "e06_query_workflow",
    f"""with {_hits_sql(5)}, {_KEYWORD_SQL}, {_ASKED_SQL}, q as (select query_id, question, {_INTENT_SQL} as intent from asked where query_id % 350 <> 0),
u as (select query_id, id, 0 as l, rank from hits where query_id in (select query_id from q) union all select query_id, id, 1, rank from kw where query_id in (select query_id from q where intent = 'comparison')),
fu as (select query_id, id, round(sum(1.0::double / (60 + rank - 1)), 9) as score, min(l * 1000 + rank) as first from u group by all),
r as (select *, row_number() over (partition by query_id order by score desc, first) as place from fu)
select q.query_id, intent, 'answered' as status, string_agg(id, ',' order by place) filter (where place <= 5) as sources from q join r on q.query_id = r.query_id group by all
union all select query_id, null, 'parse: empty question', null from asked where query_id % 350 = 0""",
)
def query_workflow(spark, sf_dir):
    """Parse, find the intent, retrieve by the legs it asks for, put the context together, answer; empty questions go to the error step."""
    q = questions_of_vectors(spark, sf_dir).select("query_id", F.when(F.col("query_id") % 350 != 0, F.col("question")).otherwise(" ").alias("question"))
    of = lambda found, asked: found.join(asked.select("query_id"), "query_id", "left_semi")
    fused = lambda vector, keyword: K.reciprocal_rank_fusion([vector, keyword]).where("rank <= 5")
    flow = Workflow(
        Step("parse", lambda asked: asked.withColumn("error", F.when(F.trim("question") == "", "empty question")), {"asked": "questions"}),
        Step("intent", lambda parsed: parsed.withColumn("intent", R.first_rule(F.lower("question"), R.INTENTS, "factual")), {"parsed": "parse"}),
        Step("vector", lambda asked: of(hits(spark, sf_dir, 5), asked), {"asked": "intent"}),
        Step("keyword", lambda asked: of(keyword_hits(spark, sf_dir), asked), {"asked": Edge("intent", F.col("intent") == "comparison")}),
        Step("context", fused, {"vector": "vector", "keyword": "keyword"}),
        Step("answer", _answered, {"asked": "intent", "context": "context"}),
        Step("failed", lambda errors: errors.select(F.get_json_object("row", "$.query_id").cast("long").alias("query_id"), F.lit(None).cast("string").alias("intent"), F.concat_ws(": ", "step", "error").alias("status"), F.lit(None).cast("string").alias("sources")), {"errors": Workflow.ERRORS}),
    )
    out = flow.run(spark, {"questions": q}, _folder(spark, "e06"))
    return out["answer"].unionByName(out["failed"])


def _answered(asked, context):
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"].cast("string")), ",")
    found = context.groupBy("query_id").agg(listed.alias("sources"))  # five rows
    return asked.join(found, "query_id").select("query_id", "intent", F.lit("answered").alias("status"), "sources")


#: The detectors of relations, and the queries that they are.
_DETECTORS = {"entity_overlap": "j04_entity_overlap", "temporal": "j06_adjacent_in_time", "cross_reference": "j11_reference_phrase", "implementation_gap": "j13_missing_names"}


def _counted_sql(names: dict[str, str]) -> str:
    return " union all ".join(f"select '{kind}' as kind, count(*) as n, round(coalesce(sum(confidence), 0), 4)::double as confidence from ({ORACLES[name]})" for kind, name in names.items())


@query("e07_relationship_workflow", f"{_counted_sql(_DETECTORS)} union all select 'skipped', count(*), 0.0::double from documents where text is null or trim(text) = ''")
def relationship_workflow(spark, sf_dir):
    """Classify, run the detectors side by side, consolidate; documents without text go to the error step.

    The detectors read their tables themselves, so what they all wait for, and is written, are ids without texts.
    """
    classify = Step("classify", lambda docs: docs.select("doc_id", F.when(F.trim(F.coalesce("text", F.lit(""))) == "", "no text").alias("error")), {"docs": "documents"})
    detect = [Step(kind, lambda docs, name=name: QUERIES[name](spark, sf_dir).select(F.col("confidence").cast("double")), {"docs": "classify"}) for kind, name in _DETECTORS.items()]

    def consolidate(**found):
        every = None
        for kind, rows in found.items():
            part = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("confidence").alias("total"), F.min("confidence").alias("low"), F.max("confidence").alias("high"))
            # Billions of equal terms would add up to something else.
            total = F.when(F.col("low") == F.col("high"), F.col("n") * F.col("low")).otherwise(F.coalesce("total", F.lit(0.0)))
            part = part.select(F.lit(kind).alias("kind"), "n", F.round(total, 4).alias("confidence"))
            every = part if every is None else every.unionByName(part)
        return every

    skipped = Step("skipped", lambda errors: errors.agg(F.count(F.lit(1)).alias("n")).select(F.lit("skipped").alias("kind"), "n", F.lit(0.0).alias("confidence")), {"errors": Workflow.ERRORS})
    flow = Workflow(classify, *detect, Step("consolidate", consolidate, {s.name: s.name for s in detect}), skipped)
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = flow.run(spark, {"documents": docs}, _folder(spark, "e07"))
    return out["consolidate"].unionByName(out["skipped"])


@query(
    "e10_synthesis",
    f"""with {_BM25_SQL}, h as (select query_id, id, rank from bm25 where rank <= 3),
e as (select distinct query_id, unnest(regexp_extract_all(text, '[A-Z][a-z]{{7,}}')) as entity from h join documents on id = doc_id),
n as (select query_id, count(*) as entities, min(entity) as first_entity from e group by query_id)
select h.query_id, count(*) as sources, coalesce(any_value(entities), 0) as entities, any_value(first_entity) as first_entity, string_agg('[' || rank || '] doc_' || id, ' ' order by rank) as citations
from h left join n on h.query_id = n.query_id group by h.query_id""",
)
def synthesis(spark, sf_dir):
    """Retrieve, extract the entities of what was found, put both together, cite."""
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    passages = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    names = lambda found, docs: K.with_texts(found, docs).select("query_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Z][a-z]{7,}"), F.lit(0)))).alias("entity")).distinct()
    cited = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: F.concat(F.lit("["), x["rank"].cast("string"), F.lit("] doc_"), x["id"].cast("string"))), " ")
    flow = Workflow(
        Step("retrieve", lambda asked: index_of(docs).top_k(asked, 3), {"asked": "questions"}),
        Step("entities", names, {"found": "retrieve", "docs": "documents"}),
        Step("synthesize", lambda entities: entities.groupBy("query_id").agg(F.count(F.lit(1)).alias("entities"), F.min("entity").alias("first_entity")), {"entities": "entities"}),
        Step("cite", lambda found: found.groupBy("query_id").agg(F.count(F.lit(1)).alias("sources"), cited.alias("citations")), {"found": "retrieve"}),
        Step("answer", lambda cited, said: cited.join(said, "query_id", "left").select("query_id", "sources", F.coalesce("entities", F.lit(0)).alias("entities"), "first_entity", "citations"), {"cited": "cite", "said": "synthesize"}),
    )
    return flow.run(spark, {"questions": passages, "documents": docs}, _folder(spark, "e10"))["answer"]


# --- caches, events, retries ----------------------------------------------------------

_REQUESTS = "e as (select event_id, user_id % 16 as scope, event_type || ':' || floor(value / 10)::bigint as k, floor(epoch(ts) / 60) as tm from events), o as (select *, row_number() over (partition by {own} order by tm, event_id) as rn from e)"


def _cache_sql(own: str, ttl: float, inclusive: bool, name: str) -> str:
    """Hits of a cache that never fills: per key, the time it was last filled, request by request."""
    alive = f"o.tm - {name}.filled {'<=' if inclusive else '<'} {ttl}"
    same = " and ".join(f"o.{c} = {name}.{c}" for c in own.split(", "))
    return f"{name} as (select event_id, scope, k, rn, tm as filled, false as hit from o where rn = 1 union all select o.event_id, o.scope, o.k, o.rn, case when {alive} then {name}.filled else o.tm end, {alive} from {name} join o on {same} and o.rn = {name}.rn + 1)"


def _requests(spark, sf_dir):
    at = F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 60).cast("double")
    k = F.concat("event_type", F.lit(":"), F.floor(F.col("value") / 10).cast("string"))
    return read(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 16).alias("scope"), k.alias("k"), at.alias("at"))


@query("x09_retrieval_cache", f"with recursive {_REQUESTS.format(own='scope, k')}, {_cache_sql('scope, k', 600, True, 'c')} select event_id, hit from c")
def retrieval_cache(spark, sf_dir):
    """Searches of a folder answered from its cache of a thousand results, ten minutes each."""
    asked = _requests(spark, sf_dir).withColumn("key", caches.retrieval_key(F.col("k"), F.col("scope")))
    return caches.replayed(asked, caches.RETRIEVAL, "scope", "key", "at", "event_id").select("event_id", "hit")


@query(
    "x10_chain_caches",
    f"with recursive {_REQUESTS.format(own='k')}, {_cache_sql('k', 3600, False, 'c')}, {_cache_sql('k', 1800, False, 'd')} select event_id, c.hit as answer_hit, d.hit as retrieval_hit from c join d using (event_id)",
)
def chain_caches(spark, sf_dir):
    """A chain's caches for answers and for results, which only age: every key is a cache of its own."""
    asked = _requests(spark, sf_dir).withColumn("key", F.md5(F.col("k").cast("binary")))
    answers = caches.replayed(asked, caches.CHAIN, "key", "k", "at", "event_id").withColumnRenamed("hit", "answer_hit")
    return caches.replayed(answers, caches.CHAIN_RETRIEVAL, "key", "k", "at", "event_id").select("event_id", "answer_hit", F.col("hit").alias("retrieval_hit"))


#: A full cache in SQL: a scope's requests one by one, its entries as a list, the least recently used first.
_PROMPTS_SQL = f"""with recursive {_REQUESTS.format(own="scope")},
c as (select event_id, scope, rn, false as hit, [{{'k': k, 'filled': tm}}] as held from o where rn = 1 union all
  select event_id, scope, rn, hit, list_append(case when not hit and len(others) >= 100 then others[2:] else others end, {{'k': k, 'filled': case when hit then own[1].filled else tm end}})
  from (select *, len(own) > 0 and tm - own[1].filled <= 3600 as hit from (select o.event_id, o.scope, o.rn, o.k, o.tm, list_filter(held, lambda x: x.k is not distinct from o.k) as own, list_filter(held, lambda x: x.k is distinct from o.k) as others
    from c join o on o.scope = c.scope and o.rn = c.rn + 1)))
select event_id, hit from c"""


@query("x11_prompt_cache", _PROMPTS_SQL)
def prompt_cache(spark, sf_dir):
    """Prompts by kind and folder, a hundred in each folder's cache, an hour each."""
    asked = _requests(spark, sf_dir).withColumn("key", caches.prompt_key(F.col("k"), F.col("scope")))
    return caches.replayed(asked, caches.PROMPTS, "scope", "key", "at", "event_id").select("event_id", "hit")


@query(
    "x03_answer_events",
    r"""with t as (select conv_id * 100000 + turn as stream_id, list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '') as w, turn % 3 = 1 as cited, turn % 7 = 3 as failed from conversations where role = 'assistant')
select stream_id, 1::bigint as n_status, case when cited then 1 else 0 end::bigint as n_citations, case when failed then len(w) - 1 else len(w) end::bigint as n_tokens, case when failed then 0 else 1 end::bigint as n_done, case when failed then 1 else 0 end::bigint as n_error,
  md5(array_to_string(case when failed then w[1:len(w) - 1] else w end, ' ')) as said from t where len(w) > 0""",
)
def answer_events(spark, sf_dir):
    """Answers as events, a word a token: a status, citations, tokens, the end; some answers break off."""
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    t = read(spark, sf_dir, "conversations").where("role = 'assistant'").select((F.col("conv_id") * 100000 + F.col("turn")).alias("stream_id"), "turn", F.posexplode(words).alias("seq", "token"), F.size(words).alias("n"))
    last = F.col("seq") == F.col("n") - 1
    tokens = t.select("stream_id", F.col("seq").cast("long").alias("seq"), "token", F.when(F.col("turn") % 3 == 1, F.array(F.lit("a.pdf"))).otherwise(F.array().cast("array<string>")).alias("citations"), last.alias("last"), (last & (F.col("turn") % 7 == 3)).alias("failed"))
    events = sink.answer_events(tokens)
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == "token", F.struct("seq", "payload")))), lambda e: e["payload"]), " ")
    counts = [F.count_if(F.col("kind") == k).alias(f"n_{k if k != 'token' else 'tokens'}") for k in sink.KINDS]
    return events.groupBy("stream_id").agg(*counts, F.md5(said.cast("binary")).alias("said"))


@query("x07_retries", "select doc_id, least(doc_id % 6 + 1, 4)::int as attempts, (power(2, least(doc_id % 6, 3)) - 1)::double as waited, doc_id % 6 > 3 as dead from documents")
def retries(spark, sf_dir):
    """Files whose first attempts fail, tried again; those that fail four times are left over."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    step = lambda rows: rows.withColumn("size", F.length("text")).withColumn("error", F.when(F.col("attempt") < F.col("doc_id") % 6, "not yet")).drop("size")
    done, dead = retry.attempted(docs, step)
    pick = ["doc_id", "attempts", "waited"]
    return done.select(*pick, F.lit(False).alias("dead")).unionByName(dead.select(*pick, F.lit(True).alias("dead")))
