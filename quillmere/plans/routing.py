"""Queries of the routing and classification rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import routing as R
from ..functions.replies import repaired_json
from ..operators.names import names_within
from ..registry import ORACLES, query
from ..sources.tables import FILES_SQL, QUESTIONS_SQL, dressed, dressed_sql, files, questions, read, values_sql

_q = "lower(question)"


def _any_sql(text: str, words) -> str:
    return "(" + " or ".join("contains({}, '{}')".format(text, w.replace("'", "''")) for w in words) + ")"


def _case_sql(text: str, rules, default, pick: int = 1) -> str:
    show = lambda v: f"'{v}'" if isinstance(v, str) else f"{v}::double"
    return "case " + " ".join(f"when {_any_sql(text, r[0])} then {show(r[pick])}" for r in rules) + f" else {show(default)} end"


def _in_sql(value: str, table) -> str:
    return "case " + " ".join(f"when {value} in ({', '.join(repr(m) for m in ms)}) then '{k}'" for k, ms in table.items()) + " end"


_SUFFIX = r"lower(regexp_extract(file_name, '[^/](\.[^./]+)$', 1))"
_CATEGORY = (
    f"coalesce({_in_sql('lower(trim(mime_type))', R.MIME_TYPES)}, case when mime_type like 'audio/%' then 'audio' "
    f"when mime_type like 'text/%' then case when regexp_matches(mime_type, 'x-python|javascript|typescript|x-java|x-c|x-go|x-rust|x-ruby|x-php|x-sh|x-sql') then 'code' else 'unstructured_native' end "
    f"when mime_type like 'image/%' then 'unstructured_native' end, {_in_sql(_SUFFIX, R.EXTENSIONS)}, 'unsupported')"
)


@query("p01_file_category", f"with {FILES_SQL} select file_id, {_CATEGORY} as category from files")
def file_category(spark, sf_dir):
    return files(spark, sf_dir).select("file_id", R.file_category(F.col("file_name"), F.col("mime_type")).alias("category"))


@query("p02_supported_files", f"with {FILES_SQL} select folder_id, count(*) as n_files, count(*) filter (where {_CATEGORY} <> 'unsupported') as n_supported from files group by folder_id")
def supported_files(spark, sf_dir):
    known = R.file_category(F.col("file_name"), F.col("mime_type")) != R.UNSUPPORTED
    return files(spark, sf_dir).groupBy("folder_id").agg(F.count(F.lit(1)).alias("n_files"), F.count_if(known).alias("n_supported"))


_DICTIONARY = [(e, c) for c, es in R.EXTENSIONS.items() for e in es]


@query("p03_extension_dictionary", f"with {FILES_SQL} select coalesce(category, 'unsupported') as category, count(*) as n from files left join {values_sql(_DICTIONARY, 'd(ext, category)')} on {_SUFFIX} = d.ext group by 1")
def extension_dictionary(spark, sf_dir):
    known = F.broadcast(spark.createDataFrame(_DICTIONARY, "ext string, category string"))  # a fixed table of about 100 rows
    f = files(spark, sf_dir).withColumn("ext", R.suffix(F.col("file_name")))
    return f.join(known, "ext", "left").groupBy(F.coalesce("category", F.lit(R.UNSUPPORTED)).alias("category")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "p04_chunker_file_type",
    f"""with {FILES_SQL}, n as (select file_id, lower(file_name) as n, lower(mime_type) as m from files)
select file_id, case when contains(m, 'pdf') then 'pdf' when contains(m, 'audio') then 'audio' when contains(m, 'video') then 'video'
  when contains(m, 'text') or contains(m, 'markdown') then case when regexp_matches(n, '\\.(md|markdown)$') then 'markdown' else 'text' end
  when n like '%.pdf' then 'pdf' when regexp_matches(n, '\\.(md|markdown)$') then 'markdown'
  when regexp_matches(n, '\\.(py|js|ts|java|cpp|go|rs|rb)$') then 'code' when regexp_matches(n, '\\.(m4a|mp3|wav|flac|ogg)$') then 'audio'
  when regexp_matches(n, '\\.(mp4|mov|avi)$') then 'video' else 'unknown' end as file_type from n""",
)
def chunker_file_type(spark, sf_dir):
    return files(spark, sf_dir).select("file_id", R.chunk_file_type(F.col("file_name"), F.col("mime_type")).alias("file_type"))


_ELEMENT = f"""case when {_SUFFIX} in ('.jpg','.jpeg','.png','.gif','.bmp','.tiff','.tif','.webp') then 'image' when {_SUFFIX} in ('.html','.htm') then 'html'
  when {_SUFFIX} in ('.doc','.docx','.xls','.xlsx','.ppt','.pptx','.odt','.ods','.odp') then 'document' when {_SUFFIX} = '.pdf' then 'pdf' when {_SUFFIX} in ('.txt','.csv') then 'text'
  when {_SUFFIX} in ('.md','.markdown') then 'markdown' when mime_type like 'image/%' then 'image' when mime_type like 'text/html%' then 'html'
  when mime_type like 'application/vnd.openxmlformats-officedocument%' or mime_type like 'application/msword%' or mime_type like 'application/vnd.oasis.opendocument%' then 'document'
  when mime_type = 'application/pdf' then 'pdf' when mime_type like 'text/%' then 'text' else 'unknown' end"""


@query("p05_element_file_type", f"with {FILES_SQL} select file_id, {_ELEMENT} as file_type from files")
def element_file_type(spark, sf_dir):
    return files(spark, sf_dir).select("file_id", R.element_file_type(F.col("file_name"), F.col("mime_type")).alias("file_type"))


_ELEMENTS = ["Title", "NarrativeText", "Table", "ListItem", "Heading", "PageSummary"]


@query(
    "p06_element_chunk_type",
    f"""with {FILES_SQL}, e as (select file_id, {_ELEMENT} as ft, lower(u.e) as e, u.e as element from files, (select unnest({_ELEMENTS!r}) as e) u)
select file_id, element, case when ft = 'image' then 'image_ocr_text' when contains(e, 'title') or contains(e, 'heading') then 'document_title' when contains(e, 'table') then 'document_table'
  when contains(e, 'list') then 'document_list_item' when contains(e, 'summary') then 'document_summary' else 'document_section' end as chunk_type from e""",
)
def element_chunk_type(spark, sf_dir):
    f = files(spark, sf_dir).select("file_id", R.element_file_type(F.col("file_name"), F.col("mime_type")).alias("ft"), F.explode(F.array(*[F.lit(e) for e in _ELEMENTS])).alias("element"))
    return f.select("file_id", "element", R.element_chunk_type(F.col("element"), F.col("ft")).alias("chunk_type"))


@query(
    "p07_inventory_category",
    f"""with {FILES_SQL}, n as (select folder_id, lower(file_name) as n, lower(mime_type) as m from files),
c as (select folder_id, case when n like '%.csv' then 'CSV' when regexp_matches(n, '\\.(tsv|tab)$') then 'TSV' when regexp_matches(n, '\\.(md|markdown)$') then 'Markdown' when n like '%.pdf' then 'PDF'
  when regexp_matches(n, '\\.(py|js|ts|java|cpp|c|go|rs|rb|php|cs|swift|kt)$') then 'Code' when regexp_matches(n, '\\.(html|htm)$') then 'HTML' when regexp_matches(n, '\\.(json|xml|yaml|yml)$') then 'Data'
  when contains(m, 'csv') then 'CSV' when m = 'text/tab-separated-values' or contains(m, 'tsv') then 'TSV' when contains(m, 'markdown') then 'Markdown' when contains(m, 'pdf') then 'PDF'
  when contains(m, 'audio') then 'Audio' when contains(m, 'image') then 'Image' when contains(m, 'video') then 'Video' when contains(m, 'html') then 'HTML' when contains(m, 'json') then 'Data'
  when m like 'text/%' then 'Text' when contains(m, 'python') or contains(m, 'javascript') then 'Code' when contains(m, 'document') or contains(m, 'msword') then 'Document'
  when contains(m, 'spreadsheet') or contains(m, 'excel') then 'Spreadsheet' when contains(m, 'presentation') or contains(m, 'powerpoint') then 'Presentation' else 'Other' end as category from n)
select folder_id, category, count(*) as n from c group by all""",
)
def inventory_category(spark, sf_dir):
    return files(spark, sf_dir).groupBy("folder_id", R.inventory_category(F.col("file_name"), F.col("mime_type")).alias("category")).agg(F.count(F.lit(1)).alias("n"))


@query("p08_document_kind", f"with {FILES_SQL} select file_id, case when mime_type = 'application/pdf' then 'pdf' when mime_type like 'audio/%' then 'audio' when mime_type in ('text/x-python', 'text/javascript') then 'code' else 'text' end as kind from files")
def document_kind(spark, sf_dir):
    return files(spark, sf_dir).select("file_id", R.document_kind(F.col("mime_type")).alias("kind"))


_WORDS = [(i, t, k, w) for i, (t, ws) in enumerate(R.CONTENT_KEYWORDS.items()) for k, w in ws.items()]


_KEYWORD_TYPE_SQL = f"""with {QUESTIONS_SQL}, s as (select qid, t, i, max(w) as w from questions join {values_sql(_WORDS, 'k(i, t, k, w)')} on contains({_q}, k.k) group by all),
r as (select *, row_number() over (partition by qid order by w desc, i) as rn from s)
select q.qid, coalesce(r.t, 'any') as content_type, coalesce(r.w, 0)::double as confidence from questions q left join r on q.qid = r.qid and rn = 1"""


def keyword_type(spark, sf_dir):
    """(qid, content_type, confidence): the type of the weightiest keyword, the earlier type on a tie."""
    scores = R.content_scores(F.lower("question"))
    best = F.array_max(F.array(*[F.struct(s.alias("w"), F.lit(-i).alias("i"), F.lit(t).alias("t")) for i, (t, s) in enumerate(scores.items())]))
    return questions(spark, sf_dir).select("qid", best.alias("b")).select("qid", F.when(F.col("b.w") > 0, F.col("b.t")).otherwise("any").alias("content_type"), F.col("b.w").alias("confidence"))


_FAMILIES = [(i, f, e) for i, (f, es) in enumerate(R.FAMILY_EXTENSIONS.items()) for e in es]
_FAMILY_SQL = f"fam(i, family, ext) as (select * from {values_sql(_FAMILIES, 'v(i, family, ext)')})"
_NAMED_SQL = "nm as (select file_id, doc_id, file_name, lower(file_name) as n, regexp_replace(lower(file_name), '\\.[^.]*$', '') as b from files)"


def families(spark, sf_dir):
    """(family, n_files, first_doc, first_file) of the extension families that have files: nine rows at most."""
    low = F.lower("file_name")
    of = F.coalesce(*[F.when(F.array_contains(F.array(*[F.lit(e) for e in es]), R.suffix(low)), f) for f, es in R.FAMILY_EXTENSIONS.items()])
    known = files(spark, sf_dir).select(of.alias("family"), "doc_id", "file_name").where("family is not null")
    return known.groupBy("family").agg(F.count(F.lit(1)).alias("n_files"), F.min("doc_id").alias("first_doc"), F.min_by("file_name", "doc_id").alias("first_file"))


def named_files(spark, sf_dir, asked):
    """(id, doc_id, file_id, file_name) of files whose name, with or without extension, stands in a text of ``asked`` (id, text), case aside."""
    low = F.lower("file_name")
    names = files(spark, sf_dir).select("doc_id", "file_id", "file_name", F.explode(F.array_distinct(F.array(low, F.regexp_replace(low, r"\.[^.]*$", "")))).alias("name"))
    found = names_within(asked.select("id", F.lower("text").alias("text")), names)
    return found.join(names, "name").select("id", "doc_id", "file_id", "file_name").distinct()


@query(
    "p10_explicit_file",
    f"""with {QUESTIONS_SQL}, {FILES_SQL}, {_NAMED_SQL}, {_FAMILY_SQL},
has as (select i, family, count(*) as n, arg_min(file_name, doc_id) as first from fam join nm on right(n, length(ext)) = ext group by i, family),
byfam as (select qid, n, first, row_number() over (partition by qid order by i) as r from questions join has on contains({_q}, family || ' file') or contains({_q}, 'the ' || family) or contains({_q}, 'this ' || family)),
byname as (select qid, arg_min(file_name, doc_id) as first from questions join nm on contains({_q}, nm.n) or contains({_q}, nm.b) group by qid)
select q.qid, case when f.qid is not null then 'family' else 'name' end as named_by, coalesce(f.n, 1) as n_files, coalesce(f.first, m.first) as first_file, case when f.n > 1 then 0.9::double else 1.0::double end as confidence
from questions q left join byfam f on q.qid = f.qid and f.r = 1 left join byname m on q.qid = m.qid where f.qid is not null or m.qid is not null""",
)
def explicit_file(spark, sf_dir):
    """A question's files: those of the first extension family it speaks of ("the csv", "pdf files") that has any, else the first file whose name it holds."""
    low = F.lower("question")
    asks = lambda f: R.has_any(low, [f"{f} file", f"the {f}", f"this {f}"])
    spoken = F.array_compact(F.array(*[F.when(asks(f), F.struct(F.lit(i).alias("i"), F.lit(f).alias("family"))) for i, f in enumerate(R.FAMILY_EXTENSIONS)]))
    q = questions(spark, sf_dir)
    meant = q.select("qid", F.explode(spoken).alias("s")).select("qid", "s.*").join(F.broadcast(families(spark, sf_dir)), "family")  # nine rows
    by_family = meant.groupBy("qid").agg(F.min_by(F.struct("n_files", "first_file"), "i").alias("f"))
    by_family = by_family.select("qid", F.lit("family").alias("named_by"), "f.n_files", "f.first_file", F.when(F.col("f.n_files") > 1, 0.9).otherwise(1.0).alias("confidence"))
    rest = q.join(by_family.select("qid"), "qid", "left_anti").select(F.col("qid").alias("id"), F.col("question").alias("text"))
    by_name = named_files(spark, sf_dir, rest).groupBy(F.col("id").alias("qid")).agg(F.min_by("file_name", "doc_id").alias("first_file"))
    return by_family.unionByName(by_name.select("qid", F.lit("name").alias("named_by"), F.lit(1).cast("long").alias("n_files"), "first_file", F.lit(1.0).alias("confidence")))


_EXT_ORDER = [(i, t, e[1:]) for i, (t, es) in enumerate(R.CONTENT_EXTENSIONS.items()) for e in es]


@query(
    "p11_extension_token",
    f"""with {QUESTIONS_SQL}, x as (select qid, e, p from (select qid, unnest(l) as e, generate_subscripts(l, 1) as p from (select qid, regexp_extract_all({_q}, '\\.([a-z0-9]{{2,5}})\\b', 1) as l from questions))),
h as (select qid, x.e, t, row_number() over (partition by qid order by p, i) as rn from x join {values_sql(_EXT_ORDER, 'k(i, t, e)')} on x.e = k.e)
select qid, '.' || e as extension, t as content_type from h where rn = 1""",
)
def extension_token(spark, sf_dir):
    order = F.broadcast(spark.createDataFrame(_EXT_ORDER, "i int, t string, e string"))  # a fixed table of 44 rows
    asked = questions(spark, sf_dir).select("qid", F.posexplode(F.regexp_extract_all(F.lower("question"), F.lit(r"\.([a-z0-9]{2,5})\b"), F.lit(1))).alias("p", "e"))
    return asked.join(order, "e").groupBy("qid").agg(F.min_by(F.struct("e", "t"), F.struct("p", "i")).alias("b")).select("qid", F.concat(F.lit("."), F.col("b.e")).alias("extension"), F.col("b.t").alias("content_type"))


@query(
    "p12_multi_type",
    f"""with {QUESTIONS_SQL}, s as (select qid, t, max(w) as w from questions join {values_sql(_WORDS, 'k(i, t, k, w)')} on contains({_q}, k.k)
  where regexp_matches({_q}, '\\b(and|versus|vs|compare|between)\\b') group by all having max(w) >= 0.8)
select qid, string_agg(t, ',' order by t) as types, 0.9::double as confidence from s group by qid having count(*) >= 2""",
)
def multi_type(spark, sf_dir):
    low = F.lower("question")
    strong = F.array_compact(F.array(*[F.when(s >= 0.8, F.lit(t)) for t, s in R.content_scores(low).items()]))
    return questions(spark, sf_dir).where(low.rlike(r"\b(and|versus|vs|compare|between)\b")).select("qid", strong.alias("l")).where(F.size("l") >= 2).select("qid", F.array_join(F.array_sort("l"), ",").alias("types"), F.lit(0.9).alias("confidence"))


@query(
    "p13_exclusion",
    f"""with {QUESTIONS_SQL}, {FILES_SQL}, x as (select qid, unnest(regexp_extract_all({_q}, '(?:except|excluding|exclude|not\\s+in)\\s+(\\w+(?:\\.\\w+)?)', 1)) as r from questions),
h as (select distinct qid, file_name from x join files on lower(file_name) = r or regexp_replace(lower(file_name), '\\.[^.]*$', '') = r)
select qid, string_agg(file_name, ',' order by file_name) as excluded, case when count(*) = 1 then 'ne' else 'nin' end as op, 0.95::double as confidence from h group by qid""",
)
def exclusion(spark, sf_dir):
    asked = questions(spark, sf_dir).select("qid", F.explode(F.regexp_extract_all(F.lower("question"), F.lit(r"(?:except|excluding|exclude|not\s+in)\s+(\w+(?:\.\w+)?)"), F.lit(1))).alias("name"))
    low = F.lower("file_name")
    named = files(spark, sf_dir).select("file_name", F.explode(F.array_distinct(F.array(low, F.regexp_replace(low, r"\.[^.]*$", "")))).alias("name"))
    hit = named.join(asked, "name").select("qid", "file_name").distinct()
    return hit.groupBy("qid").agg(F.array_join(F.array_sort(F.collect_list("file_name")), ",").alias("excluded"), F.when(F.count(F.lit(1)) == 1, "ne").otherwise("nin").alias("op"), F.lit(0.95).alias("confidence"))


@query(
    "p09_content_type",
    f"""with x1 as ({ORACLES['p13_exclusion']}), x2 as ({ORACLES['p10_explicit_file']}), x3 as ({ORACLES['p11_extension_token']}), x4 as ({ORACLES['p12_multi_type']}), x5 as ({_KEYWORD_TYPE_SQL})
select x5.qid, case when excluded is not null then 'exclude' when first_file is not null then 'file_id' when extension is not null then 'file_type' when types is not null then 'multi_type' when x5.confidence > 0 then 'file_type' else 'none' end as filter_type,
  case when excluded is not null then excluded when first_file is not null then first_file when extension is not null then x3.content_type when types is not null then types when x5.confidence > 0 then x5.content_type end as filter_value,
  case when excluded is not null then x1.confidence when first_file is not null then x2.confidence when extension is not null then 1.0 when types is not null then x4.confidence else x5.confidence end::double as confidence
from x5 left join x1 on x5.qid = x1.qid left join x2 on x5.qid = x2.qid left join x3 on x5.qid = x3.qid left join x4 on x5.qid = x4.qid""",
)
def content_type(spark, sf_dir):
    """The detector's cascade: exclusion, named file, extension, several types, weightiest keyword, nothing."""
    found = keyword_type(spark, sf_dir).select("qid", F.struct("content_type", "confidence").alias("x5"))
    steps = [("x1", exclusion), ("x2", explicit_file), ("x3", extension_token), ("x4", multi_type)]
    for name, step in steps:
        rows = step(spark, sf_dir)
        found = found.join(rows.select(F.col("qid").alias(f"{name}_qid"), F.struct(*[c for c in rows.columns if c != "qid"]).alias(name)), F.col("qid") == F.col(f"{name}_qid"), "left")

    def first(*values, otherwise):
        out = None
        for name, value in zip(("x1", "x2", "x3", "x4"), values, strict=True):
            known = F.col(name).isNotNull()
            out = F.when(known, value) if out is None else out.when(known, value)
        return out.otherwise(otherwise)

    keyword = F.col("x5.confidence") > 0
    return found.select(
        "qid",
        first(F.lit("exclude"), F.lit("file_id"), F.lit("file_type"), F.lit("multi_type"), otherwise=F.when(keyword, "file_type").otherwise("none")).alias("filter_type"),
        first(F.col("x1.excluded"), F.col("x2.first_file"), F.col("x3.content_type"), F.col("x4.types"), otherwise=F.when(keyword, F.col("x5.content_type"))).alias("filter_value"),
        first(F.col("x1.confidence"), F.col("x2.confidence"), F.lit(1.0), F.col("x4.confidence"), otherwise=F.col("x5.confidence")).alias("confidence"),
    )


_REFERENCES = [(e,) for e in R.REFERENCE_EXTENSIONS]


@query(
    "p18_file_references",
    f"""with {QUESTIONS_SQL}, {FILES_SQL}, {_NAMED_SQL}, x(ext) as (select * from {values_sql(_REFERENCES, 'v(ext)')}),
has as (select ext, count(*) as n, min(file_id) as first from x join nm on right(n, length(ext)) = ext group by ext),
bykind as (select qid, cast(sum(n) as bigint) as n, min(first) as first from questions join has on contains({_q}, substr(ext, 2) || ' file') group by qid),
w as (select qid, {_q} as q, list_distinct(list_filter(regexp_extract_all({_q}, '[\\p{{L}}\\p{{N}}_]+'), lambda w: length(w) >= 2)) as ws from questions),
f as (select *, regexp_extract_all(b, '[\\p{{L}}\\p{{N}}_]+') as ws from nm),
byname as (select qid, count(*) as n, min(file_id) as first from w join f on contains(w.q, f.n) or contains(w.q, f.b) or list_has_any(w.ws, f.ws) group by qid)
select q.qid, coalesce(k.n, m.n) as n_files, coalesce(k.first, m.first) as first_file from questions q left join bykind k on q.qid = k.qid left join byname m on q.qid = m.qid where k.qid is not null or m.qid is not null""",
)
def file_references(spark, sf_dir):
    """Files that a question means: all of the kinds it speaks of ("csv files"), else those whose name it holds or shares a word with."""
    low = F.lower("question")
    q = questions(spark, sf_dir)
    spoken = F.array_compact(F.array(*[F.when(F.contains(low, F.lit(f"{e[1:]} file")), F.lit(e)) for e in R.REFERENCE_EXTENSIONS]))
    kinds = files(spark, sf_dir).select(R.suffix(F.lower("file_name")).alias("ext"), "file_id").where(F.col("ext").isin(R.REFERENCE_EXTENSIONS)).groupBy("ext").agg(F.count(F.lit(1)).alias("n"), F.min("file_id").alias("first"))
    by_kind = q.select("qid", F.explode(spoken).alias("ext")).join(F.broadcast(kinds), "ext").groupBy("qid").agg(F.sum("n").alias("n_files"), F.min("first").alias("first_file"))  # nine rows
    rest = q.join(by_kind.select("qid"), "qid", "left_anti")
    word = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit(r"(?U)\w+"), F.lit(0)))
    asked = rest.select("qid", F.explode(F.filter(word(low), lambda w: F.length(w) >= 2)).alias("w"))
    named = files(spark, sf_dir).select("file_id", F.explode(word(F.regexp_replace(F.lower("file_name"), r"\.[^.]*$", ""))).alias("w"))
    by_word = named.join(asked, "w").select("qid", "file_id")
    held = named_files(spark, sf_dir, rest.select(F.col("qid").alias("id"), F.col("question").alias("text"))).select(F.col("id").alias("qid"), "file_id")
    by_name = by_word.unionByName(held).distinct().groupBy("qid").agg(F.count(F.lit(1)).alias("n_files"), F.min("file_id").alias("first_file"))
    return by_kind.unionByName(by_name)


_SPECIFIC = [r for r in R.QUESTION_CLASSES if r[1] != "factual_general"]
_NAMES_SQL = f"named as (select distinct qid from ({ORACLES['p18_file_references']}))"


def _class_sql(pick, default, specific):
    return f"case when {_any_sql(_q, sum((r[0] for r in _SPECIFIC), []))} then {_case_sql(_q, _SPECIFIC, default, pick)} when q.qid in (select qid from named) then {specific} else {_case_sql(_q, R.QUESTION_CLASSES, default, pick)} end"


@query("p14_question_class", f"with {QUESTIONS_SQL}, {FILES_SQL}, {_NAMES_SQL} select q.qid, {_class_sql(1, 'factual_general', repr('factual_specific'))} as query_type, {_class_sql(2, 0.5, '0.8::double')} as confidence from questions q")
def question_class(spark, sf_dir):
    """The ordered keyword rules; a question that names a file is a specific one."""
    low = F.lower("question")
    named = file_references(spark, sf_dir).select(F.col("qid").alias("named_qid"))
    specific = R.has_any(low, sum((r[0] for r in _SPECIFIC), []))
    of = lambda pick, default, value: F.when(~specific & F.col("named_qid").isNotNull(), F.lit(value)).otherwise(R.first_rule(low, R.QUESTION_CLASSES, default, pick))
    return questions(spark, sf_dir).join(named, F.col("qid") == F.col("named_qid"), "left").select("qid", of(1, "factual_general", "factual_specific").alias("query_type"), of(2, 0.5, 0.8).alias("confidence"))


_REPLIES = [
    'Sure:\n```json\n{"query_type": "comparison", "confidence": 0.75}\n```\nDone.',
    'Answer {"query_type": "temporal", "confidence": 1.5} ok',
    "no json at all",
    '{"query_type": "relationship", "confidence": -1}',
    'Cut off: {"query_type": "comparison", "confidence": 0.5, "reasons": ["a", "b',
    'Nested: {"query_type": "factual_specific", "extra": {"deep": [1, {"x": "}"}]}, "confidence": 0.25',
]
#: What the six replies hold, worked out by hand.
_MEANT = [("comparison", 0.75), ("temporal", 1.0), (None, None), ("relationship", 0.0), ("comparison", 0.5), ("factual_specific", 0.25)]


@query(
    "p16_json_from_reply",
    f"select rid, m.query_type, m.confidence::double as confidence from {dressed_sql('rid', _REPLIES)} d join {values_sql([(i, *m) for i, m in enumerate(_MEANT)], 'm(i, query_type, confidence)')} on d.variant = m.i",
)
def json_from_reply(spark, sf_dir):
    """The JSON object of a model's reply, cut and nested ones repaired; the confidence is clamped."""
    parsed = F.from_json(repaired_json("t"), "query_type string, confidence double")
    return dressed(spark, sf_dir, "rid", _REPLIES).select("rid", parsed["query_type"].alias("query_type"), F.when(parsed["confidence"].isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), parsed["confidence"]))).alias("confidence"))


@query(
    "p17_question_entities",
    f"""with {QUESTIONS_SQL}, l as (select qid, list_concat(list_concat(regexp_extract_all(question, '"([^"]+)"', 1), regexp_extract_all(question, '''([^'']+)''', 1)), regexp_extract_all(regexp_replace(question, '[^\\x00-\\x7F]', '0', 'g'), '\\b([A-Z][a-z]+(?:\\s+[A-Z][a-z]+)*)\\b', 1)) as l from questions)
select qid, array_to_string(list_sort(list_distinct(list_filter(l, lambda e: length(e) > 2 and e not in ('The','This','That','What','Which','Where','When','How','Why')))), '|') as entities from l""",
)
def question_entities(spark, sf_dir):
    return questions(spark, sf_dir).select("qid", F.array_join(R.question_entities(F.col("question")), "|").alias("entities"))


@query("p19_strategy", f"with {QUESTIONS_SQL} select qid, {_case_sql(_q, R.STRATEGIES, 'conceptual')} as strategy from questions")
def strategy(spark, sf_dir):
    return questions(spark, sf_dir).select("qid", R.first_rule(F.lower("question"), R.STRATEGIES, "conceptual").alias("strategy"))


@query("p20_prompt_type", f"with {QUESTIONS_SQL} select qid, {_case_sql(_q, R.PROMPT_TYPES, 'default')} as prompt_type from questions")
def prompt_type(spark, sf_dir):
    return questions(spark, sf_dir).select("qid", R.first_rule(F.lower("question"), R.PROMPT_TYPES, "default").alias("prompt_type"))


@query("p21_intent", f"with {QUESTIONS_SQL} select qid, {_case_sql(_q, R.INTENTS, 'factual')} as intent from questions")
def intent(spark, sf_dir):
    return questions(spark, sf_dir).select("qid", R.first_rule(F.lower("question"), R.INTENTS, "factual").alias("intent"))


_COMPLEX_SQL = "case when w < 5 and c < 50 then 'simple' when w < 15 and c < 150 then 'moderate' when w < 30 and c < 300 then 'complex' else 'very_complex' end"


@query("p22_complexity", f"with {QUESTIONS_SQL}, n as (select qid, len(list_filter(regexp_split_to_array(question, '\\s+'), lambda x: x <> '')) as w, length(question) as c from questions) select qid, {_COMPLEX_SQL} as complexity from n")
def question_complexity(spark, sf_dir):
    return questions(spark, sf_dir).select("qid", R.complexity(F.col("question")).alias("complexity"))


_CHAINS = {"simple": "fast", "moderate": "standard", "complex": "deep", "very_complex": "exhaustive"}
_AVAILABLE = ["standard", "deep"]


@query(
    "p23_chain",
    f"""with {QUESTIONS_SQL}, n as (select qid, len(list_filter(regexp_split_to_array(question, '\\s+'), lambda x: x <> '')) as w, length(question) as c from questions), x as (select qid, {_COMPLEX_SQL} as k from n)
select qid, case when k = 'moderate' then 'standard' when k = 'complex' then 'deep' else 'standard' end as chain from x""",
)
def chain(spark, sf_dir):
    """The chain for a question's complexity, else the first one available."""
    wanted = F.element_at(F.create_map(*[F.lit(x) for kv in _CHAINS.items() for x in kv]), R.complexity(F.col("question")))
    return questions(spark, sf_dir).select("qid", F.coalesce(F.when(wanted.isin(_AVAILABLE), wanted), F.lit(_AVAILABLE[0])).alias("chain"))


@query("p24_strategies", f"with {QUESTIONS_SQL}, i as (select qid, {_case_sql(_q, R.INTENTS, 'factual')} as i from questions) select qid, case i when 'comparison' then 'vector,keyword' when 'relational' then 'vector,graph' else 'vector' end as strategies from i")
def strategies(spark, sf_dir):
    i = R.first_rule(F.lower("question"), R.INTENTS, "factual")
    return questions(spark, sf_dir).select("qid", F.array_join(F.array_compact(F.array(F.lit("vector"), F.when(i == "comparison", "keyword"), F.when(i == "relational", "graph"))), ",").alias("strategies"))


@query(
    "p25_keywords",
    f"""with t as (select item_id as id, lower(text) as t from benchmark)
select id, array_to_string(list_filter(regexp_extract_all(t, '[\\p{{L}}\\p{{N}}\\p{{Mn}}_]+'), lambda w: length(w) > 2 and w not in ({', '.join(repr(w) for w in R.STOP_WORDS)})), ' ') as keywords from t""",
)
def question_keywords(spark, sf_dir):
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.array_join(R.keywords(F.col("text")), " ").alias("keywords"))


@query("p26_similarity", "select event_id, round(case when value > 10 then 1 / (1 + value) else greatest(0, least(1, 1 - value)) end, 6)::double as similarity from events")
def distance_similarity(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", F.round(R.similarity(F.col("value")), 6).alias("similarity"))


@query("p27_tokens", "select doc_id, cast(floor(length(text) / 4) as bigint) as tokens from documents")
def tokens(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", R.token_estimate(F.col("text")).alias("tokens"))


@query(
    "p28_clock",
    """with s as (select event_id, cast(floor(value * 37) as bigint) as s from events)
select event_id, case when s >= 3600 then lpad(cast(s // 3600 as varchar), 2, '0') || ':' else '' end || lpad(cast(s % 3600 // 60 as varchar), 2, '0') || ':' || lpad(cast(s % 60 as varchar), 2, '0') as shown from s""",
)
def clock(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", R.clock(F.col("value") * 37).alias("shown"))


@query(
    "p29_citation_label",
    f"""with {FILES_SQL} select file_id, 'Source: ' || file_name || case when mime_type = 'application/pdf' then ', Page ' || (size % 40 + 1)
  when mime_type = 'audio/mpeg' then ', ' || lpad(cast(size % 3600 // 60 as varchar), 2, '0') || ':' || lpad(cast(size % 60 as varchar), 2, '0') || '-' || lpad(cast((size % 3600) // 60 as varchar), 2, '0') || ':59'
  when mime_type like 'text/%' then ', Lines ' || (size % 90) || '-' || (size % 90 + 9) else '' end as label from files""",
)
def citation_label(spark, sf_dir):
    size, mime = F.col("size"), F.col("mime_type")
    start = F.when(mime == "audio/mpeg", size % 3600)
    first = F.when(mime.startswith("text/"), size % 90)
    return files(spark, sf_dir).select("file_id", R.citation_label(F.col("file_name"), F.when(mime == "application/pdf", size % 40 + 1), start, start - start % 60 + 59, first, first + 9).alias("label"))


_NAMES = ["/tmp/../etc/pass:wd?.txt", "plain.md", "a<b>|c*\"d\".csv", "x" * 300 + ".pdf", "back\\slash..name"]


@query(
    "p30_safe_name",
    f"""with n as (select nid, regexp_replace(replace(replace(regexp_replace(name, '^.*/', ''), chr(92), '_'), '..', '_'), '[<>:"|?*]', '_', 'g') as c from (select page_id as nid, url || list_extract([{', '.join("'" + n + "'" for n in _NAMES)}], cast(page_id % 5 + 1 as int)) as name from pages)),
e as (select nid, c, regexp_extract(c, '[^.](\\.[^.]*)$', 1) as x from n)
select nid, case when length(c) > 255 then left(left(c, length(c) - length(x)), 250) || x else c end as safe from e""",
)
def safe_name(spark, sf_dir):
    name = F.concat("url", F.element_at(F.array(*[F.lit(n) for n in _NAMES]), (F.col("page_id") % 5 + 1).cast("int")))
    return read(spark, sf_dir, "pages").select(F.col("page_id").alias("nid"), R.safe_file_name(name).alias("safe"))


@query("p31_content_hash", "select doc_id, sha256(text) as hash from documents")
def content_hash(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("hash"))


@query("p32_cache_key", "select item_id, 'ret:' || sha256(lower(trim(text))) as cache_key from benchmark")
def cache_key(spark, sf_dir):
    return read(spark, sf_dir, "benchmark").select("item_id", F.concat(F.lit("ret:"), F.sha2(F.lower(F.trim("text")), 256)).alias("cache_key"))


@query(
    "p33_masking",
    """select c_custkey, case when length(c_name) > 4 then left(c_name, 4) || repeat('*', length(c_name) - 4) else repeat('*', length(c_name)) end as masked, sha256(cast(c_custkey as varchar)) as id_hash,
  regexp_matches(c_name || '@example.com', '^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{2,}$') as mail_ok from customer""",
)
def masking(spark, sf_dir):
    name = F.col("c_name")
    return read(spark, sf_dir, "customer").select("c_custkey", R.masked(name).alias("masked"), F.sha2(F.col("c_custkey").cast("string"), 256).alias("id_hash"), F.concat(name, F.lit("@example.com")).rlike(r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$").alias("mail_ok"))


@query("p34_eastern_time", "select event_id, strftime(timezone('America/New_York', timezone('UTC', ts)), '%Y-%m-%d %H:%M:%S') as eastern from events")
def eastern_time(spark, sf_dir):
    shown = F.convert_timezone(F.lit("UTC"), F.lit("America/New_York"), F.col("ts"))
    return read(spark, sf_dir, "events").select("event_id", F.date_format(shown, "yyyy-MM-dd HH:mm:ss").alias("eastern"))


@query("p35_answer_confidence", "select conv_id, turn, case when turn = 0 or length(text) < 10 then 0 else least(turn / 5, 1) end::double as confidence from conversations where role = 'assistant'")
def answer_confidence(spark, sf_dir):
    return read(spark, sf_dir, "conversations").where("role = 'assistant'").select("conv_id", "turn", R.answer_confidence(F.col("text"), F.col("turn")).alias("confidence"))


@query(
    "p36_reliability",
    f"""with {FILES_SQL} select file_id, round(least(0.5 + case when size % 100 > 80 then 0.2 when size % 100 > 60 then 0.1 else 0 end + 0.1 + case when size % 3 = 0 then 0.1 else 0 end
  + case when mime_type = 'application/pdf' then 0.05 else 0 end, 1), 6)::double as reliability from files""",
)
def reliability(spark, sf_dir):
    size = F.col("size")
    return files(spark, sf_dir).select("file_id", F.round(R.source_reliability((size % 100) / 100, F.col("file_name"), F.when(size % 3 == 0, size), F.col("mime_type")), 6).alias("reliability"))


@query(
    "p37_entity_confidence",
    "select p_partkey, round(least(0.7 + case when length(p_name) > 3 then 0.1 else 0 end + case when length(p_name) > 10 then 0.1 else 0 end + case when p_size % 2 = 0 then 0.1 else 0 end, 1), 6)::double as confidence from part",
)
def entity_confidence(spark, sf_dir):
    kind = F.when(F.col("p_size") % 2 == 0, "FUNCTION").otherwise("PERSON")
    return read(spark, sf_dir, "part").select("p_partkey", F.round(R.entity_confidence(F.col("p_name"), kind), 6).alias("confidence"))
