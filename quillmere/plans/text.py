"""Queries of text functions, chunking and generators."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..functions import chunking as C
from ..functions import text as T
from ..registry import query
from ..sources.html import read_elements
from ..sources.tables import CHUNKS_SQL, FILES_SQL, chunks, dressed, dressed_sql, files, read


def _docs(spark, sf_dir):
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")


def _as_text(array, sep="|"):
    return F.array_join(array, sep)


@query("s10_html_elements")
def html_elements(spark, sf_dir):
    return read_elements(read(spark, sf_dir, "pages"))


@query("c01_recursive_chunks")
def recursive_chunks(spark, sf_dir):
    return C.chunk_rows(_docs(spark, sf_dir), C.split_recursive)


#: Headings that stand-in sections get.
_SECTIONED = ["intro\n# One\nalpha beta. gamma\n## Two\ndelta", "no headers at all", "# Only\nwords\n# Only again"]


@query("c02_section_chunks")
def section_chunks(spark, sf_dir):
    def run(frames):
        for f in frames:
            rows = [(i, *s) for i, t in zip(f["id"], f["text"], strict=True) for s in C.split_sections(t, [("Start", 0, len(t) // 2), ("Rest", len(t) // 2, len(t))])]
            yield pd.DataFrame(rows, columns=["id", "title", "idx", "total", "content"])

    return _docs(spark, sf_dir).mapInPandas(run, "id long, title string, idx int, total int, content string")


@query("c03_header_chunks")
def header_chunks(spark, sf_dir):
    def run(frames):
        for f in frames:
            rows = [(i, *s) for i, t in zip(f["id"], f["text"], strict=True) for s in C.split_sections(t, C.header_sections(t), 200, 20)]
            yield pd.DataFrame(rows, columns=["id", "title", "idx", "total", "content"])

    return dressed(spark, sf_dir, "id", _SECTIONED).withColumnRenamed("t", "text").mapInPandas(run, "id long, title string, idx int, total int, content string")


@query("c04_boundary_chunks")
def boundary_chunks(spark, sf_dir):
    return C.chunk_rows(_docs(spark, sf_dir), lambda t: C.split_recursive(t, 600, 100, ["\n", ". ", " ", ""]))


@query("c05_context_prefix", f"with {CHUNKS_SQL}, {FILES_SQL} select chunk_id, '[Document: ' || file_name || ']' || chr(10) || content as content from chunks join files using (doc_id)")
def context_prefix(spark, sf_dir):
    named = files(spark, sf_dir).select("doc_id", "file_name")
    return chunks(spark, sf_dir).join(named, "doc_id").select("chunk_id", F.concat(F.lit("[Document: "), F.col("file_name"), F.lit("]\n"), F.col("content")).alias("content"))


@query("c06_code_chunks")
def code_chunks(spark, sf_dir):
    code = _docs(spark, sf_dir).select("id", F.concat(F.lit("def a(x):\n"), F.replace("text", F.lit(". "), F.lit("\ndef f():\n\treturn "))).alias("text"))
    return C.chunk_rows(code, lambda t: C.split_recursive(t, 300, 30, C.CODE_SEPARATORS["python"]))


@query("c07_chunk_ids", f"with {CHUNKS_SQL} select chunk_id, md5(doc_id || ':' || chunk_index || ':' || left(content, 100)) as key from chunks")
def chunk_ids(spark, sf_dir):
    return chunks(spark, sf_dir).select("chunk_id", C.chunk_id(F.col("doc_id").cast("string"), F.col("chunk_index"), F.col("content")).alias("key"))


@query("c08_long_windows")
def long_windows(spark, sf_dir):
    return C.chunk_rows(_docs(spark, sf_dir), lambda t: C.split_long(t, 4000, 200))


@query("c09_fixed_slices", "select doc_id, len(s) as parts, array_to_string(list_transform(s, lambda x: length(x)), ',') as sizes from (select doc_id, list_transform(range(0, cast(greatest(1, ceil(length(text) / 4500.0)) as bigint)), lambda i: substr(text, i * 4500 + 1, 4500)) as s from documents)")
def fixed_slices(spark, sf_dir):
    s = C.fixed_slices(F.col("text"), 4500)
    return read(spark, sf_dir, "documents").select("doc_id", s.alias("s")).select("doc_id", F.size("s").cast("long").alias("parts"), _as_text(F.transform("s", lambda x: F.length(x).cast("string")), ",").alias("sizes"))


@query("c10_box_groups")
def box_groups(spark, sf_dir):
    """OCR boxes of a page, grouped in reading order; a page's boxes fit one task."""

    def one(group: pd.DataFrame) -> pd.DataFrame:
        g = group.sort_values("position")
        boxes = [(float(20 * (p % 7)), float(90 * (p // 4)), float(len(t) % 60)) for p, t in zip(g["position"], g["text"], strict=True)]
        return pd.DataFrame({"page_id": g["page_id"], "position": g["position"], "box_group": C.group_boxes(boxes)})

    return read_elements(read(spark, sf_dir, "pages")).groupBy("page_id").applyInPandas(one, "page_id long, position int, box_group int")


@query("c11_image_summary", "with w as (select doc_id, list_filter(string_split(text, ' '), lambda x: x <> '') as ws from documents) select doc_id, 'Image content from doc_' || doc_id || ': ' || array_to_string(list_slice(ws, 1, 20), ' ') || case when len(ws) > 20 then ' ... and ' || (len(ws) - 20) || ' more' else '' end as summary from w")
def image_summary(spark, sf_dir):
    ws = F.filter(F.split("text", " "), lambda x: x != "")
    more = F.when(F.size("ws") > 20, F.concat(F.lit(" ... and "), (F.size("ws") - 20).cast("string"), F.lit(" more"))).otherwise("")
    return read(spark, sf_dir, "documents").select("doc_id", ws.alias("ws")).select("doc_id", F.concat(F.lit("Image content from doc_"), F.col("doc_id").cast("string"), F.lit(": "), _as_text(F.slice("ws", 1, 20), " "), more).alias("summary"))


@query("c12_transcript_chunks", "select conv_id, cast(-1 as bigint) as segment, string_agg(text, ' ' order by turn) as content from conversations group by conv_id union all select conv_id, turn, case when length(text) <= 100 then 'Audio segment: ' || text else text end from conversations")
def transcript_chunks(spark, sf_dir):
    """A chunk of the whole transcript and one of each segment."""
    c = read(spark, sf_dir, "conversations")
    whole = c.groupBy("conv_id").agg(_as_text(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), " ").alias("content"))
    one = c.select("conv_id", F.col("turn").alias("segment"), F.when(F.length("text") <= 100, F.concat(F.lit("Audio segment: "), F.col("text"))).otherwise(F.col("text")).alias("content"))
    return whole.select("conv_id", F.lit(-1).cast("long").alias("segment"), "content").unionByName(one)


@query("c13_short_content", f"with {FILES_SQL} select file_id, case when length(text) <= 100 then case when mime_type like 'image/%' then 'Image text from ' when mime_type like 'audio/%' then 'Audio from ' else 'Content from ' end || file_name || ': ' || text else text end as content from files join documents using (doc_id)")
def short_content(spark, sf_dir):
    m = F.col("mime_type")
    kind = F.when(m.startswith("image/"), "image").when(m.startswith("audio/"), "audio").otherwise("text")
    return files(spark, sf_dir).join(read(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id").select("file_id", C.enriched(F.col("text"), kind, F.col("file_name")).alias("content"))


@query("c14_sentences", "select doc_id, len(l) as n, md5(array_to_string(l, '|')) as sentences from (select doc_id, list_filter(list_transform(regexp_split_to_array(text, '[.!?]+\\s+'), lambda s: trim(s)), lambda s: s <> '') as l from documents)")
def sentences(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", C.sentences(F.col("text")).alias("l")).select("doc_id", F.size("l").cast("long").alias("n"), F.md5(_as_text("l").cast("binary")).alias("sentences"))


@query("c15_marked_sentences", "select doc_id, len(l) as n, md5(array_to_string(l, '|')) as sentences from (select doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: s <> '') as l from documents)")
def marked_sentences(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", C.sentences_with_marks(F.col("text")).alias("l")).select("doc_id", F.size("l").cast("long").alias("n"), F.md5(_as_text("l").cast("binary")).alias("sentences"))


_CODE = ["import os\nfrom a.b import c\nclass Foo:\n    def bar(self):\n        pass\n", "const x = 1;\nlet yy = 2;\nfunction go() {}\nsee main.py and app.ts", "nothing here"]
_CODE_PATTERNS = [("FUNCTION", r"(?:def|function)\s+(\w+)"), ("CLASS", r"class\s+(\w+)"), ("MODULE", r"(?:import|from)\s+([\w.]+)"), ("VARIABLE", r"(?:const|let|var)\s+(\w+)"), ("FILE", r"\b([\w-]+\.(?:py|js|ts|java|go))\b")]


@query("c16_code_entities", f"with c as (select cid, t as code from {dressed_sql('cid', _CODE)}) " + " union ".join(f"select cid, '{k}' as kind, unnest(regexp_extract_all(code, '{p}', 1)) as entity from c" for k, p in _CODE_PATTERNS))
def code_entities(spark, sf_dir):
    found = F.flatten(F.array(*[F.transform(F.regexp_extract_all("code", F.lit(p), F.lit(1)), _tagged(k)) for k, p in _CODE_PATTERNS]))
    return dressed(spark, sf_dir, "cid", _CODE).withColumnRenamed("t", "code").select("cid", F.explode(F.array_distinct(found)).alias("e")).select("cid", F.col("e.kind").alias("kind"), F.col("e.entity").alias("entity"))


def _tagged(kind):
    return lambda e: F.struct(F.lit(kind).alias("kind"), e.alias("entity"))


_PEOPLE = ["John Smith met Anna Lee of Acme Corp on 12/03/2021 and March 4, 2020.", "Nobody came. Zeta LLC and Zeta LLC again, 1-2-99 report.pdf", ""]
_PERSON, _DATE, _ORG, _FILE = (
    r"\b[A-Z][a-z]+ [A-Z][a-z]+\b",
    r"\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b|\b(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{1,2},?\s+\d{4}\b",
    r"\b[A-Z][a-zA-Z]+ (?:Inc|Corp|LLC|Ltd|Company|Corporation)\b",
    r"\b[\w-]+\.(?:pdf|txt|md|docx|csv)\b",
)


def _pattern_entities(spark, sf_dir, kinds):
    found = F.flatten(F.array(*[F.transform(F.array_distinct(F.regexp_extract_all("t", F.lit(p), F.lit(0))), _weighed(k, c)) for k, p, c in kinds]))
    return dressed(spark, sf_dir, "pid", _PEOPLE).select("pid", F.explode(found).alias("e")).select("pid", "e.*")


def _weighed(kind, confidence):
    return lambda e: F.struct(e.alias("entity"), F.lit(kind).alias("kind"), F.lit(confidence).alias("confidence"))


def _entities_sql(kinds):
    return f"with c as (select * from {dressed_sql('pid', _PEOPLE)}) " + " union ".join(f"select pid, unnest(regexp_extract_all(t, '{p}')) as entity, '{k}' as kind, {c}::double as confidence from c" for k, p, c in kinds)


_C18 = [("PERSON", _PERSON, 0.7), ("DATE", _DATE, 0.8), ("ORGANIZATION", _ORG, 0.75)]
_C19 = [*_C18, ("FILE", _FILE, 0.9)]


@query("c18_pattern_entities", _entities_sql(_C18))
def pattern_entities(spark, sf_dir):
    return _pattern_entities(spark, sf_dir, _C18)


@query("c19_question_pattern_entities", _entities_sql(_C19))
def question_pattern_entities(spark, sf_dir):
    return _pattern_entities(spark, sf_dir, _C19)


@query("c20_keywords", "select doc_id, array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: regexp_matches(w, '^[\\p{L}\\p{N}]{4,}$') and w not in ('that', 'this', 'with', 'from', 'have')))), ' ') as keywords from documents")
def keywords(spark, sf_dir):
    words = F.filter(F.split(F.lower("text"), r"\s+"), lambda w: w.rlike(r"^[\p{L}\p{N}]{4,}$") & ~w.isin("that", "this", "with", "from", "have"))
    return read(spark, sf_dir, "documents").select("doc_id", _as_text(F.array_sort(F.array_distinct(words)), " ").alias("keywords"))


@query("t01_cleaned", "select doc_id, md5(trim(regexp_replace(regexp_replace(text, '\\s+', ' ', 'g'), '[\\x00-\\x1F\\x7F]', '', 'g'))) as cleaned from documents")
def cleaned(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(T.cleaned(F.col("text")).cast("binary")).alias("cleaned"))


_HEADED = ["EXECUTIVE SUMMARY\nbody text goes here.", "1.2 Market Analysis\nmore", "Chapter 3: Results\nx", "Key Findings:\ny", "Market Overview\nz", "## subtitle here\nq", "plain sentence here.\nanother one.", ""]


@query(
    "t02_section_title",
    f"""with h as (select * from {dressed_sql('hid', _HEADED)}), l as (select hid, p, l, len(list_filter(regexp_split_to_array(l, '\\s+'), lambda w: w <> '')) as n,
  len(list_filter(regexp_split_to_array(l, '\\s+'), lambda w: regexp_matches(w, '^\\p{{Lu}}'))) as caps, regexp_extract(l, '(?i)^(?:\\d+\\.?\\d*\\s+|(?:chapter|section|part)\\s+\\d+[:\\-\\s]+|[IVXLCDM]+\\.\\s+)(.+)$', 1) as num
  from (select hid, trim(unnest(x)) as l, generate_subscripts(x, 1) as p from (select hid, list_slice(string_split(trim(t), chr(10)), 1, 10) as x from h)) where length(l) >= 3),
c as (select hid, p, case when upper(l) = l and lower(l) <> l and n <= 6 then array_to_string(list_transform(string_split(lower(l), ' '), lambda w: upper(left(w, 1)) || substr(w, 2)), ' ') when trim(num) <> '' and length(trim(num)) < 100 then trim(num)
  when l like '%:' and n <= 6 then trim(left(l, length(l) - 1)) when n between 2 and 6 and caps >= n * 0.7 and not regexp_matches(l, '[.!?]$') then l when l like '#%' then trim(regexp_replace(l, '^#+\\s*', '')) end as title from l)
select h.hid, min_by(title, p) filter (where title <> '') as title from h left join c on h.hid = c.hid group by h.hid""",
)
def section_title(spark, sf_dir):
    return dressed(spark, sf_dir, "hid", _HEADED).select("hid", T.section_title(F.col("t")).alias("title"))


_TITLED = ["# Real Title\ntext", "Short first line\nmore.", "A sentence that ends.\nmore", "", "x\n# Late One\n"]


@query(
    "t04_text_title",
    f"""with t as (select tid, t, 'my-file_' || variant || '.md' as name from {dressed_sql('tid', _TITLED)}), h as (select tid, t, name, trim(list_filter(list_transform(list_slice(string_split(t, chr(10)), 1, 20), lambda s: regexp_extract(s, '^# (.*)$', 1)), lambda s: s <> '')[1]) as head, trim(string_split(trim(t), chr(10))[1]) as first from t)
select tid, coalesce(head, case when length(first) < 100 and first <> '' and first not like '%.' then first end, translate(regexp_replace(name, '\\.[^.]*$', ''), '_-', '  ')) as title from h""",
)
def text_title(spark, sf_dir):
    return dressed(spark, sf_dir, "tid", _TITLED).select("tid", T.text_title(F.col("t"), F.concat(F.lit("my-file_"), F.col("variant").cast("string"), F.lit(".md"))).alias("title"))


_BYLINES = ["Authors: Ann Lee, Bob Ray and Cy Dee", "by Solo", "Written by Jo Ann Poe; Al Bo & X", ""]


@query("t05_authors", f"with b as (select bid, regexp_replace(trim(l), '(?i)^(?:authors?|by|written by)\\s*:?\\s+', '') as l from (select bid, t as l from {dressed_sql('bid', _BYLINES, ', ')})) select bid, array_to_string(list_slice(list_filter(list_transform(regexp_split_to_array(l, '\\s*(?:,|;|&|\\band\\b)\\s*'), lambda s: trim(s)), lambda s: len(list_filter(regexp_split_to_array(s, '\\s+'), lambda w: w <> '')) >= 2 and length(s) < 50), 1, 10), '|') as authors from b")
def authors(spark, sf_dir):
    return dressed(spark, sf_dir, "bid", _BYLINES, ", ").select("bid", _as_text(T.authors(F.col("t"))).alias("authors"))


@query("t07_metadata", f"with {FILES_SQL} select file_id, file_name || case when mime_type = 'application/pdf' then ', page ' || (size % 40 + 1) when mime_type like 'text/%' then ', lines 1-' || (size % 90 + 1) else '' end as searchable_location, '1.0' as schema_version from files")
def metadata(spark, sf_dir):
    m, size = F.col("mime_type"), F.col("size")
    where = F.when(m == "application/pdf", F.concat(F.lit(", page "), (size % 40 + 1).cast("string"))).when(m.startswith("text/"), F.concat(F.lit(", lines 1-"), (size % 90 + 1).cast("string"))).otherwise("")
    return files(spark, sf_dir).select("file_id", F.concat("file_name", where).alias("searchable_location"), F.lit("1.0").alias("schema_version"))


@query("t08_metadata_merge", "select doc_id, array_to_string(list_sort([ 'a=1', 'lang=' || coalesce(case when doc_id % 3 <> 0 then lang end, 'none'), 'n=' || n_chars]), ',') as merged from documents")
def metadata_merge(spark, sf_dir):
    """The additional map wins; its nulls are skipped."""
    base = F.create_map(F.lit("a"), F.lit("1"), F.lit("lang"), F.lit("none"))
    more = F.map_filter(F.create_map(F.lit("lang"), F.when(F.col("doc_id") % 3 != 0, F.col("lang")), F.lit("n"), F.col("n_chars").cast("string")), lambda k, v: v.isNotNull())
    merged = F.map_concat(F.map_filter(base, lambda k, v: ~F.map_contains_key(more, k)), more)
    return read(spark, sf_dir, "documents").select("doc_id", _as_text(F.array_sort(F.transform(F.map_entries(merged), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",").alias("merged"))


@query("t09_metadata_flat", "select event_id, left(string_agg(k || '=' || v, ',' order by k), 500) as flat from (select event_id, unnest(json_keys(props)) as k, json_extract_string(props, '$.' || unnest(json_keys(props))) as v from events) where k not like '\\_%' escape '\\' group by event_id")
def metadata_flat(spark, sf_dir):
    kept = F.map_filter(F.from_json("props", "map<string,string>"), lambda k, v: ~k.startswith("_"))
    return read(spark, sf_dir, "events").select("event_id", F.left(_as_text(F.array_sort(F.transform(F.map_entries(kept), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ","), F.lit(500)).alias("flat"))


@query("t10_sequence_similarity")
def sequence_similarity(spark, sf_dir):
    b = read(spark, sf_dir, "benchmark")
    return b.select("item_id", F.round(T.similarity(F.col("text"), F.concat(F.lit("x "), F.reverse("text"))), 6).alias("similarity"))


@query("t11_best_quote")
def best_quote(spark, sf_dir):
    quote = F.udf(lambda c, t: T.best_quote(c or "", t or ""), "string", useArrow=True)
    return read(spark, sf_dir, "benchmark").select("item_id", quote(F.substring("text", 20, 60), F.col("text")).alias("quote"))


@query("t12_excerpt", "with e as (select doc_id, text as t, substr(text, 101, 60) as s from documents), p as (select *, strpos(lower(t), left(lower(s), 50)) as pos from e) select doc_id, md5(case when pos = 0 then left(t, 200) else trim(case when pos - 101 > 0 then '...' else '' end || substr(t, greatest(0, pos - 101) + 1, least(length(t), pos - 1 + length(s) + 100) - greatest(0, pos - 101)) || case when pos - 1 + length(s) + 100 < length(t) then '...' else '' end) end) as excerpt from p")
def excerpt(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(T.excerpt(F.substring("text", 101, 60), F.col("text")).cast("binary")).alias("excerpt"))


@query("t13_line_range", "with e as (select doc_id, text as t, strpos(text, substr(text, length(text) // 2 + 1, 20)) as pos from documents) select doc_id, case when pos > 0 then cast(length(left(t, pos - 1)) - length(replace(left(t, pos - 1), chr(10), '')) + 1 as int) end as line from e")
def line_range(spark, sf_dir):
    middle = F.substr("text", F.floor(F.length("text") / 2).cast("int") + 1, F.lit(20))
    return read(spark, sf_dir, "documents").select("doc_id", T.line_of(F.col("text"), middle).alias("line"))


_PARAGRAPHS = ["one\n\ntwo two\n\nthree", "one\n\n\n\nthree", ""]


@query("t14_paragraph", f"select pid, len(list_filter(range(1, len(l) + 1), lambda i: list_sum(list_transform(list_slice(l, 1, i), lambda x: length(x) + 2)) <= pos)) as paragraph from (select pid, string_split(t, chr(10) || chr(10)) as l, pos from (select pid, t, length(t) * (pid % 7) // 7 as pos from {dressed_sql('pid', _PARAGRAPHS, chr(10) + chr(10))}))")
def paragraph(spark, sf_dir):
    return dressed(spark, sf_dir, "pid", _PARAGRAPHS, "\n\n").select("pid", T.paragraph_of(F.col("t"), F.floor(F.length("t") * (F.col("pid") % 7) / 7).cast("int")).cast("long").alias("paragraph"))


_CITED = ["Storage grew [1]. Costs fell [2][3], see [cid:c1].", "None.", "[cid:b] then [cid:a] then [cid:b] [4]"]


@query("t15_citation_marks", f"select cid, array_to_string(regexp_extract_all(t, '\\[(\\d+)\\]', 1), ',') as numbers, trim(regexp_replace(regexp_replace(t, '\\[cid:[^\\]]+\\]', '', 'g'), '\\s*\\[\\d+\\]', '', 'g')) as claim from {dressed_sql('cid', _CITED)}")
def citation_marks(spark, sf_dir):
    t = F.col("t")
    return dressed(spark, sf_dir, "cid", _CITED).select("cid", _as_text(F.transform(T.citation_numbers(t), lambda n: n.cast("string")), ",").alias("numbers"), T.without_citations(t).alias("claim"))


@query("t16_citation_render", f"select cid, array_to_string(list_transform(l, lambda x: x || '=' || list_position(list_distinct_ordered, x)), ',') as numbered from (select cid, l, list_filter(l, lambda x, i: list_position(l, x) = i) as list_distinct_ordered from (select cid, regexp_extract_all(t, '\\[cid:([^\\]]+)\\]', 1) as l from {dressed_sql('cid', _CITED)}))")
def citation_render(spark, sf_dir):
    """Citation ids numbered by first appearance."""
    l = F.regexp_extract_all("t", F.lit(r"\[cid:([^\]]+)\]"), F.lit(1))
    return dressed(spark, sf_dir, "cid", _CITED).select("cid", l.alias("l")).select("cid", _as_text(F.transform("l", lambda x: F.concat(x, F.lit("="), F.array_position(F.array_distinct("l"), x).cast("string"))), ",").alias("numbered"))


@query(
    "t16_citation_links",
    f"""with {FILES_SQL}, r as (select cid, t || ' See [cid:f' || (cid % 1500) || '] and [cid:f' || (cid * 7 % 150) || '].' as t from {dressed_sql('cid', _CITED)}),
p as (select cid, regexp_extract_all(t, '\\[cid:([a-zA-Z0-9_-]+)\\]', 1) as ids, string_split(regexp_replace(t, '\\[cid:([a-zA-Z0-9_-]+)\\]', chr(1), 'g'), chr(1)) as parts from r),
u as (select cid, unnest(parts) as part, unnest(range(1, len(parts) + 1)) as pos, ids from p),
n as (select cid, part, pos, ids[pos] as id, len(list_distinct(list_slice(ids, 1, list_position(ids, ids[pos])))) as number from u)
select cid, string_agg(part || case when id is null then '' when file_id is null then '<sup class="citation-missing">[?]</sup>' else '<sup><a href="https://files.example/' || file_name || '" target="_blank" rel="noopener noreferrer" class="citation-link" title="' || file_name || case when doc_id % 5 > 0 then ', p.' || (doc_id % 5) else '' end || '">[' || number || ']</a></sup>' end, '' order by pos) as html
from n left join files on id = file_id group by cid""",
)
def citation_links(spark, sf_dir):
    """Markers as links numbered by first appearance, over a join with the chunks that they name; unknown ones as [?]."""
    known = files(spark, sf_dir).select(F.col("file_id").alias("id"), F.col("file_name").alias("title"), F.concat(F.lit("https://files.example/"), F.col("file_name")).alias("url"), (F.col("doc_id") % 5).alias("page"))
    more = F.concat(F.col("t"), F.lit(" See [cid:f"), (F.col("cid") % 1500).cast("string"), F.lit("] and [cid:f"), (F.col("cid") * 7 % 150).cast("string"), F.lit("]."))
    return T.with_links(dressed(spark, sf_dir, "cid", _CITED).select("cid", more.alias("t")), "cid", "t", known).withColumnRenamed("t", "html")


@query("t17_citation_list", f"select cid, array_to_string(list_sort(list_distinct(regexp_extract_all(t, '\\[cid:([^\\]]+)\\]', 1))), ',') as ids from {dressed_sql('cid', _CITED)}")
def citation_list(spark, sf_dir):
    return dressed(spark, sf_dir, "cid", _CITED).select("cid", _as_text(F.array_sort(F.array_distinct(F.regexp_extract_all("t", F.lit(r"\[cid:([^\]]+)\]"), F.lit(1)))), ",").alias("ids"))


_REPLIES = ['{"a": 1} Answer: It works. I hope this helps!', "<think>hmm\nno</think>Response: fine", "plain. Let me know if more", ""]


@query(
    "t18_response_clean",
    f"""with r as (select rid, regexp_replace(regexp_replace(t, '(?s)<think(?:ing)?>.*?</think(?:ing)?>', '', 'g'), '(?s)^\\s*\\{{.*?\\}}\\s*', '') as t from {dressed_sql('rid', _REPLIES)})
select rid, trim(regexp_replace(regexp_replace(t, '(?i)^\\s*(?:answer|response|assistant)\\s*:\\s*', ''), '(?i)\\s*(?:let me know if|i hope this helps|feel free to).*$', '')) as cleaned from r""",
)
def response_clean(spark, sf_dir):
    return dressed(spark, sf_dir, "rid", _REPLIES).select("rid", T.response_clean(F.col("t")).alias("cleaned"))


#: Replies with openings, closings and headings that a model adds.
_FRAMED = [
    "I'm happy to help! The river rises.\nIt ends at sea. I hope this helps.",
    "# Answer\nBased on the context, it is so.\nRegarding doc_7: more",
    "# One\ntext\n# Two",
    "Please provide more. Unfortunately, there is no answer. Fine.\nLet me know if you need anything else",
    "Plain words.   Please let me know if you need any additional help.",
]


def _framed_sql():
    out = "regexp_replace(t, '(?i)</?think[^>]*>', '', 'g')"
    quoted = lambda p: p.replace("'", "''")
    for p in T.UNWANTED_PREFIXES:
        out = f"regexp_replace({out}, '(?im){quoted(p)}', '', 'g')"
    meta = "h"
    for p in T.META_PHRASES:
        meta = f"regexp_replace({meta}, '(?i){p}[,:]?\\s*', '', 'g')"
    for p in [T.REGARDING, *T.UNWANTED_CLOSINGS]:
        meta = f"regexp_replace({meta}, '(?im){quoted(p)}', '', 'g')"
    bare = "regexp_replace(o, '^\\s+|\\s+$', '', 'g')"
    return f"""with a as (select rid, {out} as o from {dressed_sql('rid', _FRAMED)}), b as (select rid, o, {bare} as s from a),
c as (select rid, case when starts_with(s, '#') and len(list_filter(string_split(s, chr(10)), lambda x: starts_with(x, '#'))) = 1 then regexp_replace(regexp_replace(s, '^[^\\n]*\\n?', ''), '^\\s+|\\s+$', '', 'g') else o end as h from b),
d as (select rid, regexp_replace({meta}, '[ \\t]+', ' ', 'g') as m from c)
select rid, trim(regexp_replace(regexp_replace(m, ' ?\\n ?', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')) as cleaned from d"""


@query("t18_response_framed", _framed_sql())
def response_framed(spark, sf_dir):
    """Openings, closings, lone headings and phrases about the context taken off."""
    return dressed(spark, sf_dir, "rid", _FRAMED).select("rid", T.without_meta(F.col("t")).alias("cleaned"))


@query("t18_response_settled")
def response_settled(spark, sf_dir):
    """The whole cleaner over all conversation turns: patterns as Columns, repeats and garble behind Arrow."""
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    return turns.select("conv_id", "turn", T.without_repeats(T.without_meta(F.col("text"))).alias("cleaned"))


_SUMMARIES = ["# Title\nOverall, it grew  fast .", "In conclusion, fine , yes", "clean"]


@query("t19_summary_clean", f"select sid, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '(?m)^#+\\s*.*$', '', 'g'), '(?i)\\b(?:in summary|overall|in conclusion),?\\s*', '', 'g'), '\\s+([.,;:!?])', '\\1', 'g'), '[ \\t]{{2,}}', ' ', 'g')) as cleaned from {dressed_sql('sid', _SUMMARIES)}")
def summary_clean(spark, sf_dir):
    return dressed(spark, sf_dir, "sid", _SUMMARIES).select("sid", T.summary_clean(F.col("t")).alias("cleaned"))


@query(
    "t20_batch_summaries",
    f"with {FILES_SQL} select file_name, md5(trim(regexp_replace(text, '\\s+', ' ', 'g'))) as summary from files join documents using (doc_id) where doc_id % 7 <> 0 and trim(regexp_replace(text, '\\s+', ' ', 'g')) <> ''",
)
def batch_summaries(spark, sf_dir):
    """Summaries read back from replies on ten files each: some names lack their extension, some files are left out, unknown ones are ignored."""
    parse = F.udf(lambda reply, names: list(T.parse_batch_summaries(reply, names).items()), "array<struct<file_name:string,summary:string>>", useArrow=True)
    d = F.col("doc_id")
    said = F.concat(F.lit("FILE: "), F.when(d % 2 == 1, F.regexp_replace("file_name", r"\.[^.]*$", "")).otherwise(F.col("file_name")), F.lit("\nSUMMARY: "), F.trim(F.regexp_replace("text", r"\s+", " ")))
    rows = files(spark, sf_dir).join(read(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id").select(F.floor(d / 10).alias("batch"), d, "file_name", F.when(d % 7 != 0, said).alias("said"))
    batches = rows.groupBy("batch").agg(F.sort_array(F.collect_list(F.struct("doc_id", "file_name", "said"))).alias("l"))  # ten rows
    reply = F.concat(F.array_join(F.filter(F.transform("l", lambda x: x["said"]), lambda x: x.isNotNull()), "\n"), F.lit("\nFILE: nowhere.zip\nSUMMARY: none"))
    found = batches.select(F.explode(parse(reply, F.transform("l", lambda x: x["file_name"]))).alias("f"))
    return found.where("f.summary <> ''").select("f.file_name", F.md5(F.col("f.summary").cast("binary")).alias("summary"))


@query("t21_folder_summary", f"with {FILES_SQL}, n as (select folder_id, count(*) as n, list(file_name order by doc_id) as l from files group by folder_id) select folder_id, 'Folder holds ' || n || ' files: ' || array_to_string(list_slice(l, 1, 10), ', ') as summary from n")
def folder_summary(spark, sf_dir):
    names = F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "file_name"))), lambda x: x["file_name"])
    return files(spark, sf_dir).groupBy("folder_id").agg(F.concat(F.lit("Folder holds "), F.count(F.lit(1)).cast("string"), F.lit(" files: "), _as_text(F.slice(names, 1, 10), ", ")).alias("summary"))


@query("t22_folder_overview", f"with {FILES_SQL}, c as (select folder_id, mime_type, count(*) as n from files group by all) select folder_id, string_agg(mime_type || ': ' || n, '; ' order by n desc, mime_type) as overview from c group by folder_id")
def folder_overview(spark, sf_dir):
    c = files(spark, sf_dir).groupBy("folder_id", "mime_type").agg(F.count(F.lit(1)).alias("n"))
    shown = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "mime_type", "n"))), lambda x: F.concat(x["mime_type"], F.lit(": "), x["n"].cast("string")))
    return c.groupBy("folder_id").agg(_as_text(shown, "; ").alias("overview"))


@query("t24_drive_url", f"with {FILES_SQL} select file_id, coalesce(case when doc_id % 4 = 0 then 'https://files.example/' || file_name end, 'https://drive.example/file/d/' || file_id || '/view') as url from files")
def drive_url(spark, sf_dir):
    own = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("https://files.example/"), F.col("file_name")))
    return files(spark, sf_dir).select("file_id", F.coalesce(own, F.concat(F.lit("https://drive.example/file/d/"), F.col("file_id"), F.lit("/view"))).alias("url"))


@query("t25_citation_flat", f"with {CHUNKS_SQL} select chunk_id, row_number() over (partition by doc_id order by chunk_index) as number, left(content, 200) as preview from chunks")
def citation_flat(spark, sf_dir):
    from pyspark.sql import Window

    return chunks(spark, sf_dir).select("chunk_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("chunk_index")).alias("number"), F.left("content", F.lit(200)).alias("preview"))


@query("t26_cosine", "select vec_id, round(list_cosine_similarity(embedding::double[], list_reverse(embedding::double[])), 6) as cosine from embeddings")
def cosine(spark, sf_dir):
    v = F.transform("embedding", lambda x: x.cast("double"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    norm = F.sqrt(dot(v, v)) * F.sqrt(dot(F.reverse(v), F.reverse(v)))
    return read(spark, sf_dir, "embeddings").select("vec_id", F.round(dot(v, F.reverse(v)) / F.nullif(norm, F.lit(0.0)), 6).alias("cosine"))


@query("t27_display", "select doc_id, case when n_chars < 1024 then n_chars || ' B' when n_chars < 1048576 then printf('%.1f KB', floor(n_chars / 1024 * 10 + 0.5) / 10) else printf('%.1f MB', floor(n_chars / 1048576 * 10 + 0.5) / 10) end as size, (n_chars // 60) || ':' || lpad(cast(n_chars % 60 as varchar), 2, '0') as length from documents")
def display(spark, sf_dir):
    n = F.col("n_chars")
    size = F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1048576, F.format_string("%.1f KB", F.floor(n / 1024 * 10 + 0.5) / 10)).otherwise(F.format_string("%.1f MB", F.floor(n / 1048576 * 10 + 0.5) / 10))
    return read(spark, sf_dir, "documents").select("doc_id", size.alias("size"), F.concat(F.floor(n / 60).cast("string"), F.lit(":"), F.lpad((n % 60).cast("string"), 2, "0")).alias("length"))


@query("t28_history", "select conv_id, string_agg(case role when 'user' then 'Human: ' when 'assistant' then 'Assistant: ' else 'System: ' end || text, chr(10) order by turn) as history from conversations group by conv_id")
def history(spark, sf_dir):
    who = F.when(F.col("role") == "user", "Human: ").when(F.col("role") == "assistant", "Assistant: ").otherwise("System: ")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("turn", F.concat(who, F.col("text")).alias("line")))), lambda x: x["line"])
    return read(spark, sf_dir, "conversations").groupBy("conv_id").agg(_as_text(lines, "\n").alias("history"))


@query("u07_distinct_citations")
def distinct_citations(spark, sf_dir):
    """Near-equal citations of one answer's bounded list, best first."""

    def one(group: pd.DataFrame) -> pd.DataFrame:
        g = group.sort_values(["confidence", "turn"], ascending=[False, True]).reset_index(drop=True)
        rows = list(zip(g["file"], g["turn"].astype(str), g["text"], g["confidence"], strict=True))
        return g.iloc[T.distinct_citations(rows)][["conv_id", "turn"]]

    c = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"), (F.length("text") % 10 / 10).alias("confidence"), (F.col("turn") % 2).cast("string").alias("file"))
    return c.groupBy("conv_id").applyInPandas(one, "conv_id long, turn long")
