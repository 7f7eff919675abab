"""Queries of what is read: exports, elements of marked-up texts, sketches kept with the inventory."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.sketches import rolled_up, sketched
from ..registry import query
from ..sources.elements import MARKDOWN_LINES, MARKDOWN_PARTS, csv_elements, markdown_elements, xml_elements
from ..sources.tables import read, values_sql
from .graph import _EXPORTS, _MIMES

#: Extension of what is exported.
EXTENSIONS = {
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": ".docx",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": ".xlsx",
    "application/vnd.openxmlformats-officedocument.presentationml.presentation": ".pptx",
    "application/pdf": ".pdf",
}


@query(
    "s05_download_export",
    f"""with f as (select doc_id, list_extract({_MIMES!r}, cast(doc_id % 5 + 1 as int)) as mime, coalesce(text, '') as text from documents),
x as (select doc_id, text, case when mime like 'application/vnd.google-apps%' then coalesce(e.t, 'application/pdf') else mime end as fetched_as from f left join {values_sql(list(_EXPORTS.items()), 'e(m, t)')} on f.mime = e.m)
select 'f' || doc_id || coalesce(k.ext, '.txt') as local_name, fetched_as, doc_id % 3 = 0 as from_cache, cast(case when doc_id % 3 = 0 then 0 else octet_length(encode(text)) end as bigint) as fetched_bytes, sha256(text) as content
from x left join {values_sql(list(EXTENSIONS.items()), 'k(m, ext)')} on fetched_as = k.m""",
)
def download_export(spark, sf_dir):
    """What a download leaves: office types exported, the cached copy taken where there is one (here, of every third file)."""
    table = lambda pairs: F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])
    mime = F.element_at(F.array(*[F.lit(m) for m in _MIMES]), (F.col("doc_id") % 5 + 1).cast("int"))
    exported = F.coalesce(F.try_element_at(table(_EXPORTS), mime), F.lit("application/pdf"))
    d = read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.when(mime.startswith("application/vnd.google-apps"), exported).otherwise(mime).alias("fetched_as"))
    cached = F.col("doc_id") % 3 == 0
    name = F.concat(F.lit("f"), F.col("doc_id").cast("string"), F.coalesce(F.try_element_at(table(EXTENSIONS), F.col("fetched_as")), F.lit(".txt")))
    return d.select(name.alias("local_name"), "fetched_as", cached.alias("from_cache"), F.when(cached, 0).otherwise(F.octet_length("text")).cast("long").alias("fetched_bytes"), F.sha2("text", 256).alias("content"))


_KINDS_SQL = "case when trim(translate(part, chr(10) || chr(9), '  ')) = '' then 'Blank' " + " ".join(f"when regexp_matches(part, '^{start}') then '{name}'" for start, name in MARKDOWN_LINES) + " else 'NarrativeText' end"


@query(
    "s10_markdown_elements",
    f"""with m as (select doc_id as id, '# ' || coalesce(source, '') || chr(10) || coalesce(text, '') || chr(10) || '- ' || coalesce(lang, '') || chr(10) || '2. two' || chr(10) || '| n | m |' || chr(10) || '| ' || n_chars || ' | x |' || chr(10) || '```sql' || chr(10) || 'select 1' || chr(10) || chr(10) || '```' || chr(10) || 'end' as t from documents),
e as (select id, regexp_extract_all(t, '{MARKDOWN_PARTS}') as ps from m), u as (select id, unnest(ps) as part, unnest(range(0, len(ps))) as pos from e),
k as (select *, {_KINDS_SQL} as category from u),
j as (select *, coalesce(category in ('NarrativeText', 'Table') and lag(category) over (partition by id order by pos) = category, false) as joins from k),
p as (select *, sum(case when category = 'Blank' or joins then 0 else 1 end) over (partition by id order by pos) - 1 as position from j),
b as (select *, trim(case category when 'Title' then regexp_replace(part, '^#{{1,6}} ', '') when 'ListItem' then regexp_replace(part, '^(?:[-*+]|[0-9]+[.)]) ', '') when 'CodeSnippet' then regexp_replace(part, '```(?:[a-z]*\\n)?', '', 'g') else part end) as line from p where category <> 'Blank')
select id, cast(position as int) as position, category, md5(case category when 'NarrativeText' then string_agg(line, ' ' order by pos) else string_agg(line, chr(10) order by pos) end) as text from b group by id, position, category""",
)
def markdown(spark, sf_dir):
    """Documents dressed with a heading, list items, a table and fenced code."""
    lines = [F.concat(F.lit("# "), F.coalesce("source", F.lit(""))), F.coalesce("text", F.lit("")), F.concat(F.lit("- "), F.coalesce("lang", F.lit(""))), F.lit("2. two\n| n | m |"), F.concat(F.lit("| "), F.col("n_chars").cast("string"), F.lit(" | x |")), F.lit("```sql\nselect 1\n\n```\nend")]
    texts = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.concat_ws("\n", *lines).alias("text"))
    return markdown_elements(texts).withColumn("text", F.md5(F.col("text").cast("binary")))


@query("s10_csv_elements", "select conv_id * 100000 + turn as id, 0 as position, 'Table' as category, rtrim('role text' || chr(10) || role || ' ' || trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'))) as text from conversations")
def csv_tables(spark, sf_dir):
    """Every turn as a CSV text of two rows, its words in a quoted cell."""
    quoted = F.replace(F.coalesce("text", F.lit("")), F.lit('"'), F.lit('""'))
    t = F.concat(F.lit("role,text\n"), F.col("role"), F.lit(',"'), quoted, F.lit('"\n'))
    return csv_elements(read(spark, sf_dir, "conversations").select((F.col("conv_id") * 100000 + F.col("turn")).alias("id"), t.alias("text")))


@query(
    "s10_xml_elements",
    """with p as (select doc_id as id, unnest([1, 2]) as o, unnest(['Title', 'NarrativeText']) as category, unnest([coalesce(source, ''), trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'))]) as text from documents)
select id, cast(row_number() over (partition by id order by o) - 1 as int) as position, category, md5(text) as text from p where text <> ''""",
)
def xml_texts_of(spark, sf_dir):
    """Documents as XML with a title and a body."""
    safe = lambda c: F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    t = F.concat(F.lit("<doc>\n <title>"), safe("source"), F.lit("</title><body>"), safe("text"), F.lit("</body>\n</doc>"))
    return xml_elements(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), t.alias("text"))).withColumn("text", F.md5(F.col("text").cast("binary")))


@query(
    "a22_sketched_cube",
    """with r as (select o_orderstatus, o_orderpriority, o_custkey, o_orderkey from orders)
select o_orderstatus, o_orderpriority, cast(grouping(o_orderstatus, o_orderpriority) as bigint) as level, count(*) as n, count(distinct o_custkey) as customers, true as close, true as ranked from r group by cube (o_orderstatus, o_orderpriority)""",
)
def sketched_cube(spark, sf_dir):
    """A cube from merged sketches beside exact counts: distinct customers within 6 %, the median between the exact quantiles 0.4 and 0.6 (asked of five rows or more)."""
    keys = ["o_orderstatus", "o_orderpriority"]
    orders = read(spark, sf_dir, "orders").select(*keys, "o_custkey", "o_orderkey")
    rolled = rolled_up(sketched(orders, keys, F.col("o_custkey"), F.col("o_orderkey")), keys, [0.5]).select(*[F.col(k).alias("r_" + k) for k in keys], F.col("grouping").alias("level"), "distinct", F.col("quantiles")[0].alias("median"))
    exact = orders.cube(*keys).agg(F.grouping_id().alias("x_level"), F.count(F.lit(1)).alias("n"), F.count_distinct("o_custkey").alias("customers"), F.percentile("o_orderkey", F.array(F.lit(0.4), F.lit(0.6))).alias("middle"))
    both = exact.join(rolled, (F.col("x_level") == F.col("level")) & F.col("r_o_orderstatus").eqNullSafe(F.col(keys[0])) & F.col("r_o_orderpriority").eqNullSafe(F.col(keys[1])))
    close = F.abs(F.col("distinct") - F.col("customers")) <= F.greatest(F.lit(1.0), 0.06 * F.col("customers"))
    ranked = (F.col("n") < 5) | F.col("median").between(F.col("middle")[0], F.col("middle")[1])
    return both.select(*keys, F.col("level").cast("long").alias("level"), "n", "customers", close.alias("close"), ranked.alias("ranked"))
