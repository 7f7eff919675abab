"""The engine's concepts, read from the standard tables: files, chunks, questions, vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Extension and MIME type that stand-in files take in turn.
FILE_KINDS = [
    (".pdf", "application/pdf"),
    (".txt", "text/plain"),
    (".md", "text/markdown"),
    (".csv", "text/csv"),
    (".py", "text/x-python"),
    (".mp3", "audio/mpeg"),
    (".png", "image/png"),
    (".html", "text/html"),
    (".docx", "application/vnd.openxmlformats-officedocument.wordprocessingml.document"),
    (".xlsx", "application/vnd.ms-excel"),
    (".mp4", "video/mp4"),
    (".json", "application/json"),
    (".ipynb", "application/octet-stream"),
    (".xyz", "application/octet-stream"),
    (".go", "text/x-go"),
    (".weird", "text/x-odd"),
]
#: Chunks are slices of this width, this far apart (an overlap of 150 characters).
CHUNK_CHARS, CHUNK_STRIDE = 800, 650

QUESTIONS = [
    (1, "Compare the quarterly report with the audit summary"),
    (2, "What is the difference between setup.py and main.go"),
    (3, "Which themes are common across all files"),
    (4, "Find all references to Maria Keller in the transcripts"),
    (5, "Show the latest changes to the budget"),
    (6, "What does the pdf say about storage"),
    (7, "Summarize this folder"),
    (8, "How does the function calculateTax work"),
    (9, "Play the audio recording of the interview"),
    (10, "List everything except doc_7 please"),
    (11, "Is the video clip related to the csv data"),
    (12, "Who is Jane Doe and where is \"Project Falcon\" described"),
    (13, "tell me about retention"),
    (14, "When did the migration happen, before or after the release"),
    (15, "Open notes.md and slides.pptx"),
    (16, "Check if the spec and the code are consistent with each other, then verify every place where the tax class is imported and explain the gap in detail"),
    (17, "hello"),
    (18, "excluding doc_12.txt what do the csv files contain"),
    (19, "the screenshot versus the diagram and the source code"),
    (20, "What happened in the meeting audio and the paper"),
    (21, "What's 'Deep Blue Sea' about"),
    (22, "transcript"),
]


def values_sql(rows: list[tuple], alias: str) -> str:
    """A SQL VALUES table."""

    def one(v):
        if v is None:
            return "null"
        if isinstance(v, bool):
            return str(v).lower()
        return str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"

    return "(values " + ", ".join("(" + ", ".join(one(v) for v in r) + ")" for r in rows) + f") as {alias}"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_id, doc_id, file_name, mime_type, folder_id, size)."""
    turn = (F.col("doc_id") % len(FILE_KINDS)).cast("int") + 1
    pick = lambda k: F.element_at(F.array(*[F.lit(x[k]) for x in FILE_KINDS]), turn)
    return read(spark, sf_dir, "documents").select(
        F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("file_id"),
        "doc_id",
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), pick(0)).alias("file_name"),
        pick(1).alias("mime_type"),
        F.col("source").alias("folder_id"),
        F.col("n_chars").alias("size"),
    )


FILES_SQL = (
    "files as (select 'f' || doc_id as file_id, doc_id, 'doc_' || doc_id || k.ext as file_name, k.mime as mime_type, source as folder_id, n_chars as size from documents join "
    + values_sql([(i, *k) for i, k in enumerate(FILE_KINDS)], "k(i, ext, mime)")
    + f" on doc_id % {len(FILE_KINDS)} = k.i)"
)


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chunk_id, doc_id, chunk_index, content): slices of fixed stride."""
    count = F.greatest(F.lit(1), F.ceil(F.length("text") / CHUNK_STRIDE)).cast("int")
    return (
        read(spark, sf_dir, "documents")
        .select("doc_id", "text", F.explode(F.sequence(F.lit(0), count - 1)).alias("chunk_index"))
        .select(
            F.concat_ws(":", F.col("doc_id").cast("string"), F.col("chunk_index").cast("string")).alias("chunk_id"),
            "doc_id",
            "chunk_index",
            F.substring("text", F.col("chunk_index") * CHUNK_STRIDE + 1, F.lit(CHUNK_CHARS)).alias("content"),
        )
    )


CHUNKS_SQL = (
    "chunks as (select doc_id || ':' || i as chunk_id, doc_id, cast(i as int) as chunk_index, substr(text, i * %d + 1, %d) as content "
    "from (select doc_id, text, unnest(range(0, cast(greatest(1, ceil(length(text) / %d.0)) as bigint))) as i from documents))"
) % (CHUNK_STRIDE, CHUNK_CHARS, CHUNK_STRIDE)


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(qid, question): every user turn of the conversations asks one of the phrasings, by turns of nothing more, of a file, or of its whole text."""
    c, t = F.col("conv_id"), F.col("turn")
    phrase = F.element_at(F.array(*[F.lit(q) for _, q in QUESTIONS]), ((c * 7 + t) % len(QUESTIONS) + 1).cast("int"))
    suffix = F.element_at(F.array(*[F.lit(x) for x, _ in FILE_KINDS]), (c * 5 % len(FILE_KINDS) + 1).cast("int"))
    named = F.concat(F.lit(" in Doc_"), (c * 5 % 1200).cast("string"), F.when(t % 4 == 0, suffix).otherwise(""))
    more = F.when((c + t) % 3 == 0, "").when((c + t) % 3 == 1, named).otherwise(F.concat(F.lit(" "), F.coalesce("text", F.lit(""))))
    return read(spark, sf_dir, "conversations").where("role = 'user'").select((c * 100000 + t).alias("qid"), F.concat(phrase, more).alias("question"))


QUESTIONS_SQL = (
    "questions as (select conv_id * 100000 + turn as qid, p.phrase || case (conv_id + turn) % 3 when 0 then '' when 1 then ' in Doc_' || (conv_id * 5 % 1200) || case when turn % 4 = 0 then s.suffix else '' end "
    "else ' ' || coalesce(text, '') end as question from conversations join "
    + values_sql([(i, q) for i, (_, q) in enumerate(QUESTIONS)], "p(i, phrase)")
    + f" on (conv_id * 7 + turn) % {len(QUESTIONS)} = p.i join "
    + values_sql([(i, x) for i, (x, _) in enumerate(FILE_KINDS)], "s(i, suffix)")
    + f" on conv_id * 5 % {len(FILE_KINDS)} = s.i where role = 'user')"
)


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, folder_id, title, file_name): files named after the first three words of their text."""
    begins = F.regexp_extract("text", r"^[ \n]*+(?:[^ \n]++[ \n]*+){0,3}", 0)  # the rest of a text need not be cut into words
    title = F.array_join(F.slice(F.regexp_extract_all(begins, F.lit(r"[^ \n]+"), F.lit(0)), 1, 3), " ")
    return read(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("folder_id"), title.alias("title"), F.concat(title, F.lit(".txt")).alias("file_name"))


TITLES_SQL = "titles as (select doc_id, source as folder_id, array_to_string(list_slice(regexp_extract_all(text, '[^ \\n]+'), 1, 3), ' ') as title, array_to_string(list_slice(regexp_extract_all(text, '[^ \\n]+'), 1, 3), ' ') || '.txt' as file_name from documents)"


def _shown(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def dressed(spark: SparkSession, sf_dir: str, key: str, phrases: list[str], between: str = "\n") -> DataFrame:
    """(key, variant, t): every conversation turn with one of ``phrases``, by turns before and behind its whole text."""
    c, t = F.col("conv_id"), F.col("turn")
    variant = ((c * 3 + t) % len(phrases)).cast("int")
    phrase, text = F.element_at(F.array(*[F.lit(p) for p in phrases]), variant + 1), F.coalesce("text", F.lit(""))
    whole = F.when((c + t) % 5 == 0, phrase).when((c + t) % 2 == 0, F.concat(phrase, F.lit(between), text)).otherwise(F.concat(text, F.lit(between), phrase))
    return read(spark, sf_dir, "conversations").select((c * 100000 + t).alias(key), variant.alias("variant"), whole.alias("t"))


def dressed_sql(key: str, phrases: list[str], between: str = "\n") -> str:
    """The same as a SQL subquery, to be given an alias."""
    listed = ", ".join(_shown(p) for p in phrases)
    of = f"list_extract([{listed}], cast((conv_id * 3 + turn) % {len(phrases)} + 1 as int))"
    return (
        f"(select conv_id * 100000 + turn as {key}, cast((conv_id * 3 + turn) % {len(phrases)} as int) as variant, case when (conv_id + turn) % 5 = 0 then {of} "
        f"when (conv_id + turn) % 2 = 0 then {of} || {_shown(between)} || coalesce(text, '') else coalesce(text, '') || {_shown(between)} || {of} end as t from conversations)"
    )
