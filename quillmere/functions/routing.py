"""Rules that route files and questions: Column expressions over fixed rule tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: extensions and MIME types by processing category ------------------
EXTENSIONS = {
    "unstructured_native": ".txt .md .markdown .rst .csv .json .xml .html .htm .pdf .doc .docx .xls .xlsx .ppt .pptx .odt .ods .odp .gdoc .gsheet .gslides .rtf .epub .mobi .jpg .jpeg .png .gif .bmp .tiff .tif .webp .svg".split(),
    "audio": ".mp3 .wav .m4a .flac .ogg .aac .wma .opus".split(),
    "code": ".py .pyw .pyc .js .jsx .ts .tsx .mjs .cjs .java .class .jar .c .cpp .cc .cxx .h .hpp .hxx .go .rs .rb .rake .php .phtml .swift .kt .kts .scala .sh .bash .zsh .fish .ps1 .psm1 .yaml .yml .toml .ini .cfg .conf .r .m .matlab .lua .pl .pm .sql".split(),
    "notebook": [".ipynb"],
}
MIME_TYPES = {
    "unstructured_native": (
        "text/plain text/markdown text/csv text/html text/xml application/json application/xml application/pdf application/msword "
        "application/vnd.openxmlformats-officedocument.wordprocessingml.document application/vnd.openxmlformats-officedocument.spreadsheetml.sheet "
        "application/vnd.openxmlformats-officedocument.presentationml.presentation application/vnd.ms-excel application/vnd.ms-powerpoint "
        "application/vnd.oasis.opendocument.text application/vnd.oasis.opendocument.spreadsheet application/vnd.oasis.opendocument.presentation "
        "application/vnd.google-apps.document application/vnd.google-apps.spreadsheet application/vnd.google-apps.presentation application/rtf application/epub+zip "
        "image/jpeg image/jpg image/png image/gif image/bmp image/tiff image/webp image/svg+xml image/x-icon"
    ).split(),
    "audio": "audio/mpeg audio/mp3 audio/wav audio/x-wav audio/m4a audio/x-m4a audio/flac audio/ogg audio/aac audio/x-ms-wma audio/opus audio/webm".split(),
    "code": "text/x-python application/x-python-code text/javascript application/javascript text/x-javascript application/typescript text/x-typescript text/x-java-source text/x-java text/x-c text/x-c++ text/x-c++src text/x-go text/x-rust text/x-ruby application/x-php text/x-shellscript application/x-sh text/x-yaml application/x-yaml text/x-sql".split(),
    "notebook": ["application/x-ipynb+json"],
}
UNSUPPORTED = "unsupported"
# --- fixed values: rule tables of the question classifiers, first hit wins ------------
# Parts of a text/* MIME type that mean code.
CODE_MIME_PARTS = ["x-python", "javascript", "typescript", "x-java", "x-c", "x-c++", "x-go", "x-rust", "x-ruby", "x-php", "x-shellscript", "x-sh", "x-sql"]
QUESTION_CLASSES = [
    (["compare", "versus", "vs", "difference", "contrast"], "comparison", 0.8),
    (["common", "themes", "patterns", "across", "relate"], "relationship", 0.7),
    (["find all", "every mention", "all references", "where is"], "entity_search", 0.7),
    (["recent", "latest", "changed", "updated"], "temporal", 0.7),
    (["audio", "screenshot", "image", "pdf", "csv", "file"], "factual_specific", 0.8),
    (["about", "overview", "summarize", "folder"], "factual_general", 0.6),
]
STRATEGIES = [
    (["function", "class", "variable", "import", "def ", "def(", "calculatetax", "authservice", "file:", "line "], "exact_match"),
    (["compare", "contrast", "difference", "inconsistent", "gap", "check if", "verify", "consistent with", "every place where", "find all"], "complex"),
]
PROMPT_TYPES = [
    ("relationship related connection link compare difference similar same common shared overlap associate correlate depend influence cause effect".split(), "relationship"),
    (["summarize", "synthesize", "overall", "general", "all documents", "all files", "across", "multiple", "combine", "integrate", "pattern", "theme", "together"], "synthesis"),
    (["what is", "who is", "when did", "where is", "how many", "how much", "which", "name", "list"], "factual"),
]
INTENTS = [
    (["what is", "who is", "define", "explain", "tell me about"], "factual"),
    (["how are", "related to", "connected", "relationship", "link between"], "relational"),
    (["when", "before", "after", "timeline", "sequence", "order"], "temporal"),
    (["summarize", "overview", "main points", "key findings", "summary"], "synthesis"),
    (["compare", "difference", "versus", " vs ", "similar", "different"], "comparison"),
]
#: What a question about a whole folder says.
OVERVIEW_PHRASES = ["overview", "summary", "summarize", "all files", "folder contents", "generic overview", "what's in this folder", "describe the folder"]
# --- fixed values: content types with keyword weights ---------------------------------
CONTENT_KEYWORDS = {
    "audio": {"audio": 1.0, "recording": 1.0, "sound": 0.9, "voice": 0.9, "speech": 0.9, "said": 0.6, "mentioned": 0.6, "spoken": 0.7, "talk": 0.6, "conversation": 0.8, "interview": 0.9, "podcast": 0.95, "call": 0.8, "meeting audio": 0.95, "voice memo": 0.9, "transcription": 0.95, "transcript": 0.95, "listen": 0.7, "heard": 0.6, "speaker": 0.7, "audio file": 1.0},
    "video": {"video": 1.0, "visual": 0.7, "showed": 0.6, "screen": 0.7, "footage": 0.9, "clip": 0.8, "movie": 0.9, "film": 0.9},
    "document": {"paper": 0.9, "document": 0.8, "pdf": 1.0, "resume": 1.0, "cv": 1.0, "article": 0.9, "report": 0.9, "publication": 0.9, "page": 0.6, "section": 0.6, "chapter": 0.7, "paragraph": 0.6, "written": 0.7, "text": 0.5, "reads": 0.6, "states": 0.6, "according to": 0.6, "says in": 0.6, "mentions in": 0.6},
    "image": {"image": 1.0, "screenshot": 1.0, "picture": 0.9, "photo": 0.9, "photograph": 0.9, "graphic": 0.8, "diagram": 0.8, "chart": 0.8, "visualization": 0.8, "visual": 0.7, "png": 1.0, "jpg": 1.0, "jpeg": 1.0, "gif": 1.0},
    "code": {"code": 1.0, "function": 0.8, "class": 0.8, "method": 0.8, "implementation": 0.9, "algorithm": 0.8, "script": 0.9, "program": 0.9, "repository": 0.8, "source code": 1.0, "codebase": 0.9, "source": 0.7},
    "text": {"csv": 1.0, "csv file": 1.0, "csv files": 1.0, "csv data": 1.0, "tsv": 1.0, "data": 0.7, "table": 0.8, "spreadsheet": 0.9, "tabular": 0.8, "delimited": 0.7, "comma-separated": 1.0},
}
CONTENT_EXTENSIONS = {
    "audio": ".m4a .mp3 .wav .flac .ogg .mp4 .wma .aac".split(),
    "video": ".mp4 .mov .avi .mkv .webm .flv".split(),
    "document": ".pdf .txt .md .doc .docx .rtf .odt".split(),
    "image": ".png .jpg .jpeg .gif .bmp .svg .webp .tiff".split(),
    "code": ".py .js .java .cpp .ts .go .rs .rb .php .cs".split(),
    "text": ".csv .tsv .txt .tab".split(),
}
STOP_WORDS = "the a an and or but in on at to for of with by from as is was are were be been being have has had do does did will would should could may might must can what when where who why how which this that".split()
ENTITY_STOP_WORDS = ["The", "This", "That", "What", "Which", "Where", "When", "How", "Why"]


def suffix(name: Column) -> Column:
    """Lower-case extension with its dot; empty if the last path part has none."""
    return F.lower(F.regexp_extract(name, r"[^/](\.[^./]+)$", 1))


def by_members(value: Column, table: dict[str, list[str]]) -> Column:
    """The first key whose list holds ``value``, else null."""
    return F.coalesce(*[F.when(value.isin(members), F.lit(key)) for key, members in table.items()])


def has_any(text: Column, keywords: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(k)) for k in keywords])


def first_rule(text: Column, rules: list[tuple], default, pick: int = 1) -> Column:
    """Value of the first rule one of whose keywords occurs in ``text``."""
    out = None
    for rule in rules:
        hit = has_any(text, rule[0])
        out = F.when(hit, F.lit(rule[pick])) if out is None else out.when(hit, F.lit(rule[pick]))
    return out.otherwise(F.lit(default))


def file_category(name: Column, mime: Column) -> Column:
    """Processing category: exact MIME type, then MIME prefix, then extension."""
    m = F.lower(F.trim(mime))
    prefix = (
        F.when(m.startswith("audio/"), F.lit("audio"))
        .when(m.startswith("text/"), F.when(has_any(m, CODE_MIME_PARTS), F.lit("code")).otherwise(F.lit("unstructured_native")))
        .when(m.startswith("image/"), F.lit("unstructured_native"))
    )
    return F.coalesce(by_members(m, MIME_TYPES), prefix, by_members(suffix(name), EXTENSIONS), F.lit(UNSUPPORTED))


def chunk_file_type(name: Column, mime: Column) -> Column:
    """File type for the chunker: by MIME type, then by extension."""
    n, m = F.lower(name), F.lower(mime)
    marked = n.rlike(r"\.(md|markdown)$")
    return (
        F.when(F.contains(m, F.lit("pdf")), "pdf")
        .when(F.contains(m, F.lit("audio")), "audio")
        .when(F.contains(m, F.lit("video")), "video")
        .when(has_any(m, ["text", "markdown"]), F.when(marked, "markdown").otherwise("text"))
        .when(n.endswith(".pdf"), "pdf")
        .when(marked, "markdown")
        .when(n.rlike(r"\.(py|js|ts|java|cpp|go|rs|rb)$"), "code")
        .when(n.rlike(r"\.(m4a|mp3|wav|flac|ogg)$"), "audio")
        .when(n.rlike(r"\.(mp4|mov|avi)$"), "video")
        .otherwise("unknown")
    )


def element_file_type(name: Column, mime: Column) -> Column:
    """File type for element partitioning: by extension, then by MIME prefix."""
    table = {"image": ".jpg .jpeg .png .gif .bmp .tiff .tif .webp".split(), "html": [".html", ".htm"], "document": ".doc .docx .xls .xlsx .ppt .pptx .odt .ods .odp".split(), "pdf": [".pdf"], "text": [".txt", ".csv"], "markdown": [".md", ".markdown"]}
    by_mime = (
        F.when(mime.startswith("image/"), "image")
        .when(mime.startswith("text/html"), "html")
        .when(mime.rlike(r"^application/(vnd\.openxmlformats-officedocument|msword|vnd\.oasis\.opendocument)"), "document")
        .when(mime == "application/pdf", "pdf")
        .when(mime.startswith("text/"), "text")
    )
    return F.coalesce(by_members(suffix(name), table), by_mime, F.lit("unknown"))


def element_chunk_type(element: Column, file_type: Column) -> Column:
    e = F.lower(element)
    return (
        F.when(file_type == "image", "image_ocr_text")
        .when(has_any(e, ["title", "heading"]), "document_title")
        .when(F.contains(e, F.lit("table")), "document_table")
        .when(F.contains(e, F.lit("list")), "document_list_item")
        .when(F.contains(e, F.lit("summary")), "document_summary")
        .otherwise("document_section")
    )


def inventory_category(name: Column, mime: Column) -> Column:
    """Category shown in folder inventories: extension first, then MIME words."""
    n, m = F.lower(name), F.lower(mime)
    return (
        F.when(n.endswith(".csv"), "CSV")
        .when(n.rlike(r"\.(tsv|tab)$"), "TSV")
        .when(n.rlike(r"\.(md|markdown)$"), "Markdown")
        .when(n.endswith(".pdf"), "PDF")
        .when(n.rlike(r"\.(py|js|ts|java|cpp|c|go|rs|rb|php|cs|swift|kt)$"), "Code")
        .when(n.rlike(r"\.(html|htm)$"), "HTML")
        .when(n.rlike(r"\.(json|xml|yaml|yml)$"), "Data")
        .when(F.contains(m, F.lit("csv")), "CSV")
        .when((m == "text/tab-separated-values") | F.contains(m, F.lit("tsv")), "TSV")
        .when(F.contains(m, F.lit("markdown")), "Markdown")
        .when(F.contains(m, F.lit("pdf")), "PDF")
        .when(F.contains(m, F.lit("audio")), "Audio")
        .when(F.contains(m, F.lit("image")), "Image")
        .when(F.contains(m, F.lit("video")), "Video")
        .when(F.contains(m, F.lit("html")), "HTML")
        .when(F.contains(m, F.lit("json")), "Data")
        .when(m.startswith("text/"), "Text")
        .when(has_any(m, ["python", "javascript"]), "Code")
        .when(has_any(m, ["document", "msword"]), "Document")
        .when(has_any(m, ["spreadsheet", "excel"]), "Spreadsheet")
        .when(has_any(m, ["presentation", "powerpoint"]), "Presentation")
        .otherwise("Other")
    )


def document_kind(mime: Column) -> Column:
    return F.when(mime == "application/pdf", "pdf").when(mime.startswith("audio/"), "audio").when(mime.isin("text/x-python", "text/javascript"), "code").otherwise("text")


def content_scores(text: Column) -> dict[str, Column]:
    """Largest weight of a keyword that occurs in the lower-case text, by content type."""
    return {t: F.greatest(F.lit(0.0), *[F.when(F.contains(text, F.lit(k)), F.lit(w)).otherwise(F.lit(0.0)) for k, w in words.items()]) for t, words in CONTENT_KEYWORDS.items()}


def complexity(text: Column) -> Column:
    words, chars = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != "")), F.length(text)
    return F.when((words < 5) & (chars < 50), "simple").when((words < 15) & (chars < 150), "moderate").when((words < 30) & (chars < 300), "complex").otherwise("very_complex")


def similarity(distance: Column) -> Column:
    """Similarity from a distance of unknown kind: large ones are Euclidean, others cosine."""
    return F.when(distance > 10, 1 / (1 + distance)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - distance)))


def token_estimate(text: Column) -> Column:
    return F.floor(F.length(text) / 4)


def clock(seconds: Column) -> Column:
    """MM:SS, or HH:MM:SS from one hour on."""
    s = F.floor(seconds).cast("long")
    h, m, x = F.floor(s / 3600), F.floor(F.pmod(s, F.lit(3600)) / 60), F.pmod(s, F.lit(60))
    return F.when(h > 0, F.format_string("%02d:%02d:%02d", h, m, x)).otherwise(F.format_string("%02d:%02d", m, x))


def keywords(text: Column) -> Column:
    """Lower-case words of over two letters that are no stop words, in order."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\b\w+\b"), F.lit(0)), lambda w: (F.length(w) > 2) & ~w.isin(STOP_WORDS))


def question_entities(text: Column) -> Column:
    """Quoted strings and runs of capitalised words, sorted, without common words."""
    quoted = F.concat(F.regexp_extract_all(text, F.lit('"([^"]+)"'), F.lit(1)), F.regexp_extract_all(text, F.lit("'([^']+)'"), F.lit(1)))
    capital = F.regexp_extract_all(text, F.lit(r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)\b"), F.lit(1))
    return F.array_sort(F.array_distinct(F.filter(F.concat(quoted, capital), lambda e: (F.length(e) > 2) & ~e.isin(ENTITY_STOP_WORDS))))


def safe_file_name(name: Column) -> Column:
    base = F.regexp_replace(name, r"^.*/", "")
    clean = F.regexp_replace(F.replace(F.replace(base, F.lit("\\"), F.lit("_")), F.lit(".."), F.lit("_")), r'[<>:"|?*]', "_")
    ext = F.regexp_extract(clean, r"[^.](\.[^.]*)$", 1)
    stem = F.substring(clean, F.lit(1), F.length(clean) - F.length(ext))
    return F.when(F.length(clean) > 255, F.concat(F.substring(stem, 1, 250), ext)).otherwise(clean)


def masked(value: Column, visible: int = 4) -> Column:
    long = F.length(value) > visible
    return F.when(long, F.concat(F.substring(value, 1, visible), F.repeat(F.lit("*"), F.length(value) - visible))).otherwise(F.repeat(F.lit("*"), F.length(value)))


def answer_confidence(answer: Column, sources: Column) -> Column:
    return F.when((sources == 0) | (F.length(answer) < 10), F.lit(0.0)).otherwise(F.least(sources / 5, F.lit(1.0)))


def source_reliability(score: Column, name: Column, page: Column, mime: Column) -> Column:
    total = (
        F.lit(0.5)
        + F.when(score > 0.8, 0.2).when(score > 0.6, 0.1).otherwise(0.0)
        + F.when(name.isNotNull() & (name != "") & (name != "Unknown"), 0.1).otherwise(0.0)
        + F.when(page.isNotNull(), 0.1).otherwise(0.0)
        + F.when(mime == "application/pdf", 0.05).otherwise(0.0)
    )
    return F.least(total, F.lit(1.0))


def entity_confidence(text: Column, kind: Column) -> Column:
    bump = lambda c: F.when(c, 0.1).otherwise(0.0)
    return F.least(F.lit(0.7) + bump(F.length(text) > 3) + bump(F.length(text) > 10) + bump(kind.isin("FUNCTION", "CLASS", "MODULE", "VARIABLE")), F.lit(1.0))


def citation_label(name: Column, page: Column, start: Column, end: Column, first_line: Column, last_line: Column) -> Column:
    return (
        F.when(page.isNotNull(), F.concat(F.lit("Source: "), name, F.lit(", Page "), page.cast("string")))
        .when(start.isNotNull(), F.concat(F.lit("Source: "), name, F.lit(", "), clock(start), F.lit("-"), clock(end)))
        .when(first_line.isNotNull(), F.concat(F.lit("Source: "), name, F.lit(", Lines "), first_line.cast("string"), F.lit("-"), last_line.cast("string")))
        .otherwise(F.concat(F.lit("Source: "), name))
    )


# The extensions of the families that a question may speak of, and of the kinds that a reference may.
FAMILY_EXTENSIONS = {
    "csv": [".csv", ".tsv"],
    "pdf": [".pdf"],
    "txt": [".txt"],
    "docx": [".docx", ".doc"],
    "png": [".png"],
    "jpg": [".jpg", ".jpeg"],
    "wav": [".wav"],
    "mp3": [".mp3"],
    "html": [".html", ".htm"],
}
REFERENCE_EXTENSIONS = [".csv", ".tsv", ".pdf", ".txt", ".docx", ".png", ".jpg", ".wav", ".mp3"]
