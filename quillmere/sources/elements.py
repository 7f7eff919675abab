"""Markdown, CSV and XML texts as elements (id, position, category, text)."""

from __future__ import annotations

import csv
import io
import sys
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: What a Markdown line is, first hit wins; any other line is prose.
MARKDOWN_LINES = [("```", "CodeSnippet"), ("#{1,6} ", "Title"), ("[-*+] ", "ListItem"), ("[0-9]+[.)] ", "ListItem"), ("[|]", "Table")]
#: A fence with all it holds (to the end, if it is never closed), or a line.
MARKDOWN_PARTS = r"(?s:```.*?(?:```|\z))|[^\n]+|\n[ \t]*\n"


def markdown_elements(texts: DataFrame) -> DataFrame:
    """Elements of ``texts`` (id, text): titles, list items, tables, fenced code and paragraphs.

    Adjacent lines of prose are one paragraph, adjacent lines of a table one table;
    a blank line ends both. Positions count from zero. A null or blank text has none.
    """
    parts = texts.select("id", F.posexplode(F.regexp_extract_all(F.replace("text", F.lit("\r\n"), F.lit("\n")), F.lit(MARKDOWN_PARTS), F.lit(0))).alias("at", "part"))
    kind = F.when(F.trim(F.translate("part", "\n\t", "  ")) == "", "Blank")
    for start, name in MARKDOWN_LINES:
        kind = kind.when(F.col("part").rlike("^" + start), name)
    parts = parts.withColumn("category", kind.otherwise("NarrativeText"))
    order = Window.partitionBy("id").orderBy("at")
    joins = F.col("category").isin("NarrativeText", "Table") & (F.lag("category").over(order) == F.col("category"))
    parts = parts.withColumn("joins", F.coalesce(joins, F.lit(False)))
    parts = parts.withColumn("position", F.sum(F.when((F.col("category") == "Blank") | F.col("joins"), 0).otherwise(1)).over(order) - 1).where("category <> 'Blank'")
    bare = F.when(F.col("category") == "Title", F.regexp_replace("part", "^#{1,6} ", "")).when(F.col("category") == "ListItem", F.regexp_replace("part", "^(?:[-*+]|[0-9]+[.)]) ", "")).when(F.col("category") == "CodeSnippet", F.regexp_replace("part", "```(?:[a-z]*\n)?", "")).otherwise(F.col("part"))
    held = F.transform(F.array_sort(F.collect_list(F.struct("at", F.trim(bare).alias("line")))), lambda x: x["line"])
    joined = parts.groupBy("id", "position", "category").agg(F.array_join(held, "\n").alias("text"))
    return joined.select("id", F.col("position").cast("int").alias("position"), "category", F.when(F.col("category") == "NarrativeText", F.replace("text", F.lit("\n"), F.lit(" "))).otherwise(F.col("text")).alias("text"))


def table_text(text: str) -> str:
    """A CSV text's cells, white space squeezed, rows by line; rows without a filled cell are left out."""
    csv.field_size_limit(sys.maxsize)  # a cell may hold a whole document
    rows = (" ".join(c for c in (" ".join(cell.split()) for cell in row) if c) for row in csv.reader(io.StringIO(text, newline="")))
    return "\n".join(r for r in rows if r)


def xml_texts(text: str) -> list[tuple[str, str]]:
    """(category, text) of an XML document's own texts in order; all of it as plain text if it does not parse."""
    try:
        root = ElementTree.fromstring(text)
    except ElementTree.ParseError:
        return [("UncategorizedText", " ".join(text.split()))]
    found = ("Title" if e.tag.rsplit("}", 1)[-1].lower() in ("title", "name") else "NarrativeText" for e in root.iter())
    return [(kind, t) for kind, e in zip(found, root.iter(), strict=True) if (t := " ".join((e.text or "").split()))]


def _rows(texts: DataFrame, parts) -> DataFrame:
    kind = texts.schema["id"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(i, n, *part) for i, t in zip(f["id"], f["text"], strict=True) for n, part in enumerate(parts(t) if t else [])]
            yield pd.DataFrame(rows, columns=["id", "position", "category", "text"])

    return texts.select("id", "text").mapInPandas(run, f"id {kind}, position int, category string, text string")


def csv_elements(texts: DataFrame) -> DataFrame:
    """One table for each of ``texts`` (id, text) that holds a cell; quoted cells may span lines."""
    return _rows(texts, lambda t: [("Table", found)] if (found := table_text(t)) else [])


def xml_elements(texts: DataFrame) -> DataFrame:
    """The texts inside the tags of ``texts`` (id, text), names and titles as titles."""
    return _rows(texts, lambda t: [(k, x) for k, x in xml_texts(t) if x])
