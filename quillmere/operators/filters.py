"""A metadata filter language compiled to one Column, so that it reaches the scan."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Keys that the retrieval filter understands; others are ignored.
DIRECT_KEYS = ("folder_id", "file_id", "file_name", "file_type", "source_file_id", "mime_type", "element_type")
_COMPARE = {
    "$eq": lambda c, v: c == v,
    "$ne": lambda c, v: c.isNull() | (c != v),
    "$gt": lambda c, v: c > v,
    "$gte": lambda c, v: c >= v,
    "$lt": lambda c, v: c < v,
    "$lte": lambda c, v: c <= v,
    "$in": lambda c, v: c.isin(list(v)),
    "$nin": lambda c, v: c.isNull() | ~c.isin(list(v)),
}


def all_of(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def where_clause(spec: Mapping[str, Any]) -> Column:
    """A predicate from nested clauses: {column: value}, {column: {"$op": value}}, {"$and" | "$or": [...]}."""
    parts = []
    for key, value in spec.items():
        if key in ("$and", "$or"):
            inner = [where_clause(v) for v in value]
            parts.append(all_of(inner) if key == "$and" else reduce(lambda a, b: a | b, inner, F.lit(False)))
        elif isinstance(value, Mapping):
            parts += [_COMPARE[op](F.col(key), v) for op, v in value.items()]
        else:
            parts.append(F.col(key) == value)
    return all_of(parts)


def _bounds(span: Mapping[str, Any]) -> dict[str, Any]:
    """A range in ``start`` and ``end`` (dates or numbers, both included) as comparisons."""
    iso = lambda v: v.isoformat() if hasattr(v, "isoformat") else v
    return {{"start": "$gte", "end": "$lte"}.get(k, k): iso(v) for k, v in span.items()}


def retrieval_filter(spec: Mapping[str, Any]) -> Column:
    """The filter of a search: direct keys, page_number, date_range, timestamp_range, element types.

    A list of pages or element types means any of them. Ranges take ``start`` and
    ``end``, or operators; dates compare as ISO text. Unknown keys are dropped.
    """
    clauses: dict[str, Any] = {}
    extra = []
    for key, value in spec.items():
        if key in ("element_type", "page_number") and isinstance(value, (list, tuple)):
            clauses[key] = {"$in": value}
        elif key in DIRECT_KEYS or key == "page_number":
            clauses[key] = value
        elif key in ("date_range", "timestamp_range"):
            column = "created_at" if key == "date_range" else "timestamp_start"
            extra.append(where_clause({column: _bounds(value)}))
    return all_of([where_clause(clauses), *extra])


def post_filter(spec: Mapping[str, Any]) -> Column:
    """The filter behind keyword search: a missing date passes a date range."""
    dates = spec.get("date_range")
    rest = retrieval_filter({k: v for k, v in spec.items() if k != "date_range"})
    return rest & (F.col("created_at").isNull() | where_clause({"created_at": _bounds(dates)})) if dates else rest


def restricts_content(spec: Mapping[str, Any]) -> bool:
    """Whether a filter names a file type, at the top or under $and; keyword search is skipped then."""
    return "file_type" in spec or any("file_type" in part for part in spec.get("$and", ()))


def search_filter(folder_id: str, file_id: str | None = None, file_names: list[str] | None = None, detected: Mapping[str, Any] | None = None) -> dict[str, Any]:
    """The folder always; then a file, else named files, else what detection found."""
    spec: dict[str, Any] = {"folder_id": folder_id}
    if file_id:
        spec["file_id"] = file_id
    elif file_names:
        spec["file_name"] = file_names[0] if len(file_names) == 1 else {"$in": file_names}
    elif detected:
        spec |= dict(detected)
    return spec
