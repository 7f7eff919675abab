"""Reading models' replies: JSON that is fenced, surrounded, cut off or left open."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def repaired(text: str | None) -> str | None:
    """The first JSON object of a reply, closed where it was cut; null if there is no brace.

    A fence around it does not matter. Brackets are counted outside of strings until
    the object ends; if the reply ends first, an open string is closed, a value or
    key that is not whole goes, and every open bracket is closed.
    """
    start = (text or "").find("{")
    if start < 0:
        return None
    open_, inside, escaped, whole = [], False, False, start + 1
    keep: list[str] = []
    for at in range(start, len(text)):
        c = text[at]
        if inside:
            if escaped:
                escaped = False
            elif c == "\\":
                escaped = True
            elif c == '"':
                inside = False
            continue
        if c == '"':
            inside = True
        elif c in "{[":
            open_.append("}" if c == "{" else "]")
            whole, keep = at + 1, list(open_)
        elif c in "}]":
            if not open_ or open_[-1] != c:
                break
            open_.pop()
            whole, keep = at + 1, list(open_)
            if not open_:
                return text[start:whole]
        elif c == ",":
            whole, keep = at, list(open_)
        elif c == "`":
            break
    rest = text[whole:].split("```")[0].strip().lstrip(",").strip()
    tail = _whole_item(rest, bool(keep) and keep[-1] == "}")
    return text[start:whole] + (("," if text[whole - 1] not in "{[" and tail else "") + tail) + "".join(reversed(keep))


def _whole_item(rest: str, member: bool) -> str:
    """The first value, or name and value, of what is left behind the last comma, if it is whole; else nothing."""
    decoder, at = json.JSONDecoder(), 0
    try:
        if member:
            _, at = decoder.raw_decode(rest)
            colon = re.compile(r"\s*:\s*").match(rest, at)
            if not colon:
                return ""
            at = colon.end()
        return rest[: decoder.raw_decode(rest, at)[1]]
    except ValueError:
        return ""


def repaired_json(text) -> Column:
    """Over Arrow: the count of brackets is a state along the text, which no expression has."""
    return F.udf(repaired, "string", useArrow=True)(text)
