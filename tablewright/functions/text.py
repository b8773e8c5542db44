"""Reading structured answers out of free text."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, functions as F, types as T


def strip_fence(text: Column) -> Column:
    """Remove a Markdown json fence around a reply, if it starts with one."""
    trimmed = F.trim(text)
    inner = F.regexp_replace(F.substring(trimmed, 8, 1 << 30), r"```$", "")
    whole = F.regexp_replace(inner, r"^\s+|\s+$", "")
    return F.when(trimmed.startswith("```json"), whole).otherwise(trimmed)


def json_object_text(text: Column) -> Column:
    """From the first opening to the last closing brace, or null."""
    return F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))


def json_object(text: Column, schema: str | T.StructType, required: Sequence[str] = ()) -> Column:
    """Parsed object; null when there is none, it is malformed, or a key is missing."""
    body = json_object_text(text)
    parsed = F.from_json(body, schema, {"mode": "PERMISSIVE"})
    # The JSON functions stop after the first value; as a one-element array all of it must parse.
    whole = F.json_array_length(F.concat(F.lit("["), body, F.lit("]"))) == 1
    keys = F.json_object_keys(F.when(whole, body))
    present = F.lit(True)
    for key in required:
        present = present & F.coalesce(F.array_contains(keys, key), F.lit(False))
    return F.when(keys.isNotNull() & present, parsed)
