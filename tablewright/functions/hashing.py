"""A row fraction in [0, 1) that any SQL engine can repeat."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, functions as F


def hash_fraction(key: Sequence[str] | str, seed: int = 42, digits: int = 8) -> Column:
    """Leading hex digits of md5('seed:key') as a fraction; independent of row order."""
    names = [key] if isinstance(key, str) else list(key)
    parts = [F.coalesce(F.col(f"`{n}`").cast("string"), F.lit("")) for n in names]
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.concat_ws("|", *parts)))
    return F.conv(F.substring(digest, 1, digits), 16, 10).cast("double") / F.lit(16.0**digits)
