"""Splitting at added tokens, before any other stage."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def _quoted(text: str) -> str:
    return re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", text)


def segment(c: Column, markers: list[str]) -> Column:
    """array<struct<piece, is_added>>: markers (longest first) and the spans between them, in order."""
    if not markers:
        return F.array(F.struct(c.alias("piece"), F.lit(False).alias("is_added")))
    any_marker = "|".join(map(_quoted, markers))
    found = F.regexp_extract_all(c, F.lit(f"(?s)(?:{any_marker})|.+?(?=(?:{any_marker})|\\z)"), F.lit(0))
    known = F.array(*[F.lit(m) for m in markers])
    pieces = F.transform(found, lambda p: F.struct(p.alias("piece"), F.array_contains(known, p).alias("is_added")))
    return F.when(c == "", F.array(F.struct(c.alias("piece"), F.lit(False).alias("is_added")))).otherwise(pieces)
