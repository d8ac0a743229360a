"""String helpers for item labels and delimited lists."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip_first(value: Column, fragments: tuple[str, ...]) -> Column:
    """Remove only the first occurrence of any literal fragment."""
    if not fragments:
        return value
    pattern = "|".join(re.escape(f) for f in fragments)
    return F.regexp_replace(value, f"(?s)^(.*?)(?:{pattern})", "$1")


def sentence_case(value: Column) -> Column:
    """First letter upper case, all others lower case."""
    return F.concat(F.upper(F.substring(value, 1, 1)), F.lower(F.substr(value, F.lit(2))))


def list_length(value: Column, sep: str = ",") -> Column:
    """Number of entries in a delimited string; NULL stays NULL."""
    return F.regexp_count(value, F.lit(re.escape(sep))) + F.lit(1)


def split_capped(value: Column, max_items: int | None = None, sep: str = ",") -> Column:
    """Delimited string as an array of trimmed entries, all or the first ``max_items``."""
    pieces = F.split(value, re.escape(sep))
    if max_items is not None:
        pieces = F.slice(pieces, 1, max_items)
    return F.transform(pieces, lambda x: F.trim(x))


def p_text(p: Column) -> Column:
    """Report text of a probability: ``< 0.001`` or ``= `` and up to three decimals."""
    decimals = F.regexp_replace(F.round(p, 3).cast("string"), r"\.0$", "")
    return F.when(p < 0.001, F.lit("< 0.001")).when(p >= 0.001, F.concat(F.lit("= "), decimals))
