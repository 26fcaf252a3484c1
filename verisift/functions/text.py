"""Scalar text expressions; the SQL twins are for DuckDB."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize(c: Column | str) -> Column:
    """Lower case without white space of any kind at the ends."""
    return F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))


def normalize_sql(x: str) -> str:
    return rf"lower(regexp_replace({x}, '^\s+|\s+$', '', 'g'))"


def claim_hash(c: Column | str) -> Column:
    return F.sha2(normalize(c), 256)


def hash_sql(x: str) -> str:
    return f"sha256({normalize_sql(x)})"


def not_empty(c: str) -> Column:
    return F.when(F.col(c) != "", F.col(c))


def fence_strip(c: Column | str) -> Column:
    """Text without a Markdown fence around it."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"(?i)^\s*```(json)?\s*", ""), r"\s*```\s*$", ""))


def bracket_span(c: Column | str) -> Column:
    """The first array or object in a text, from its opening to the last closing bracket."""
    return F.regexp_extract(c, r"(?s)(\[.*\]|\{.*\})", 1)


#: Wrongly decoded sequences and their replacements, applied in this order.
MOJIBAKE = (
    ("\u00e2\u20ac\u201d", "\u2014"), ("\u00e2\u20ac\u2122", "'"), ("\u00e2\u20ac\u0153", '"'), ("\u00e2\u20ac\u009d", '"'), ("\u00e2\u20ac\u201c", " - "),
    ("\u00c2\u00b7", "\u00b7"), ("\u00c2\u00a0", " "), ("\u00c2", ""),
    ("\u00e2\u0080\u0099", "'"), ("\u00e2\u0080\u009c", '"'), ("\u00e2\u0080\u009d", '"'), ("\u00e2\u0080\u0094", "\u2014"), ("\u00e2\u0080\u0093", "\u2013"),
    ("\u00e2\u20ac", '"'),
)


def mojibake_fix(c: Column | str) -> Column:
    out = F.col(c) if isinstance(c, str) else c
    for bad, good in MOJIBAKE:
        out = F.replace(out, F.lit(bad), F.lit(good))
    return out


def strip_block(c: Column | str, tag: str) -> Column:
    return F.regexp_replace(c, rf"(?s)<{tag}.*?</{tag}>", "")


def fence_slice(c: Column | str) -> Column:
    """Text without a fence, cut off by its length at both ends."""
    c = F.trim(F.col(c) if isinstance(c, str) else c)
    cut = lambda n: F.trim(F.substring(c, F.lit(n + 1), F.greatest(F.length(c) - F.lit(n + 3), F.lit(0))))
    return F.when(c.startswith("```json"), cut(7)).when(c.startswith("```"), cut(3)).otherwise(c)


def fence_split(c: Column | str) -> Column:
    """What stands in the first fence of a text, or the text where it has none."""
    c = F.col(c) if isinstance(c, str) else c
    part = lambda mark: F.trim(F.split_part(F.split_part(c, F.lit(mark), F.lit(2)), F.lit("```"), F.lit(1)))
    return F.when(F.contains(c, F.lit("```json")), part("```json")).when(F.contains(c, F.lit("```")), part("```")).otherwise(F.trim(c))
