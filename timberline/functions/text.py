"""Column expressions on log text: masks, tokens, template ids, token splitting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WILDCARD = "<*>"


def mask(text: Column, masks: list[tuple[str, str]]) -> Column:
    """Replace parameters by wildcards: an ordered fold of (pattern, replacement)."""
    for pattern, replacement in masks:
        text = F.regexp_replace(text, pattern, replacement)
    return text


def tokens(text: Column) -> Column:
    """Words of a text; trailing blanks stay on the last one, since they count in a template's id."""
    body = F.regexp_replace(text, r"^(?U)\s+", "")
    tail = F.regexp_extract(body, r"(?U)(\s*)$", 1)
    words = F.split(F.regexp_replace(body, r"(?U)\s+$", ""), r"(?U)\s+")
    glued = F.concat(F.slice(words, F.lit(1), F.size(words) - 1), F.array(F.concat(F.element_at(words, -1), tail)))
    return F.when(F.regexp_replace(text, r"(?U)\s+", "") == "", F.array().cast("array<string>")).otherwise(glued)


def template_id(template: Column) -> Column:
    """The first eight hex digits of the MD5 of a template."""
    return F.substring(F.md5(template), 1, 8)


def split_apart(text: Column, left: list[str], right: list[str]) -> Column:
    """A blank behind each match of ``left`` and before each of ``right``."""
    for p in left:
        text = F.regexp_replace(text, f"({p})", "$1 ")
    for p in right:
        text = F.regexp_replace(text, f"({p})", " $1")
    return text


def parameters(content: Column, template: Column) -> Column:
    """Words of the content where the template's word holds a wildcard; null if the numbers of words differ."""
    a, b = F.split(F.trim(content), r"(?U)\s+"), F.split(F.trim(template), r"(?U)\s+")
    pairs = F.filter(F.arrays_zip(a.alias("c"), b.alias("t")), lambda x: F.contains(x["t"], F.lit(WILDCARD)))
    return F.when(F.size(a) == F.size(b), F.transform(pairs, lambda x: x["c"]))
