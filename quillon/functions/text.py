"""Text: folding, first lines, snippets, chunks, parties, places, currencies, JSON lists, entities."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_ACCENTED = "áàâãäåéèêëíìîïóòôõöúùûüçñýÿÁÀÂÃÄÅÉÈÊËÍÌÎÏÓÒÔÕÖÚÙÛÜÇÑÝ"
_PLAIN = "aaaaaaeeeeiiiiooooouuuucnyyAAAAAAEEEEIIIIOOOOOUUUUCNY"


def fold_accents(text: Column) -> Column:
    """Latin letters without their accents; other characters stay."""
    return F.translate(text, _ACCENTED, _PLAIN)


@F.pandas_udf(T.StringType())
def fold_nfkd(text: pd.Series) -> pd.Series:
    """Compatibility decomposition without combining marks, for all scripts."""
    return text.str.normalize("NFKD").str.replace(r"[̀-ͯ]", "", regex=True)


@F.pandas_udf(T.StringType())
def unescape_html(text: pd.Series) -> pd.Series:
    import html

    return text.map(html.unescape, na_action="ignore")


def strip(text: Column) -> Column:
    """Without white space of any kind at either end; F.trim takes spaces only."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def first_line(text: Column) -> Column:
    return F.trim(F.substring_index(F.regexp_replace(text, r"^\s+", ""), "\n", 1))


def snippet(text: Column, pattern: str, width: int = 120) -> Column:
    """The first match with `width` characters on either side, white space squeezed; null without one."""
    at = F.regexp_instr(text, F.lit(pattern))
    size = F.length(F.regexp_substr(text, F.lit(pattern)))
    start = F.greatest(at - width, F.lit(1))
    return F.when(at > 0, squeeze(F.substring(text, start, at - start + size + width)))


def tokens(text: Column) -> Column:
    """Distinct lower-case words."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != ""))


def token_jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union)


def chunks(text: Column, separator: str = r"(?m)^\s*\d+\s*[.)-]\s+") -> Column:
    """Numbered parts, trimmed, without empty and repeated ones, in their order."""
    return F.array_distinct(F.filter(F.transform(F.split(text, separator), strip), lambda c: c != ""))


def parties(text: Column, missing: Sequence[str] = ("-", "n/a", "")) -> Column:
    """Comma-separated names, trimmed, without marks for missing ones."""
    return F.filter(F.transform(F.split(text, ","), strip), lambda p: ~F.lower(p).isin(*missing))


#: Words that only a legal entity's name has.
ENTITY_WORDS = ("ltda", "s/?a", "eireli", "me", "epp", "company", "inc", "llc", "gmbh", "bank", "municipality", "association", "cooperative")


def natural_person(name: Column) -> Column:
    return ~name.rlike(rf"(?iU)\b({'|'.join(ENTITY_WORDS)})\b")


#: Rules for place names, in order.
PLACE_RULES = (
    (r"\s*\(.*?\)\s*", " "),
    (r"^(forum|court|district) (of|de|da|do) ", ""),
    (r"\b(st|sta|sto)\b\.?", "saint"),
    (r"\bmt\b\.?", "mount"),
    (r"['’`]", ""),
    (r"[^a-z0-9 ]+", " "),
    (r"\b0+(\d)", "$1"),
    (r"\b(the|of|de|da|do|dos|das)\b", " "),
    (r"\s+", " "),
    (r"^ | $", ""),
)


def normalize_place(name: Column) -> Column:
    out = F.lower(fold_accents(name))
    for pattern, new in PLACE_RULES:
        out = F.regexp_replace(out, pattern, new)
    return out


def currency(text: Column, missing: Sequence[str] = ("", "-", "n/a", "not informed")) -> Column:
    """1.234,56 with or without a currency sign as a double; null for marks of missing values and what isn't a number."""
    bare = F.trim(F.regexp_replace(F.lower(text), r"^(r\$|\$|eur|usd)\s*", ""))
    number = F.replace(F.replace(bare, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    return F.when(~bare.isin(*missing), number.try_cast("double"))


def json_strings(text: Column) -> Column:
    """A JSON list of strings as an array; invalid or null text as an empty one."""
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))


def latest_date(dates: Column, form: str = "dd/MM/yyyy") -> Column:
    """The latest date that can be read from an array of strings."""
    return F.array_max(F.transform(dates, lambda d: F.try_to_date(d, form)))


def parse_date(text: Column, form: str = "yyyyMMdd") -> Column:
    """A date; null for blank text, zeros and what isn't a date."""
    clean = F.trim(text)
    return F.when(~clean.isin("", "0", "00000000"), F.try_to_date(clean, form))


def first_rule(text: Column, rules: Sequence[tuple[str, str]], default: str) -> Column:
    """The label of the first (pattern, label) that matches anywhere, or the default."""
    out = F.lit(default)
    for pattern, label in reversed(rules):
        out = F.when(text.rlike(pattern), label).otherwise(out)
    return out
