"""Trade-code expressions: two dialects of cells that hold several codes."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the filter: wanted prefixes, header names in order of preference.
PREFIXES = ("03", "1604", "1605")
CODE_HEADERS = ("HSCode", "HS Code", "HS_Code", "HS", "HSCODE", "HTS", "HTSCode", "HTS Code")


def normalize_code(token: Column) -> Column:
    """Digits of a token, an odd length of 5, 7 or 9 padded with a leading zero; null unless 6, 8 or 10 digits result."""
    digits = F.regexp_replace(token, r"(?U)\D+", "")
    padded = F.when(F.length(digits).isin(5, 7, 9), F.concat(F.lit("0"), digits)).otherwise(digits)
    return F.when(F.length(padded).isin(6, 8, 10), padded)


def has_prefix(code: Column, prefixes: tuple[str, ...] = PREFIXES) -> Column:
    hit = F.lit(False)
    for p in prefixes:
        hit = hit | code.startswith(p)
    return hit


def stripped_tokens(cell: Column) -> Column:
    """The digits of each comma-separated token; an array of its own, so that each token is stripped once."""
    return F.transform(F.split(cell, ","), lambda t: F.regexp_replace(t, r"(?U)\D+", ""))


def stripped_pattern(prefixes: tuple[str, ...]) -> str:
    """A pattern of stripped tokens that normalise to a code with one of the prefixes: 6, 8 or 10 digits, or an odd 5, 7 or 9 that lack the leading zero."""
    even = "|".join(re.escape(p) for p in prefixes)
    odd = [re.escape(p[1:]) for p in prefixes if p[:1] in ("", "0")]
    padded = rf"|(?=(?:.{{5}}|.{{7}}|.{{9}})$)(?:{'|'.join(odd)})" if odd else ""
    return rf"^(?:(?=(?:.{{6}}|.{{8}}|.{{10}})$)(?:{even}){padded})"


def comma_cell_matches(cell: Column, prefixes: tuple[str, ...] = PREFIXES) -> Column:
    """Some comma-separated token normalises to a code with a wanted prefix; null cells don't match."""
    return F.coalesce(F.exists(stripped_tokens(cell), lambda t: t.rlike(stripped_pattern(prefixes))), F.lit(False)) if prefixes else F.lit(False)


def clean_semicolon_cell(cell: Column, repair: bool = True) -> Column:
    """Outer white space and dots removed; with `repair`, a cell that begins with 3 gets a zero before it."""
    text = F.replace(F.regexp_replace(cell, r"(?U)^\s+|\s+$", ""), F.lit("."), F.lit(""))
    return F.when(text.startswith("3"), F.concat(F.lit("0"), text)).otherwise(text) if repair else text


def semicolon_cell_matches(cleaned: Column, prefixes: tuple[str, ...] = PREFIXES) -> Column:
    """Some semicolon-separated code of a cleaned cell begins with a wanted prefix, whatever its length."""
    return F.coalesce(F.exists(F.split(cleaned, ";"), lambda t: has_prefix(F.regexp_replace(t, r"(?U)^\s+|\s+$", ""), prefixes)), F.lit(False))


def has_code(cell: Column) -> Column:
    """Some comma-separated token is a well-formed code: 5 to 10 digits, the odd lengths being padded."""
    return F.exists(stripped_tokens(cell), lambda t: F.length(t).between(5, 10))
