"""Text expressions of entity names: accents, tokens, acronyms and character grams, as Spark columns."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

OUTER_SPACE = r"(?U)^\s+|\s+$"
ACRONYM_MOST = 12


@F.pandas_udf(T.StringType())
def _without_marks(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)))


def strip_accents(c: Column) -> Column:
    """Compatibility decomposition without combining marks; plain ASCII texts stay on the JVM."""
    return F.when(c.rlike(r"^\p{ASCII}*$"), c).otherwise(_without_marks(c))


def spell_symbols(c: Column) -> Column:
    return F.regexp_replace(c, "[&+]", " and ")


def folded(c: Column) -> Column:
    """Lower case, symbols spelt out, accents dropped: the form behind lengths, grams and acronym keys."""
    return strip_accents(spell_symbols(F.lower(c)))


def tokenize(c: Column) -> Column:
    """Lower-case alphanumeric tokens; a null name is an empty one."""
    s = strip_accents(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), OUTER_SPACE, ""))
    return F.array_remove(F.split(F.regexp_replace(spell_symbols(s), "[^a-z0-9]+", " "), " "), "")


def normal_form(c: Column) -> Column:
    """Tokens joined by spaces, or the folded name where it has none."""
    return F.coalesce(F.nullif(F.array_join(tokenize(c), " "), F.lit("")), strip_accents(F.lower(c)))


def initials(tokens: Column) -> Column:
    return F.array_join(F.transform(tokens, lambda t: F.substring(t, 1, 1)), "")


def acronym(tokens: Column, drop_and: bool = True) -> Column:
    """Upper-case initials; by default the letter sequence AND is taken out of them."""
    upper = F.upper(initials(tokens))
    return F.replace(upper, F.lit("AND"), F.lit("")) if drop_and else upper


def is_acronym_only(c: Column) -> Column:
    return F.regexp_replace(folded(c), "[^a-z0-9 ]+", "").rlike(f"^[a-z0-9]{{1,{ACRONYM_MOST}}}$")


def acronym_key(c: Column, drop_and: bool = True) -> Column:
    key = F.regexp_replace(folded(c), "[^a-z0-9]", "")
    return F.upper(F.replace(key, F.lit("and"), F.lit("")) if drop_and else key)


def char_grams(c: Column, least: int = 3, most: int = 5) -> Column:
    """All character grams of the lengths given, with repeats; shorter texts have none."""
    return F.flatten(F.transform(F.sequence(F.lit(least), F.lit(most)), lambda n: F.when(F.length(c) >= n, F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda at: F.substr(c, at, n))).otherwise(F.array().cast("array<string>"))))
