"""Names folded to what tells firms apart."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab as V
from .cleaning import once, quoted, strip_parens


def _strip_tail(c: Column, words: list[str]) -> Column:
    """Take words off the end until none is left, the longest that fits first, never the whole text. The lazy head makes the tail as long as possible; a text has
    fewer words at its end than characters."""
    pattern = f"^(.+?)(?:{quoted(words)})$"
    less = lambda t, _: F.regexp_replace(t, pattern, "$1")
    return once(c, lambda x: F.when(x.rlike(pattern), F.aggregate(F.sequence(F.lit(2), F.length(x)), x, less)).otherwise(x))


def _or_nothing(c: Column) -> Column:
    return once(c, lambda x: F.when(x.isin(*dict.fromkeys([*V.REGIONS, *V.GENERIC])), F.lit("")).otherwise(x))


def collapse_generic(clean: Column) -> Column:
    """The distinctive part of a cleaned name: no bracketed parts, no generic words at the end; empty if a region or generic word is left."""
    return _or_nothing(_strip_tail(strip_parens(clean), V.GENERIC))


def collapse_industry(folded: Column) -> Column:
    """A folded name without lines of business at its end."""
    return _or_nothing(_strip_tail(folded, V.INDUSTRIES))


def protected_in(clean: Column) -> Column:
    """Protected names in a cleaned name, in fixed order, joined by commas."""
    return once(clean, lambda x: F.concat_ws(",", *(F.when(F.contains(x, F.lit(w)), F.lit(w)) for w in V.PROTECTED)))
