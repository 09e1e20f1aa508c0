"""Name cleaning as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import vocab as V

INVISIBLE_CLASS = "[" + "".join(f"\\x{{{a:x}}}" if a == b else f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in V.INVISIBLE) + "]"
_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + V.WIDE_MARKS
_NARROW = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)) + V.NARROW_MARKS


def once(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, whatever the number of references."""
    return F.transform(F.array(value), body)[0]


def strip_invisible(c: Column) -> Column:
    return F.regexp_replace(c, INVISIBLE_CLASS, "")


def has_invisible(c: Column) -> Column:
    return c.rlike(INVISIBLE_CLASS)


def to_halfwidth(c: Column) -> Column:
    return F.translate(c, _WIDE, _NARROW)


def clean_name(c: Column) -> Column:
    """No invisible characters, half-width marks, no spaces, upper case; null becomes empty."""
    return F.upper(F.replace(to_halfwidth(strip_invisible(F.coalesce(c, F.lit("")))), F.lit(" ")))


def strip_punct(c: Column) -> Column:
    return F.translate(c, V.PUNCTUATION, "")


def strip_parens(c: Column) -> Column:
    """Innermost bracketed parts, once."""
    return F.regexp_replace(c, r"\([^()]*\)", "")


def core_name(c: Column) -> Column:
    return strip_punct(clean_name(c))


def raw_name(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def lenient_number(c: Column) -> Column:
    """A number written with or without separators; 0 for anything else."""
    return F.coalesce(F.trim(F.replace(c.cast("string"), F.lit(","))).try_cast("double"), F.lit(0.0))


def add_clean_columns(df: DataFrame, name: str) -> DataFrame:
    """``name_clean`` and ``name_core`` beside the untouched name; a suffix of underscores where they exist."""
    clean, core = (f"name_{x}" for x in ("clean", "core"))
    while {clean, core} & set(df.columns):
        clean, core = clean + "_", core + "_"
    return df.withColumn(clean, clean_name(F.col(name).cast("string"))).withColumn(core, strip_punct(F.col(clean)))


def unicode_report(c: Column) -> Column:
    """Length, code points, whether white space surrounds the text, places, code points and names of invisible characters, whether there is more than ASCII,
    and the category letter of every character."""
    chars = F.filter(F.split(c, ""), lambda x: x != "")
    point = lambda x: F.concat(F.lit("U+"), F.lpad(F.hex(F.conv(F.hex(F.encode(x, "UTF-32")), 16, 10).cast("long")), 4, "0"))
    kinds = [("L", r"^\p{L}"), ("M", r"^\p{M}"), ("N", r"^\p{N}"), ("P", r"^\p{P}"), ("S", r"^\p{S}"), ("Z", r"^\p{Z}")]

    def kind(x: Column) -> Column:
        out = F.lit("C")
        for letter, pattern in reversed(kinds):
            out = F.when(x.rlike(pattern), letter).otherwise(out)
        return out

    def meaning(x: Column) -> Column:
        out = F.lit("")
        for code, name in V.MEANINGS.items():
            out = F.when(x == chr(code), name).otherwise(out)
        return out

    places = F.filter(F.transform(chars, lambda x, i: F.when(has_invisible(x) | x.rlike(r"^[\p{Cc}\p{Cf}\x{20}]"), F.struct(i.alias("place"), point(x).alias("point"), meaning(x).alias("meaning")))), lambda s: s.isNotNull())
    return F.struct(
        F.length(c).alias("length"), F.array_join(F.transform(chars, point), " ").alias("codepoints"), (c.rlike(r"(?U)^\s|\s$")).alias("surrounded"),
        places.alias("invisibles"), c.rlike(r"[^\x00-\x7F]").alias("non_ascii"), F.array_join(F.transform(chars, kind), "").alias("categories"),
    )


def quoted(words: list[str]) -> str:
    """An alternation of words, the longest first."""
    return "|".join(re.escape(w) for w in sorted(words, key=len, reverse=True))
