"""Text and name functions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def fold(name: Column) -> Column:
    """Lower case, everything but letters and digits as single spaces, trimmed."""
    return F.trim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", " "))


def named(name: Column, placeholders: tuple[str, ...] = ("unknown", "n/a", "none", "-")) -> Column:
    """Null where the name is a placeholder."""
    return F.when(~F.lower(F.trim(name)).isin(*placeholders) & (F.trim(name) != ""), name)


def similarity(a: Column, b: Column, close: int = 1) -> Column:
    """Share of the shorter name's words that have a word within ``close`` edits in the longer; empty names give 0."""
    words = lambda c: F.filter(F.split(fold(c), " "), lambda w: w != "")
    x, y = words(a), words(b)
    short = F.when(F.size(x) <= F.size(y), x).otherwise(y)
    long = F.when(F.size(x) <= F.size(y), y).otherwise(x)
    hits = F.size(F.filter(short, lambda w: F.exists(long, lambda v: F.levenshtein(w, v) <= close)))
    return F.when((F.size(short) == 0) | (F.size(long) == 0), 0.0).otherwise(hits / F.size(short))


def person_key(name: Column) -> Column:
    """A name's words, folded, without generation suffixes, in alphabetical order."""
    words = F.filter(F.split(fold(name), " "), lambda w: (w != "") & ~w.isin("jr", "sr", "ii", "iii", "iv"))
    return F.array_join(F.array_sort(words), " ")


def public_id(kind: str, n: Column) -> Column:
    """A short public id of an internal number: the kind's letter and the number, mixed by an invertible step, in base 36."""
    return F.concat(F.lit(kind), F.lower(F.conv(((n * 7919 + 104729) % 2147483647).cast("string"), 10, 36)))
