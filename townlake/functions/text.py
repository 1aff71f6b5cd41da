"""Keys for matching names and numbers, and trigram similarity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def name_key(text: Column) -> Column:
    """Lower-case letters and digits only, of any alphabet, so that punctuation can't part names."""
    return F.nullif(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", ""), F.lit(""))


def number_key(text: Column) -> Column:
    """The first number of a range and its letter, without leading zeros."""
    found = F.regexp_extract(F.lower(text), r"0*([1-9][0-9]*)\s*(\p{L}?)", 0)
    return F.nullif(F.regexp_replace(F.regexp_replace(found, r"\s+", ""), "^0+", ""), F.lit(""))


def first_part(text: Column, separator: str) -> Column:
    return F.split_part(text, F.lit(separator), F.lit(1))


def trigrams(text: Column) -> Column:
    """The distinct runs of three characters of each word, with two blanks before and one after."""
    words = F.filter(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != "")

    def of_word(word: Column) -> Column:
        padded = F.concat(F.lit("  "), word, F.lit(" "))
        return F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substring(padded, i, F.lit(3)))

    return F.array_distinct(F.flatten(F.transform(words, of_word)))


def similarity(a: Column, b: Column) -> Column:
    """Shared trigrams as a part of all of two trigram arrays."""
    return F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_union(a, b)).cast("double"), F.lit(0.0))
