"""Trigram similarity of names, on expressions only (rows F33-F35)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from claimweave.functions.let import let

MATCH = 0.3
WORD_MATCH = 0.5


def ordered_trigrams(text: Column) -> Column:
    """Trigrams in order: words of letters and digits, each with two blanks before and one after."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.flatten(F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, F.lit(3)))))


def trigrams(text: Column) -> Column:
    return F.array_distinct(ordered_trigrams(text))


def set_similarity(a: Column, b: Column) -> Column:
    """Shared over all of two trigram sets."""
    share = lambda n: F.try_divide(n.cast("double"), (F.size(a) + F.size(b) - n).cast("double"))
    return F.coalesce(let(F.size(F.array_intersect(a, b)), share), F.lit(0.0))


def similarity(a: Column, b: Column) -> Column:
    """shared trigrams over all trigrams, 0 where there are none."""
    return set_similarity(trigrams(a), trigrams(b))


def word_similarity(query: Column, target: Column) -> Column:
    """the best similarity of the query to any contiguous extent of the target's ordered trigrams.

    The best extent begins and ends with a trigram of the query: others at its ends only make it larger. So only
    extents between such trigrams are tried.
    """
    pair = F.struct(trigrams(query).alias("q"), ordered_trigrams(target).alias("t"))

    def extents(p: Column) -> Column:
        places = F.transform(p["t"], lambda g, i: F.when(F.array_contains(p["q"], g), i + 1))
        return F.struct(p["q"].alias("q"), p["t"].alias("t"), F.filter(places, lambda i: i.isNotNull()).alias("at"))

    def best(p: Column) -> Column:
        extent = lambda a, b: let(F.array_distinct(F.slice(p["t"], a, b - a + 1)), lambda x: set_similarity(p["q"], x))
        tried = F.transform(p["at"], lambda a: F.transform(F.filter(p["at"], lambda b: b >= a), lambda b: extent(a, b)))
        return F.coalesce(F.array_max(F.flatten(tried)), F.lit(0.0))

    return let(let(pair, extents), best)
