"""Similarity signals between an entry and a candidate, as Column expressions.

Only the sequence ratio needs Python; it runs as one Arrow UDF over pairs whose titles differ.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from refaudit.functions import text


@F.pandas_udf(T.DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    def one(x: str | None, y: str | None) -> float | None:
        return None if x is None or y is None else SequenceMatcher(None, x, y).ratio()

    return pd.Series([one(x, y) for x, y in zip(a, b)], dtype="float64")


def tokens(normal: Column) -> Column:
    return F.array_distinct(F.array_remove(F.split(normal, " "), ""))


def jaccard(a: Column, b: Column, both: Column | None = None) -> Column:
    """Shared part of two sets; null if either is empty. ``both`` is the size of their intersection,
    where that is known."""
    both = F.size(F.array_intersect(a, b)) if both is None else both
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both / (F.size(a) + F.size(b) - both))


def containment(a: Column, b: Column) -> Column:
    """Length share of the shorter text if it is part of the longer, has four words or more and
    at least 0.65 of its length; else 0."""
    short = F.when(F.length(a) <= F.length(b), a).otherwise(b)
    long = F.when(F.length(a) <= F.length(b), b).otherwise(a)
    share = F.try_divide(F.length(short), F.length(long))
    return F.when(long.contains(short) & (F.size(F.split(short, " ")) >= 4) & (share >= 0.65), share).otherwise(0.0)


def _best(a: Column, b: Column, parts: list[Column], ratio: bool) -> Column:
    """The best of ``parts`` and, if asked for, the sequence ratio. The ratio is at most the share of
    the shorter text; it is computed only where it can be the best."""
    best = F.greatest(*parts)
    if not ratio:
        return best
    most = F.try_divide(2 * F.least(F.length(a), F.length(b)), F.length(a) + F.length(b))
    asked = (a != b) & (a != "") & (b != "") & (most > best)
    return F.greatest(best, F.coalesce(_ratio(F.when(asked, a), F.when(asked, b)), F.lit(0.0)))


def title(a: Column, b: Column, ratio: bool = True, overlap: Column | None = None) -> Column:
    """Similarity of two normalized titles: the best of sequence ratio, word overlap and
    containment; 0 if either is empty, 1 if they are equal. ``overlap`` is the word overlap of titles
    that differ, where that is known."""
    overlap = jaccard(tokens(a), tokens(b)) if overlap is None else overlap
    best = _best(a, b, [F.coalesce(overlap, F.lit(0.0)), containment(a, b)], ratio)
    return F.when((a == "") | (b == ""), 0.0).when(a == b, 1.0).otherwise(best)


def loose_title(a: Column, b: Column, threshold: float = 0.85, ratio: bool = True) -> Column:
    """Whether two comparable titles agree: overlap, ratio or 0.95 of plain containment."""
    short = F.when(F.length(a) <= F.length(b), a).otherwise(b)
    long = F.when(F.length(a) <= F.length(b), b).otherwise(a)
    part = F.when(long.contains(short), F.try_divide(F.length(short), F.length(long)) * 0.95).otherwise(0.0)
    best = _best(a, b, [part, F.coalesce(jaccard(tokens(a), tokens(b)), F.lit(0.0))], ratio)
    return F.when((a == "") | (b == ""), False).when(a == b, True).otherwise(best >= threshold)


def families(authors: Column, norm=text.normalize) -> Column:
    """The set of family names of an author field; empty parts are left out.

    The separators are spaced words and semicolons; each family is normalized after the split, in
    one pass over a joined text.
    """
    parts = F.filter(F.split(F.coalesce(authors, F.lit("")), r"(?i)\s+and\s+|\s*;\s*"), lambda p: F.trim(p) != "")
    family = F.transform(parts, lambda p: F.when(p.contains(","), F.substring_index(p, ",", 1)).otherwise(F.regexp_extract(F.rtrim(p), r"(?<!\S)(\S++)$", 1)))
    joined = F.array_join(F.transform(family, lambda f: F.replace(f, F.lit("\u0001"), F.lit(" "))), "_\u0001_")
    # the separator survives normalization as an underscore pair with a blank between
    return F.array_distinct(F.array_remove(F.transform(F.split(norm(joined), "_ _"), lambda f: F.trim(f)), ""))


def year(a: Column, b: Column) -> Column:
    """:func:`years` of two texts."""
    return years(text.year(a), text.year(b))


def years(a: Column, b: Column) -> Column:
    """1 for the same year, 0.65 for neighbours, else 0; null unless both are known."""
    delta = F.abs(a - b)
    return F.when(delta == 0, 1.0).when(delta == 1, 0.65).when(delta.isNotNull(), 0.0)


def pages(a: Column, b: Column, norm=text.normalize) -> Column:
    return F.when((F.coalesce(a, F.lit("")) != "") & (F.coalesce(b, F.lit("")) != ""), (norm(a) == norm(b)).cast("double"))


def identifiers(a: Column | dict[str, Column], b: Column | dict[str, Column]) -> Column:
    """struct(shared, conflicting): names of the identifiers that both sides have."""
    names = ("doi", "pmid", "pmcid", "arxiv")
    both = lambda n: (a[n] != "") & (b[n] != "")
    shared = F.array_compact(F.array(*[F.when(both(n) & (a[n] == b[n]), F.lit(n)) for n in names]))
    other = F.array_compact(F.array(*[F.when(both(n) & (a[n] != b[n]), F.lit(n)) for n in names]))
    return F.struct(shared.alias("shared"), other.alias("conflicting"))
