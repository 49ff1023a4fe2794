"""Transcription metrics as Column expressions (code points, unit costs)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions import text as T


def distance(a: Column, b: Column) -> Column:
    """Levenshtein distance; equal strings skip the table."""
    return F.when(a == b, 0).otherwise(F.levenshtein(a, b))


Edits = Callable[[Column, Column], Column]


def cer_plain(pred: Column, gold: Column, edits: Edits = distance) -> Column:
    """Distance over the gold's length, unbounded above; an empty gold gives 0 for an empty prediction, else 1."""
    empty = F.when(F.length(pred) == 0, 0.0).otherwise(1.0)
    return F.when(F.length(gold) == 0, empty).otherwise(edits(pred, gold) / F.length(gold))


def nls_plain(pred: Column, gold: Column, edits: Edits = distance) -> Column:
    longest = F.greatest(F.length(pred), F.length(gold))
    return F.when(longest == 0, 1.0).otherwise(1 - edits(pred, gold) / longest)


def cer(pred: Column, gold: Column, edits: Edits = distance) -> Column:
    return cer_plain(T.collapse(pred), T.collapse(gold), edits)


def nls(pred: Column, gold: Column, edits: Edits = distance) -> Column:
    return nls_plain(T.collapse(pred), T.collapse(gold), edits)


def exact(pred: Column, gold: Column) -> Column:
    return T.collapse(pred) == T.collapse(gold)


def cer_stripped(pred: Column, gold: Column, edits: Edits = distance) -> Column:
    return cer_plain(T.strip_square(pred), T.strip_square(gold), edits)


def word_f1(pred: Column, gold: Column) -> Column:
    """F1 over distinct words; two empty sets agree."""
    p, g = F.array_distinct(T.words(pred)), F.array_distinct(T.words(gold))
    both = F.size(p) + F.size(g)
    return F.when(both == 0, 1.0).otherwise(2 * F.size(F.array_intersect(p, g)) / both)


def mean_or_nan(c: Column) -> Column:
    return F.coalesce(F.avg(c), F.lit(float("nan")))


def mean_or_zero(c: Column) -> Column:
    return F.coalesce(F.sum(c), F.lit(0.0)) / F.greatest(F.lit(1), F.count(c))


def sample_std(c: Column) -> Column:
    """0 for one value or none."""
    return F.coalesce(F.stddev_samp(c), F.lit(0.0))
