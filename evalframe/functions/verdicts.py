"""Verdict parsing, gold-label normalisation and label scoring as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalframe.functions.constants import (GOLD_POSITIVE, NEGATIVE, POSITIVE,
                                           VERDICT_NEGATIVE_CUES,
                                           VERDICT_POSITIVE_CUES)
from evalframe.functions.text import col_of, py_strip


def _any_contains(c: Column, cues) -> Column:
    return reduce(lambda a, b: a | b, [c.contains(x) for x in cues])


def parse_verdict(response) -> Column:
    """Free-text reply -> SUPPORTED / NOT_SUPPORTED.

    Upper-case, turn each single blank and '-' into '_', then negative cues win,
    positive cues next, anything else is negative. Two blanks stay two
    underscores, so ``NOT  SUPPORTED`` reads positive (kept on purpose).
    A null reply reads as empty (negative).
    """
    norm = F.translate(F.upper(F.coalesce(col_of(response), F.lit(""))), " -", "__")
    return (F.when(_any_contains(norm, VERDICT_NEGATIVE_CUES), F.lit(NEGATIVE))
             .when(_any_contains(norm, VERDICT_POSITIVE_CUES), F.lit(POSITIVE))
             .otherwise(F.lit(NEGATIVE)))


def normalize_gold(label, dtype: T.DataType | None = None) -> Column:
    """Raw gold label -> SUPPORTED / NOT_SUPPORTED.

    Strings: a digit string is a number ("0", "00" -> positive, other digits ->
    negative); otherwise strip + upper + ' '->'_' and a synonym list decides,
    unknown text is negative. Numbers and booleans: integer truncation, 0 is
    positive (0.9 -> positive, True -> negative). Null -> negative.
    Only ASCII digits count as digits.
    """
    c = col_of(label)
    if dtype is not None and not isinstance(dtype, T.StringType):
        return F.when(c.isNull(), F.lit(NEGATIVE)).when(
            c.cast("long") == 0, F.lit(POSITIVE)).otherwise(F.lit(NEGATIVE))
    s = py_strip(c)
    norm = F.replace(F.upper(s), F.lit(" "), F.lit("_"))
    return (F.when(c.isNull(), F.lit(NEGATIVE))
             .when(s.rlike("^0+$"), F.lit(POSITIVE))
             .when(s.rlike("^[0-9]+$"), F.lit(NEGATIVE))
             .when(norm.isin(*GOLD_POSITIVE), F.lit(POSITIVE))
             .otherwise(F.lit(NEGATIVE)))


def label_match(predicted, gold) -> Column:
    """Trimmed, upper-cased equality of two labels (null never matches)."""
    p = F.upper(py_strip(col_of(predicted)))
    g = F.upper(py_strip(col_of(gold).cast("string")))
    return F.coalesce(p == g, F.lit(False))
