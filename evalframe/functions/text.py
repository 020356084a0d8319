"""String column helpers with Python string semantics, all native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evalframe.functions.constants import PY_WHITESPACE


def col_of(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c) -> Column:
    """Python ``str.strip()``: drop every Unicode whitespace character at both ends.

    Spark's ``trim`` only removes blanks, so the full whitespace set is given.
    """
    return F.btrim(col_of(c), F.lit(PY_WHITESPACE))


def preview(c, n: int) -> Column:
    """First ``n`` characters plus ``...``, the ellipsis only when the text is longer."""
    c = col_of(c)
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def py_str(c) -> Column:
    """Render a value the way a Python f-string does: null becomes ``None``."""
    return F.coalesce(col_of(c).cast("string"), F.lit("None"))


def pct_string(num, den, signed: bool = False) -> Column:
    """``f"{num/den:.2%}"`` computed exactly from two integers.

    The percentage is rounded half up on the exact ratio, so the result does not
    depend on floating point formatting. ``den == 0`` gives ``0.00%``.
    """
    num = col_of(num).cast("long")
    den = col_of(den).cast("long")
    a = F.abs(num)
    # hundredths of a percent, rounded half up: floor((2*a*10000 + den) / (2*den))
    v = F.when(den == 0, F.lit(0)).otherwise(
        F.floor((a * 20000 + F.abs(den)) / (F.abs(den) * 2)).cast("long"))
    neg = (num < 0) != (den < 0)
    sign = F.when(neg & (v > 0), F.lit("-")).otherwise(F.lit("+") if signed else F.lit(""))
    return F.concat(sign, (v / 100).cast("long").cast("string"), F.lit("."),
                    F.lpad((v % 100).cast("string"), 2, "0"), F.lit("%"))
