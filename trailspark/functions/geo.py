"""Lenient numeric parsing and rounding for coordinates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trailspark.functions.text import ustrip


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# Fixed value: the literal syntax Python's float() accepts (digit-group
# underscores excepted, see README).
PY_FLOAT = r"(?i)^[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf|infinity|nan)$"


def lenient_double(c) -> Column:
    """``float(str(v).strip())`` or null.

    ``try_cast`` never raises under ANSI mode.  'nan'/'inf' parse (as in
    Python) and are removed by :func:`valid_coordinate`.
    """
    s = ustrip(_col(c).cast("string"))
    # Python's float() syntax (Java's parser would also take '1d', '0x1p3', ...)
    ok = s.rlike(PY_FLOAT)
    return F.when(ok, s.try_cast("double"))


def valid_coordinate(c) -> Column:
    """True for a finite, non-null number (NaN counts as missing)."""
    x = _col(c)
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


_SPLIT = 134217729.0  # 2**27 + 1, Veltkamp splitting constant (fixed value)


def _scaled_rint(x: Column, scale: float) -> Column:
    """Integer nearest to the *exact* product ``x * scale``, ties to even.

    ``x * scale`` in floating point can land exactly on a .5 tie although the
    exact product lies just above or below it (e.g. -73.105 * 100); Python's
    ``round`` decides on the exact value.  The rounding error of the product
    is recovered exactly (Dekker's two-product with Veltkamp splitting, plain
    double arithmetic) and breaks such false ties.
    """
    p = x * scale
    c = x * _SPLIT
    hi = c - (c - x)
    lo = x - hi
    err = (hi * scale - p) + lo * scale      # scale is a power of ten <= 1e8: exact split
    tie = (p - F.floor(p)) == 0.5
    return (F.when(tie & (err > 0), F.ceil(p).cast("double"))
             .when(tie & (err < 0), F.floor(p).cast("double"))
             .otherwise(F.rint(p)))


def round_half_even(c, decimals: int = 2) -> Column:
    """Python/pandas ``round(x, decimals)``: correctly rounded, ties to even.

    Spark's ``round`` is half-up (0.125 -> 0.13) and ``bround`` rounds the
    shortest decimal string of the double (2.675 -> 2.68, Python gives
    2.67); this rounds the exact binary value like Python does.
    """
    scale = float(10 ** decimals)
    x = _col(c)
    return _scaled_rint(x, scale) / scale if decimals else F.rint(x)


def rounded_key(c, decimals: int = 2) -> Column:
    """Integral join key for a rounded coordinate (exact equality on longs)."""
    return _scaled_rint(_col(c), float(10 ** decimals)).cast("long")
