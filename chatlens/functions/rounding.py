"""Percentages to one decimal place, in the two roundings the results use."""

from pyspark.sql import functions as F

_BITS = 59


def percent(part, whole):
    """part / whole * 100 as double; NULL when whole is 0."""
    return F.try_divide(part, whole) * F.lit(100.0)


def tenths_scaled(x):
    """Scale by ten, round half to even, scale back (array-style rounding)."""
    return F.rint(x * F.lit(10.0)) / F.lit(10.0)


def tenths_exact(x):
    """Round a non-negative double by its exact binary value (scalar-style rounding).

    12.35 is stored slightly below 12.35 and gives 12.3, where rounding its
    decimal text gives 12.4. The fraction is scaled by a power of two, which is
    exact, and rounded in integers.
    """
    whole = F.floor(x)
    scaled = ((x - whole) * F.lit(float(1 << _BITS))).cast("long") * F.lit(10)
    tenth = F.shiftright(scaled, _BITS)
    rest = scaled.bitwiseAND(F.lit((1 << _BITS) - 1))
    half = F.lit(1 << (_BITS - 1))
    up = (rest > half) | ((rest == half) & (tenth.bitwiseAND(F.lit(1)) == 1))
    return (whole * 10 + tenth + up.cast("long")) / F.lit(10.0)
