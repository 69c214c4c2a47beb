"""Rounding and shares."""

from pyspark.sql import functions as F


def round_half_even(col, digits):
    """Round as numpy does: scale, nearest integer with ties to even, unscale."""
    scale = float(10**digits)
    return F.rint(col * F.lit(scale)) / F.lit(scale)


def percent(part, whole, digits):
    """``part`` of ``whole`` in percent; 0 when the whole is 0."""
    ratio = part.cast("double") / F.nullif(whole, F.lit(0)).cast("double") * F.lit(100.0)
    return F.coalesce(round_half_even(ratio, digits), F.lit(0.0))
