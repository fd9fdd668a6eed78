"""Rounding the way the published figures are rounded."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# 2**27 + 1: multiplying by it parts a double into two halves whose products are exact.
SPLITTER = 134_217_729.0


def round_to(col: Column | str, digits: int) -> Column:
    """Round the binary value, halves to even: 0.125 → 0.12, 1.275 (a little less) → 1.27, 9/40 → 0.23.

    The scaled value may itself be rounded, and then only onto a half that the true product misses.
    There the sign of the product's error, which two-part multiplication gives exactly, decides.
    """
    x = (F.col(col) if isinstance(col, str) else col).cast("double")
    scale = float(10**digits)
    p = x * scale
    high = x * SPLITTER - (x * SPLITTER - x)
    low = x - high
    scale_high = scale * SPLITTER - (scale * SPLITTER - scale)
    scale_low = scale - scale_high
    error = ((high * scale_high - p) + high * scale_low + low * scale_high) + low * scale_low
    half = (p - F.floor(p)) == 0.5
    nearest = F.when(half & (error > 0), F.ceil(p)).when(half & (error < 0), F.floor(p)).otherwise(F.rint(p))
    return nearest.cast("double") / scale
