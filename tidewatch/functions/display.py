"""Numbers as display text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Splits a DOUBLE into two halves of 26 bits, whose products with 100 are exact.
_SPLIT = float(2**27 + 1)


def two_decimals(x: Column) -> Column:
    """Text with two decimals, rounded by the exact binary value and half to even, as C does.

    NULL stays NULL; values may reach 10^13. The product with 100 is itself rounded, so its exact distance from the
    whole number beside it decides.
    """
    high = x * _SPLIT - (x * _SPLIT - x)
    whole = F.rint(x * 100.0)
    most, rest = high * 100.0 - whole, (x - high) * 100.0
    nearest = whole + F.when((most - 0.5) + rest > 0, 1.0).when((most + 0.5) + rest < 0, -1.0).otherwise(0.0)
    return F.when(x.isNotNull(), F.format_string("%.2f", nearest / 100.0))
