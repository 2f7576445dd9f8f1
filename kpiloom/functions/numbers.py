"""Guarded ratios, whole numbers and percent text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(part: Column, whole_: Column) -> Column:
    """``part / whole_`` as double; 0 when the divisor is 0."""
    return F.coalesce(F.try_divide(part.cast("double"), whole_.cast("double")), F.lit(0.0))


def whole(value: Column) -> Column:
    """Drop the fraction, toward zero."""
    return value.cast("bigint")


def percent_text(share: Column, decimals: int) -> Column:
    """A share of at least 0 as percent text with 0 or 2 decimals.

    Ties go to even, on the exact binary value: 1/8 gives 12%, and 1/4000 gives 0.03%
    since that double lies above 0.025. Formatting functions round half up on the
    shortest decimal form instead, so the digits are worked out first.
    """
    percent = share * F.lit(100.0)
    if decimals == 0:
        # Ties at k + 0.5 are exact in binary.
        return F.concat(whole(F.rint(percent)).cast("string"), F.lit("%"))
    if decimals != 2:
        raise ValueError("percent text has 0 or 2 decimals")
    # `half` counts half steps of 0.01. An even count is next to a whole step; an odd one
    # lies beside a tie, and the sign of 200*percent - half says on which side. Summed
    # as 128 + 64 + 8 every step is exact in doubles, as near terms cancel.
    half = F.rint(percent * 200.0)
    side = ((percent * 128.0 - half) + percent * 64.0) + percent * 8.0
    steps = (
        F.when(F.pmod(half, F.lit(2.0)) == 0.0, half / 2.0)
        .when(side > 0.0, (half + 1.0) / 2.0)
        .when(side < 0.0, (half - 1.0) / 2.0)
        .otherwise(F.rint(half / 2.0))
    )
    before = whole(F.floor(steps / 100.0))
    after = whole(F.pmod(steps, F.lit(100.0)))
    return F.concat(
        before.cast("string"), F.lit("."), F.lpad(after.cast("string"), 2, "0"), F.lit("%")
    )
