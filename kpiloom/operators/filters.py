"""Date-range filter; the selectors live in ``kpiloom.config.KpiFilter``."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpiloom.columns import LAYOUT_ANIO, FECHA


def filter_date_range(df: DataFrame, start: date | datetime | str, end: date | datetime | str) -> DataFrame:
    """Both ends count, as moments: a plain date is its midnight, so later rows of the end
    day are left out."""
    first, last = (F.lit(str(edge)).cast("timestamp_ntz") for edge in (start, end))
    df = df.filter(F.col(FECHA).between(first, last))
    if LAYOUT_ANIO in df.columns:
        df = df.filter(F.col(LAYOUT_ANIO).between(F.year(first), F.year(last)))
    return df
