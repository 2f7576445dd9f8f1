from kpiloom.operators.clean import DETECT, clean, detect_format, filter_allow_list, format_votes, lenient_timestamp
from kpiloom.operators.counts import (
    count_by,
    daily_counts,
    daily_resolution,
    daily_totals,
    dense_days,
    week_span,
)
from kpiloom.operators.cuboid import as_measures, build_cuboid
from kpiloom.operators.filters import filter_date_range
from kpiloom.operators.position import with_position

__all__ = [
    "as_measures",
    "build_cuboid",
    "clean",
    "count_by",
    "daily_counts",
    "daily_resolution",
    "daily_totals",
    "dense_days",
    "filter_allow_list",
    "filter_date_range",
    "DETECT",
    "detect_format",
    "format_votes",
    "lenient_timestamp",
    "week_span",
    "with_position",
]
