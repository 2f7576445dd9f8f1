from kpiloom.streaming.deltas import add_delta, append_deltas, compact_deltas, ledger, read_delta_rows, read_deltas
from kpiloom.streaming.refresh import (
    daily_windows,
    fortnight_windows,
    month_windows,
    refresh_if_newer,
    refresh_snapshot,
    replace_on_delivery,
    stream_deliveries,
    weekly_windows,
)

__all__ = [
    "add_delta",
    "append_deltas",
    "compact_deltas",
    "daily_windows",
    "fortnight_windows",
    "ledger",
    "month_windows",
    "read_delta_rows",
    "read_deltas",
    "refresh_if_newer",
    "refresh_snapshot",
    "replace_on_delivery",
    "stream_deliveries",
    "weekly_windows",
]
