from kpiloom.sources.files import read_delivery
from kpiloom.sources.jdbc import JdbcSplit, equal_ranges, jdbc_options, read_table, replace_table
from kpiloom.sources.naming import normalise_columns, require_columns
from kpiloom.sources.snapshot import SnapshotStore, hand_off

__all__ = [
    "JdbcSplit",
    "SnapshotStore",
    "hand_off",
    "equal_ranges",
    "jdbc_options",
    "normalise_columns",
    "read_delivery",
    "read_table",
    "replace_table",
    "require_columns",
]
