"""Batch loads: a delivery into the database, or into a snapshot."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from kpiloom.columns import FILAS
from kpiloom.config import DB, Profile
from kpiloom.operators.clean import clean
from kpiloom.sources.jdbc import CONNECTIONS, WRITE_BATCH, replace_table
from kpiloom.sources.naming import normalise_columns, require_columns
from kpiloom.sources.snapshot import SnapshotStore


def load_to_database(
    raw: DataFrame,
    options: Mapping[str, str],
    table: str,
    batch_size: int = WRITE_BATCH,
    connections: int | None = CONNECTIONS,
) -> int:
    """Normalise names, replace the table, and return the rows written.

    The rows are counted while they are written. An error propagates to the caller, and
    so to the status of the job.
    """
    rows = Observation("load")
    named = require_columns(normalise_columns(raw)).observe(rows, F.count(F.lit(1)).alias(FILAS))
    replace_table(named, options, table, batch_size, connections)
    return rows.get[FILAS]


def load_to_snapshot(
    raw: DataFrame,
    store: SnapshotStore,
    batch: int | None = None,
    profile: Profile = DB,
    text_format: str | None = None,
    allowed: Sequence[str] | DataFrame | None = None,
) -> int:
    """Clean a delivery, publish it, and return its rows; a ``batch`` published before is not repeated."""
    named = require_columns(normalise_columns(raw))
    return store.publish(clean(named, profile, text_format, allowed), batch)
