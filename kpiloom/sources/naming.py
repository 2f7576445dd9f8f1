"""Column names at the boundary."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from kpiloom.columns import EJECUTIVO, FECHA, PEDIDO, REQUIRED, STATUS, TORRE
from kpiloom.functions.text import normalise_name

# The loaded table; further columns pass through.
GESTIONES_SCHEMA = T.StructType(
    [
        T.StructField(FECHA, T.TimestampNTZType()),
        T.StructField(EJECUTIVO, T.StringType()),
        T.StructField(PEDIDO, T.StringType()),
        T.StructField(STATUS, T.StringType()),
        T.StructField(TORRE, T.StringType()),
    ]
)


def normalise_columns(df: DataFrame) -> DataFrame:
    """Rename all columns to table form; two headers that fall together are an error."""
    names = [normalise_name(c) for c in df.columns]
    twice = sorted(name for name, times in Counter(names).items() if times > 1)
    if twice:
        raise ValueError(f"headers fall together after normalisation: {twice}")
    return df.toDF(*names)


def require_columns(df: DataFrame, required: tuple[str, ...] = REQUIRED) -> DataFrame:
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"required columns missing: {missing}; found {df.columns}")
    return df
