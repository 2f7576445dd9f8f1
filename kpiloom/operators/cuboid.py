"""The base cuboid: counts per tower, executive, status and day.

Counts add up and every selector is a function of these four keys, so all reports but the
detail export can be rolled up from it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpiloom.columns import DIA, EJECUTIVO, FECHA, FILAS, N, PEDIDO, STATUS, TORRE

KEYS = (TORRE, EJECUTIVO, STATUS, DIA)


def as_measures(detail: DataFrame) -> DataFrame:
    """Detail rows in the shape of the cuboid, without aggregating.

    A report over these is one aggregation straight from the scan; over a stored cuboid
    it is the same code on far fewer rows.
    """
    return detail.select(
        TORRE,
        EJECUTIVO,
        STATUS,
        F.to_date(FECHA).alias(DIA),
        F.when(F.col(PEDIDO).isNotNull(), 1).otherwise(0).cast("bigint").alias(N),
        F.lit(1).cast("bigint").alias(FILAS),
    )


def build_cuboid(detail: DataFrame) -> DataFrame:
    """Groups that hold null orders only stay, with ``n = 0``."""
    return merge_cuboids(as_measures(detail))


def merge_cuboids(parts: DataFrame) -> DataFrame:
    return parts.groupBy(*KEYS).agg(F.sum(N).alias(N), F.sum(FILAS).alias(FILAS))
