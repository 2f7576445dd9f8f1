"""Headline figures from cells that can be merged, without a row for an executive's day.

Every time selector is constant on a slice of days: a half month cut by ISO weeks. A cell holds the
counts of a tower and status in a slice, a mask of the days of the month that have rows, and bitmaps
of who worked there. Masks and bitmaps merge by OR, so distinct counts over any selection of
cells are exact. A slice goes by its first day, hence filters work on cells as on days.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kpiloom.columns import CAPACIDAD, CORREGIDO, DIA, EJECUTIVO, FILAS, N, STATUS, TORRE
from kpiloom.functions.calendar_es import half_month, week_start
from kpiloom.operators.counts import CORREGIDAS, orders, orders_with_status
from kpiloom.operators.position import with_position

NUMERO = "numero"  # of an executive, from 0, for good
BLOQUE = "bloque"  # of 32,768 executives, one bitmap each
BITS = "bits"
DIAS = "dias"


def slice_start(day: Column) -> Column:
    """The first day of the slice that a day lies in."""
    return F.greatest(half_month(day), week_start(day))


def _days() -> Column:
    return F.bit_or(F.call_function("shiftleft", F.lit(1), F.dayofmonth(DIA) - 1)).alias(DIAS)


def new_names(names: DataFrame, known: DataFrame) -> DataFrame:
    """``EJECUTIVO``: each name once that is not among the known ones."""
    return names.select(EJECUTIVO).distinct().join(known, EJECUTIVO, "left_anti")


def number_names(names: DataFrame, known: DataFrame, count: int) -> DataFrame:
    """``EJECUTIVO, numero`` of names not among the ``count`` known ones, numbered on from there, by name."""
    return numbered_on(new_names(names, known), count)


def numbered_on(fresh: DataFrame, count: int) -> DataFrame:
    """Distinct names with their numbers; goes over the names several times, so they had better be kept."""
    placed = with_position(fresh, [F.col(EJECUTIVO)], NUMERO)
    return placed.select(EJECUTIVO, (F.col(NUMERO) + (count - 1)).alias(NUMERO))


def figure_cells(cuboid: DataFrame, numbers: DataFrame) -> DataFrame:
    """``TORRE, STATUS_REAL, Fecha_Dia (of the slice), bloque, n, filas, dias, bits``.

    Counts add up over blocks, so a cell may have any number of executives.
    """
    numbered = cuboid.join(numbers, EJECUTIVO)
    keys = [TORRE, STATUS, slice_start(F.col(DIA)).alias(DIA), F.bitmap_bucket_number(NUMERO).alias(BLOQUE)]
    bits = F.bitmap_construct_agg(F.bitmap_bit_position(NUMERO)).alias(BITS)
    return numbered.groupBy(*keys).agg(orders().alias(N), F.sum(FILAS).alias(FILAS), _days(), bits)


def executive_slices(cuboid: DataFrame) -> DataFrame:
    """The same counts and days per executive, for selections of executives."""
    keys = [TORRE, EJECUTIVO, STATUS, slice_start(F.col(DIA)).alias(DIA)]
    return cuboid.groupBy(*keys).agg(orders().alias(N), F.sum(FILAS).alias(FILAS), _days())


def merged_totals(rows: DataFrame) -> DataFrame:
    """One row of sums and distinct counts over cells, or over executive slices.

    Merged per month and block (or executive) in the one shuffle over the rows; what is left
    of that is merged once along each way.
    """
    bitmaps = BITS in rows.columns
    member = BLOQUE if bitmaps else EJECUTIVO
    sums = {
        N: orders(),
        "capacidad": orders_with_status(CAPACIDAD),
        CORREGIDAS: orders_with_status(CORREGIDO),
        FILAS: F.sum(FILAS),
    }
    or_bits = [F.bitmap_or_agg(BITS).alias(BITS)] if bitmaps else []
    months = rows.groupBy(member, F.year(DIA).alias("_anio"), F.month(DIA).alias("_mes")).agg(
        *[value.alias(name) for name, value in sums.items()], F.bit_or(DIAS).alias(DIAS), *or_bits
    )
    both = months.groupingSets([[member], ["_anio", "_mes"]], member, "_anio", "_mes").agg(
        *[F.sum(name).alias(name) for name in sums], F.bit_or(DIAS).alias(DIAS), *or_bits, F.grouping(member).alias("_month")
    )
    whose, month = F.col("_month") == 0, F.col("_month") == 1
    people = F.bitmap_count(BITS) if bitmaps else F.lit(1).cast("bigint")
    return both.agg(
        *[F.sum(F.when(whose, F.col(name))).alias(name) for name in sums],
        F.sum(F.when(whose, people)).alias("ejecutivos"),
        F.sum(F.when(month, F.bit_count(DIAS))).alias(DIAS),
    )
