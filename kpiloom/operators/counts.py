"""Counts per key and day. Inputs are measure rows (see ``cuboid``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from kpiloom.columns import CORREGIDO, DIA, EJECUTIVO, N, STATUS, TOTAL_GENERAL
from kpiloom.functions.calendar_es import week_end, week_start
from kpiloom.functions.numbers import percent_text, ratio

TOTAL = "total"
CORREGIDAS = "corregidas"

# Days a daily table shows: those present, all of a given `lo, hi` row, or all between the
# first and the last week of the counts themselves.
OWN_SPAN = "own"
Span = DataFrame | str | None


def orders() -> Column:
    return F.sum(N)


def orders_with_status(status: str) -> Column:
    return F.sum(F.when(F.col(STATUS) == status, F.col(N)).otherwise(0))


def count_by(measures: DataFrame, *keys: str) -> DataFrame:
    return measures.groupBy(*keys).agg(orders().alias(N))


def _over_key(key: str) -> Column:
    # After counting per day a key has one row per day at most, however hot it is.
    return F.sum(N).over(Window.partitionBy(key))


def daily_counts(measures: DataFrame, key: str, span: Span = None) -> DataFrame:
    """``key, Fecha_Dia, n, total``; with ``span`` every day of it, absent ones as 0.

    ``total`` covers all days of the key, also outside the span.
    """
    counts = count_by(measures, key, DIA)
    totalled = counts.withColumn(TOTAL, _over_key(key))
    if span is None:
        return totalled
    return dense_days(totalled, key, _bounds(span, counts, [N]), [N])


def daily_order(key: str) -> list[Column]:
    return [F.desc(TOTAL), F.asc(key), F.asc(DIA)]


def daily_totals(measures: DataFrame, key: str, grand_total: bool = True, span: Span = None) -> DataFrame:
    """Long form with totals: ``key, Fecha_Dia, n, level``.

    Levels: 0 key and day, 1 key over all days, 2 day over all keys, 3 everything; the
    last two, labelled as the grand total, only where ``grand_total``. With ``span`` levels
    0 and 2 have every day of it, absent ones as 0.
    """
    sets = [[key, DIA], [key]]
    if grand_total:
        sets += [[DIA], []]
    counts = count_by(measures, key, DIA)
    totals = counts.groupingSets(sets, key, DIA).agg(
        orders().alias(N), F.grouping_id().cast("bigint").alias("level")
    )
    if grand_total:
        # An empty selection still has an empty grouping set; no rows, no total.
        totals = totals.filter(F.col(N).isNotNull())
    label = F.when(F.col("level") >= 2, F.lit(TOTAL_GENERAL)).otherwise(F.col(key))
    totals = totals.select(label.alias(key), DIA, N, "level")
    if span is None:
        return totals
    dated = dense_days(totals.filter("level in (0, 2)"), [key, "level"], _bounds(span, counts, [N]), [N])
    return dated.union(totals.filter("level in (1, 3)"))


def week_span(measures: DataFrame) -> DataFrame:
    """One row ``lo, hi``: Monday of the first week to Sunday of the last one."""
    return measures.agg(
        F.min(week_start(F.col(DIA))).alias("lo"), F.max(week_end(F.col(DIA))).alias("hi")
    )


def _bounds(span: DataFrame | str, counts: DataFrame, values: list[str]) -> Column:
    """The span as a scalar struct.

    For the span of the counts themselves the values are aggregated along: with every
    column in use the subquery is the same shuffle as the counts, and Spark reuses it.
    """
    if isinstance(span, DataFrame):
        return span.select(F.struct("lo", "hi")).scalar()
    lo, hi = F.min(week_start(F.col(DIA))), F.max(week_end(F.col(DIA)))
    fields = [lo.alias("lo"), hi.alias("hi"), *[F.sum(v).alias(v) for v in values]]
    return counts.agg(F.struct(*fields)).scalar()


def dense_days(counts: DataFrame, key: str | list[str], bounds: Column, values: list[str]) -> DataFrame:
    """Counts for every key (or keys) on every day of the bounds; absent days hold 0.

    Each row also stands for the empty days up to the next row of its key, the first one
    for those before it. So only the sparse counts are shuffled, never the dense result.
    Days outside the bounds are dropped, their keys stay.
    """
    ordered = Window.partitionBy(key).orderBy(DIA)
    lo, hi = F.col("_bounds.lo"), F.col("_bounds.hi")
    gaps = counts.withColumn("_bounds", bounds).withColumns(
        {
            "_from": F.when(F.lag(DIA).over(ordered).isNull(), F.least(F.col(DIA), lo)).otherwise(F.col(DIA)),
            "_to": F.coalesce(F.date_sub(F.lead(DIA).over(ordered), 1), F.greatest(F.col(DIA), hi)),
        }
    )
    days = gaps.withColumn("_day", F.explode(F.sequence("_from", "_to")))
    days = days.filter((F.col("_day") >= lo) & (F.col("_day") <= hi))
    filled = {v: F.when(F.col("_day") == F.col(DIA), F.col(v)).otherwise(F.lit(0)) for v in values}
    return days.withColumns(filled).withColumn(DIA, F.col("_day")).select(*counts.columns)


def daily_resolution(measures: DataFrame, key: str = EJECUTIVO, span: Span = None) -> DataFrame:
    """Share of corrected orders per key and day; ``total`` is the key's count of orders."""
    values = [CORREGIDAS, N]
    counts = measures.groupBy(key, DIA).agg(
        orders_with_status(CORREGIDO).alias(CORREGIDAS), orders().alias(N)
    )
    totalled = counts.withColumn(TOTAL, _over_key(key))
    if span is not None:
        totalled = dense_days(totalled, key, _bounds(span, counts, values), values)
    share = ratio(F.col(CORREGIDAS), F.col(N))
    return totalled.select(
        key, DIA, CORREGIDAS, N, share.alias("pct"), percent_text(share, 0).alias("pct_text"), TOTAL
    )
