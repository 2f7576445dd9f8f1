"""The reports. Inputs are measure rows, already filtered; outputs are unsorted unless
stated, and carry what a sink needs to sort them (``dashboard_orders`` lists the keys)."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from kpiloom.columns import (
    CAPACIDAD,
    CORREGIDO,
    DIA,
    EJECUTIVO,
    FILAS,
    MES,
    MES_NUM,
    N,
    STATUS,
    TORRE,
    TOTAL_GENERAL,
)
from kpiloom.config import DB, Profile
from kpiloom.functions.calendar_es import MESES, month_name_of
from kpiloom.functions.numbers import percent_text, ratio, whole
from kpiloom.functions.text import child_label
from kpiloom.operators.clean import filter_allow_list
from kpiloom.operators.counts import (
    CORREGIDAS,
    TOTAL,
    count_by,
    daily_totals,
    orders,
    orders_with_status,
)
from kpiloom.operators.figures import merged_totals
from kpiloom.operators.position import with_position
from kpiloom.session import cut_lineage

LEVEL = "level"
TOWER_TOTAL = "torre_total"


# --- monthly -------------------------------------------------------------------------


def monthly_counts(measures: DataFrame) -> DataFrame:
    """``TORRE, EJECUTIVO, mes_num, n``; equal months of different years count together."""
    return measures.groupBy(TORRE, EJECUTIVO, F.month(DIA).alias(MES_NUM)).agg(orders().alias(N))


def monthly_report(measures: DataFrame) -> DataFrame:
    """Tower subtotals, their executives and both over all months, in long form.

    ``level`` 0 executive and month, 1 executive over all months, 2 tower and month,
    3 tower over all months. In report order (``monthly_order``) each tower, largest
    first, is followed by its executives by name.
    """
    counts = monthly_counts(measures)
    sets = [[TORRE, EJECUTIVO, MES_NUM], [TORRE, EJECUTIVO], [TORRE, MES_NUM], [TORRE]]
    leveled = counts.groupingSets(sets, TORRE, EJECUTIVO, MES_NUM).agg(
        orders().alias(N), F.grouping_id().cast("bigint").alias(LEVEL)
    )
    return _with_tower_total(leveled, counts).select(
        TORRE, EJECUTIVO, MES_NUM, month_name_of(F.col(MES_NUM)).alias(MES), N, LEVEL, TOWER_TOTAL
    )


def _with_tower_total(leveled: DataFrame, counts: DataFrame) -> DataFrame:
    totals = counts.groupBy(F.col(TORRE).alias("_torre")).agg(orders().alias(TOWER_TOTAL))
    # Null-safe, as plain equality would put a null test below one use of the counts only,
    # and Spark could no longer reuse their shuffle.
    return leveled.join(totals, F.col(TORRE).eqNullSafe(F.col("_torre"))).drop("_torre")


def monthly_order():
    return [
        F.desc(TOWER_TOTAL),
        F.asc(TORRE),
        F.col(EJECUTIVO).asc_nulls_first(),
        F.col(MES_NUM).asc_nulls_last(),
    ]


def active_months(measures: DataFrame) -> list[str]:
    """Names of the months present, by number: twelve at most, so they may be collected."""
    numbers = measures.select(F.month(DIA).alias(MES_NUM)).distinct().collect()
    return [MESES[row[MES_NUM] - 1] for row in sorted(numbers)]


def monthly_wide(measures: DataFrame, months: Sequence[str]) -> DataFrame:
    """One row per tower and per executive below it, one column per month, and the total."""
    numbers = {m: MESES.index(m) + 1 for m in months}
    columns = [
        F.sum(F.when(F.col(MES_NUM) == number, F.col(N)).otherwise(0)).alias(m)
        for m, number in numbers.items()
    ]
    # Months become columns in the same aggregation that forms the two levels.
    counts = monthly_counts(measures)
    leveled = counts.groupingSets([[TORRE, EJECUTIVO], [TORRE]], TORRE, EJECUTIVO).agg(
        *columns, orders().alias(TOTAL), F.grouping_id().alias("_id")
    )
    is_tower = F.col("_id") == 1
    return _with_tower_total(leveled, counts).select(
        F.when(is_tower, F.col(TORRE)).otherwise(child_label(F.col(EJECUTIVO))).alias("etiqueta"),
        F.when(is_tower, "Torre").otherwise("Ejecutivo").alias("tipo"),
        *months,
        TOTAL,
        TORRE,
        EJECUTIVO,
        TOWER_TOTAL,
    )


def monthly_wide_order():
    return [F.desc(TOWER_TOTAL), F.asc(TORRE), F.col(EJECUTIVO).asc_nulls_first()]


# --- daily, wide presentations -------------------------------------------------------


def active_days(measures: DataFrame) -> list[date]:
    """The days present, sorted; the calendar bounds how many there are."""
    return sorted(row[DIA] for row in measures.select(DIA).distinct().collect())


def days_between(span: DataFrame) -> list[date]:
    lo, hi = span.first()
    return [] if lo is None else [lo + timedelta(days=i) for i in range((hi - lo).days + 1)]


def _headers(days: Sequence[date]) -> list[str]:
    return [f"{d:%d-%m-%Y}" for d in days]


def _found_days(counts: DataFrame, days: Sequence[date] | None) -> tuple[DataFrame, Sequence[date]]:
    """The counts and the days of a wide table; those present if none are given.

    Then the counts are written down, so that finding their days does not read the detail again.
    """
    if days is not None:
        return counts, days
    counts = cut_lineage(counts)
    return counts, active_days(counts.where(F.col(DIA).isNotNull()))


def _by_day(value: Column) -> Column:
    """The values of a group by day, as one map; a group has a row a day at most."""
    return F.map_from_entries(F.collect_list(F.when(F.col(DIA).isNotNull(), F.struct(DIA, value))))


def _day_columns(rows: DataFrame, days: Sequence[date], cell: Callable[[Column], Column]) -> tuple[DataFrame, list[Column]]:
    """A column for each day, made of what the group's map holds for it, or null.

    The cells are one expression over the list of days, and the columns its elements: neither the
    aggregation nor the code that Spark generates grows with the days.
    """
    listed = F.array(*[F.lit(d) for d in days]).cast("array<date>")
    cells = rows.withColumn("_cells", F.transform(listed, lambda d: cell(F.try_element_at(F.col("_by_day"), d))))
    return cells, [F.col("_cells")[i].alias(h) for i, h in enumerate(_headers(days))]


def daily_wide(
    measures: DataFrame, key: str, days: Sequence[date] | None = None, grand_total: bool = True
) -> DataFrame:
    """One column per day and the total over all days; last a total row if asked for.

    Without ``days`` the columns are the days present, which are found while the frame is built.
    Counts are combined per key and day before they become map entries, then columns.
    """
    totals = daily_totals(measures, key, grand_total)
    counts, days = _found_days(totals.withColumn(LEVEL, (F.col(LEVEL) >= 2).cast("bigint")), days)
    rows = counts.groupBy(key, LEVEL).agg(
        _by_day(F.col(N)).alias("_by_day"), F.sum(F.when(F.col(DIA).isNull(), F.col(N))).alias(TOTAL)
    )
    cells, columns = _day_columns(rows, days, lambda n: F.coalesce(n, F.lit(0).cast("bigint")))
    return cells.select(key, *columns, TOTAL, LEVEL)


def daily_wide_order(key: str):
    return [F.asc(LEVEL), F.desc(TOTAL), F.asc(key)]


def resolution_wide(measures: DataFrame, days: Sequence[date] | None = None, key: str = EJECUTIVO) -> DataFrame:
    """Percent texts per day, ``0%`` where nothing was handled, and the count of orders.

    ``days`` as in ``daily_wide``. Texts are made last, one for each cell, so that only numbers
    are moved.
    """
    counts = measures.groupBy(key, DIA).agg(orders_with_status(CORREGIDO).alias(CORREGIDAS), orders().alias(N))
    counts, days = _found_days(counts, days)
    share = ratio(F.col(CORREGIDAS), F.col(N))
    rows = counts.groupBy(key).agg(_by_day(share).alias("_by_day"), orders().alias(TOTAL))
    cells, columns = _day_columns(rows, days, lambda p: percent_text(F.coalesce(p, F.lit(0.0)), 0))
    return cells.select(key, *columns, TOTAL)


# --- headline indicators -------------------------------------------------------------


def kpi_cards(measures: DataFrame, profile: Profile = DB) -> DataFrame:
    """One row of headline figures, no row for an empty selection."""
    # Counting per executive and day first leaves the distinct counts little to expand.
    per_day = measures.groupBy(EJECUTIVO, DIA).agg(
        orders().alias(N),
        orders_with_status(CAPACIDAD).alias("capacidad"),
        orders_with_status(CORREGIDO).alias(CORREGIDAS),
        F.sum(FILAS).alias(FILAS),
    )
    totals = per_day.agg(
        *[F.sum(c).alias(c) for c in (N, "capacidad", CORREGIDAS, FILAS)],
        F.count_distinct(EJECUTIVO).alias("ejecutivos"),
        F.count_distinct(DIA).alias("dias"),
    )
    return _cards(totals, profile)


def kpi_cards_merged(cells: DataFrame, profile: Profile = DB) -> DataFrame:
    """The same row from stored cells or executive slices (see ``figures``), already filtered."""
    return _cards(merged_totals(cells), profile)


def _cards(totals: DataFrame, profile: Profile) -> DataFrame:
    totals = totals.filter(F.col(FILAS) > 0)
    handled = F.col(N) - F.col("capacidad") if profile.subtract_capacity else F.col(N)
    days = F.col("dias") if profile.fixed_days is None else F.lit(profile.fixed_days)
    per_executive = F.try_divide(
        F.try_divide(handled.cast("double"), days.cast("double")), F.col("ejecutivos").cast("double")
    )
    figures = totals.select(
        N,
        "ejecutivos",
        "dias",
        "capacidad",
        CORREGIDAS,
        ratio(handled, F.col(N)).alias("atendidas"),
        ratio(F.col(CORREGIDAS), F.col(N)).alias("resolutividad"),
        F.coalesce(whole(per_executive), F.lit(0)).alias("fte_dia"),
    )
    return figures.withColumns(
        {
            "atendidas_text": percent_text(F.col("atendidas"), profile.percent_decimals),
            "resolutividad_text": percent_text(F.col("resolutividad"), profile.percent_decimals),
        }
    )


# --- shares, rates and mixes ---------------------------------------------------------


def share_by(measures: DataFrame, key: str) -> DataFrame:
    """``key, n, share`` of the whole."""
    counts = count_by(measures, key)
    whole_count = counts.agg(F.sum(N)).scalar()
    return counts.withColumn("share", ratio(F.col(N), whole_count))


def _resolution_by_executive(measures: DataFrame) -> DataFrame:
    return measures.groupBy(EJECUTIVO).agg(
        orders_with_status(CORREGIDO).alias(CORREGIDAS), orders().alias("asignadas")
    )


def resolution_rate(measures: DataFrame) -> DataFrame:
    """``EJECUTIVO, rate`` from 0 to 100."""
    rate = ratio(F.col(CORREGIDAS), F.col("asignadas")) * F.lit(100.0)
    return _resolution_by_executive(measures).select(EJECUTIVO, rate.alias("rate"))


def resolution_rate_order():
    return [F.desc("rate"), F.asc(EJECUTIVO)]


def status_mix(measures: DataFrame) -> DataFrame:
    """``EJECUTIVO, STATUS_REAL, n, exec_order``: executives placed by total volume."""
    # Used more than once, to place the executives too; Spark reuses its shuffle.
    mix = count_by(measures, EJECUTIVO, STATUS)
    volumes = mix.groupBy(EJECUTIVO).agg(orders().alias(TOTAL))
    placed = with_position(volumes, [-F.col(TOTAL), F.col(EJECUTIVO)], "exec_order")
    return mix.join(placed.select(EJECUTIVO, "exec_order"), EJECUTIVO).select(
        EJECUTIVO, STATUS, N, "exec_order"
    )


# --- ranking -------------------------------------------------------------------------


def ranking(measures: DataFrame, allowed: Sequence[str] | DataFrame | None) -> DataFrame:
    """Allowed executives by resolution, best first, ties by name, with both counts."""
    if allowed is not None:
        measures = filter_allow_list(measures, allowed)
    scored = _resolution_by_executive(measures).withColumn(
        "resolutividad", ratio(F.col(CORREGIDAS), F.col("asignadas"))
    )
    order = [F.desc("resolutividad"), F.asc(EJECUTIVO)]
    if allowed is None or isinstance(allowed, DataFrame):
        placed = with_position(scored, [-F.col("resolutividad"), F.col(EJECUTIVO)], "pos")
    else:
        # No more rows than names in the literal list, so one task does.
        placed = scored.withColumn("pos", F.row_number().over(Window.orderBy(*order)).cast("bigint"))
    return placed.select("pos", EJECUTIVO, CORREGIDAS, "asignadas", "resolutividad")


def ranking_resolution(ranked: DataFrame) -> DataFrame:
    """``pos, EJECUTIVO, resolutividad, text, tier, icon``."""
    pos = F.col("pos")
    # Style and icon of the leading places.
    tier = F.when(pos == 1, "success").when(pos == 2, "info").when(pos == 3, "primary")
    icon = F.when(pos == 1, "trophy").when(pos == 2, "award").otherwise("star")
    return ranked.select(
        "pos",
        EJECUTIVO,
        "resolutividad",
        percent_text(F.col("resolutividad"), 2).alias("text"),
        tier.otherwise("secondary").alias("tier"),
        icon.alias("icon"),
    )


def ranking_quantity(ranked: DataFrame) -> DataFrame:
    """``pos, EJECUTIVO, corregidas, asignadas, pct, text`` in the order of the ranking."""
    return ranked.select(
        "pos",
        EJECUTIVO,
        CORREGIDAS,
        "asignadas",
        F.col("resolutividad").alias("pct"),
        percent_text(F.col("resolutividad"), 2).alias("text"),
    )
