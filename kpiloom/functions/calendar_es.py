"""Spanish month names and ISO-week columns, without a process locale."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kpiloom.columns import (
    FECHA,
    MES,
    SEMANA,
    WEEK_END,
    WEEK_LABEL,
    WEEK_START,
    YEAR,
)

# Month names and abbreviations as the Spanish locale writes them.
MESES = (
    "Enero", "Febrero", "Marzo", "Abril", "Mayo", "Junio",
    "Julio", "Agosto", "Septiembre", "Octubre", "Noviembre", "Diciembre",
)
MESES_CORTOS = (
    "ene", "feb", "mar", "abr", "may", "jun",
    "jul", "ago", "sep", "oct", "nov", "dic",
)

DAY_HEADER = "dd-MM-yyyy"


def _nth(names: tuple[str, ...], position: Column) -> Column:
    # In ANSI mode element_at is typed as never null and reads a null position as -1.
    found = F.element_at(F.array(*[F.lit(n) for n in names]), position)
    return F.when(position.isNotNull(), found)


def month_name(moment: Column) -> Column:
    return month_name_of(F.month(moment))


def month_name_of(number: Column) -> Column:
    return _nth(MESES, number)


def iso_year(moment: Column) -> Column:
    return F.extract(F.lit("YEAROFWEEK"), moment)


def iso_week(moment: Column) -> Column:
    return F.weekofyear(moment)


def week_start(moment: Column) -> Column:
    # Day arithmetic only: date_trunc would go through the session's time zone.
    return F.date_sub(F.to_date(moment), F.weekday(moment))


def half_month(day: Column) -> Column:
    """First day of the half month a day lies in."""
    first = F.trunc(day, "month")
    return F.when(F.dayofmonth(day) <= 15, first).otherwise(F.date_add(first, 15))


def week_end(moment: Column) -> Column:
    return F.date_add(week_start(moment), 6)


def short_day(day: Column) -> Column:
    return F.concat(F.date_format(day, "dd"), F.lit(" "), _nth(MESES_CORTOS, F.month(day)))


def week_label(moment: Column) -> Column:
    return F.concat(
        F.lit("Semana "), iso_week(moment).cast("string"), F.lit(" ("),
        short_day(week_start(moment)), F.lit(" - "), short_day(week_end(moment)), F.lit(")"),
    )


def day_header(day: Column) -> Column:
    return F.date_format(day, DAY_HEADER)


def with_calendar(df: DataFrame, moment: str = FECHA, week_columns: bool = True) -> DataFrame:
    """Add the calendar columns; ``week_columns=False`` adds month and week number only."""
    at = F.col(moment)
    added = {MES: month_name(at), SEMANA: iso_week(at)}
    if week_columns:
        added = {
            MES: added[MES],
            YEAR: iso_year(at),
            SEMANA: added[SEMANA],
            WEEK_START: week_start(at),
            WEEK_END: week_end(at),
            WEEK_LABEL: week_label(at),
        }
    # Spark compares names without case: a delivered column of the same letters stays, and the
    # calendar's gets a blank in front, which no normalised header has.
    taken = {name.upper() for name in df.columns}
    return df.withColumns({f" {name}" if name.upper() in taken else name: c for name, c in added.items()})


def months_touching_week(week: int) -> set[int]:
    """Every month an ISO week of this number can reach in some year.

    Week 1 starts between 29 December and 4 January, which bounds all later weeks.
    """
    found = set()
    for year in (2023, 2024):  # one common, one leap year
        earliest = date(year - 1, 12, 29) + timedelta(weeks=week - 1)
        latest = date(year, 1, 10) + timedelta(weeks=week - 1)
        found |= {(earliest + timedelta(days=i)).month for i in range((latest - earliest).days + 1)}
    return found
