"""Profiles (the three sets of business rules) and the report filter."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kpiloom.columns import LAYOUT_ANIO, DIA, EJECUTIVO, FECHA, LAYOUT_MES, TORRE
from kpiloom.functions.calendar_es import MESES, months_touching_week


@dataclass(frozen=True)
class Profile:
    """Business rules that differ between the generations of the dashboard."""

    name: str
    trim: bool  # trim texts, drop blank executives and towers
    allow_list: tuple[str, ...] | None  # executives kept at load
    week_columns: bool  # ISO year, week bounds and label
    grand_total: bool  # total row in daily tables
    fixed_days: int | None  # divisor of FTE per day; None = days worked
    subtract_capacity: bool
    percent_decimals: int
    dense_weeks: bool  # week filter shows every day of the span
    span_from_filtered: bool  # span from the filtered rows, else from all rows
    months_by_number: bool  # month options by number, else by first date
    export_uses_filter: bool
    full_dashboard: bool  # monthly, resolution, chart and ranking tables too
    min_month: int = 8

    def with_rules(self, **changes) -> Profile:
        return replace(self, **changes)


DB = Profile(
    name="db",
    trim=False,
    allow_list=None,
    week_columns=True,
    grand_total=True,
    fixed_days=None,
    subtract_capacity=True,
    percent_decimals=2,
    dense_weeks=True,
    span_from_filtered=True,
    months_by_number=True,
    export_uses_filter=True,
    full_dashboard=True,
)

# The allow-list is the caller's: WORKBOOK.with_rules(allow_list=(...)).
WORKBOOK = DB.with_rules(
    name="workbook",
    trim=True,
    grand_total=False,
    fixed_days=6,
    percent_decimals=0,
    span_from_filtered=False,
    export_uses_filter=False,
)

V1 = WORKBOOK.with_rules(
    name="v1",
    week_columns=False,
    subtract_capacity=False,
    dense_weeks=False,
    months_by_number=False,
    full_dashboard=False,
)

QUINCENA = "quincena"
SEMANA_MODE = "semana"


@dataclass(frozen=True)
class KpiFilter:
    """Optional selectors, AND-ed; an empty selector restricts nothing.

    ``KpiFilter()`` is the cleared filter. Months and weeks carry no year, so they
    match every year unless ``years`` (calendar years) narrows them.
    """

    months: tuple[str, ...] = ()
    mode: str = QUINCENA
    fortnight: int | None = None
    weeks: tuple[int, ...] = ()
    towers: tuple[str, ...] = ()
    executives: tuple[str, ...] = ()
    years: tuple[int, ...] = ()

    def __post_init__(self):
        if self.mode not in (QUINCENA, SEMANA_MODE):
            raise ValueError(f"mode must be {QUINCENA!r} or {SEMANA_MODE!r}, got {self.mode!r}")

    @property
    def by_week(self) -> bool:
        return self.mode == SEMANA_MODE and bool(self.weeks)

    @property
    def by_fortnight(self) -> bool:
        return self.mode == QUINCENA and bool(self.fortnight)

    def predicate(self, columns: list[str]) -> Column:
        """The filter over detail rows (FECHA) or day-level counts (Fecha_Dia).

        Where the layout carries the partition columns of stored rows the time
        selectors are also stated on them, so that the scan skips whole folders.
        """
        day = F.col(FECHA if FECHA in columns else DIA)
        month = F.col(LAYOUT_MES) if LAYOUT_MES in columns else F.month(day)
        year = F.col(LAYOUT_ANIO) if LAYOUT_ANIO in columns else F.year(day)
        tests = []
        if self.months:
            tests.append(month.isin([MESES.index(m) + 1 for m in self.months if m in MESES]))
        if self.by_fortnight:
            first = F.dayofmonth(day) <= 15
            tests.append(first if self.fortnight == 1 else ~first)
        if self.by_week:
            tests.append(F.weekofyear(day).isin(list(self.weeks)))
            if LAYOUT_MES in columns:
                touched = sorted(set().union(*(months_touching_week(w) for w in self.weeks)))
                tests.append(month.isin(touched))
        if self.towers:
            tests.append(F.col(TORRE).isin(list(self.towers)))
        if self.executives:
            tests.append(F.col(EJECUTIVO).isin(list(self.executives)))
        if self.years:
            tests.append(year.isin(list(self.years)))
        return reduce(and_, tests, F.lit(True))

    def apply(self, df: DataFrame) -> DataFrame:
        return df.filter(self.predicate(df.columns))
