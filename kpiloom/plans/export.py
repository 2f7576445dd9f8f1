"""Exports: filtered detail, its daily tables, the ranking, and the multi-part writer."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from datetime import date, datetime

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kpiloom.columns import LAYOUT_ANIO, DIA, EJECUTIVO, FECHA, HELPERS, LAYOUT_MES, PEDIDO, STATUS, TORRE
from kpiloom.config import DB, KpiFilter, Profile
from kpiloom.operators.counts import daily_order, daily_resolution, daily_totals
from kpiloom.operators.cuboid import as_measures, build_cuboid
from kpiloom.operators.filters import filter_date_range
from kpiloom.plans.reports import (
    active_days,
    daily_wide,
    daily_wide_order,
    ranking,
    ranking_quantity,
    ranking_resolution,
    resolution_wide,
)

PREVIEW_ROWS = 10


class Bundle(dict):
    """The parts of a report, and what they share, kept from the first part to the last."""

    def keep(self, shared: DataFrame) -> DataFrame:
        self.shared = shared.persist(StorageLevel.MEMORY_AND_DISK)
        return self.shared

    def release(self) -> None:
        if hasattr(self, "shared"):
            self.shared.unpersist()


_LAYOUT = (DIA, LAYOUT_ANIO, LAYOUT_MES)

Part = DataFrame | tuple[DataFrame, list[Column]]


def detail_order() -> list[Column]:
    return [F.asc(c) for c in (FECHA, PEDIDO, EJECUTIVO, TORRE, STATUS)]


def select_rows(
    detail: DataFrame,
    flt: KpiFilter,
    start: date | datetime | str,
    end: date | datetime | str,
    profile: Profile = DB,
) -> DataFrame:
    """The rows of an export: selectors, where the profile applies them, and date range."""
    rows = flt.apply(detail) if profile.export_uses_filter else detail
    return filter_date_range(rows, start, end)


def _without_helpers(rows: DataFrame) -> DataFrame:
    """Helper columns go by their exact names; a user's column that differs in case only stays."""
    out = {*HELPERS, *_LAYOUT, *(f" {name}" for name in HELPERS)}
    return rows.select(*[f"`{c}`" for c in rows.columns if c not in out])


def export_detail(rows: DataFrame, date_only: bool = True) -> DataFrame:
    """Selected rows without helper columns, and the date without its time of day."""
    rows = _without_helpers(rows)
    return rows.withColumn(FECHA, F.to_date(FECHA)) if date_only else rows


def export_row_count(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("n"))


def preview(rows: DataFrame, limit: int = PREVIEW_ROWS) -> DataFrame:
    """The first rows by date; ties are settled so that the choice is the same each time."""
    return _without_helpers(rows).orderBy(*detail_order()).limit(limit)


def export_bundle(rows: DataFrame, profile: Profile = DB, wide: bool = False) -> dict[str, Part]:
    """The parts of the full report: detail, daily counts and daily resolution.

    The single-part profiles write the detail only and keep its time of day. ``wide``
    gives the daily parts one column per day, which asks Spark for the days first.
    """
    if not profile.export_uses_filter:
        return {"datos": (export_detail(rows, date_only=False), detail_order())}
    # The daily parts share one cuboid, so the detail is read twice in all, however many they are.
    parts = Bundle(datos_detallados=(export_detail(rows), detail_order()))
    measures = parts.keep(build_cuboid(rows))
    if wide:
        days = active_days(measures)
        counts = daily_wide(measures, EJECUTIVO, days, profile.grand_total)
        parts["resumen_cantidad"] = (counts, daily_wide_order(EJECUTIVO))
        shares = resolution_wide(measures, days)
        parts["resumen_resolutividad"] = (shares, [F.desc("total"), F.asc(EJECUTIVO)])
    else:
        counts = daily_totals(measures, EJECUTIVO, profile.grand_total)
        # A key has a row a day at most, so the window stays small.
        own = Window.partitionBy(EJECUTIVO, F.col("level") >= 2)
        counts = counts.withColumn("total", F.max(F.when(F.col("level").isin(1, 3), F.col("n"))).over(own))
        by_total = [F.asc(F.col("level") >= 2), F.desc("total"), F.asc(EJECUTIVO), F.col(DIA).asc_nulls_last()]
        parts["resumen_cantidad"] = (counts, by_total)
        parts["resumen_resolutividad"] = (daily_resolution(measures), daily_order(EJECUTIVO))
    return parts


def ranking_bundle(rows: DataFrame, allowed: Sequence[str] | DataFrame | None) -> dict[str, Part]:
    """The parts of the ranking report; its percentages are text."""
    parts = Bundle()
    ranked = parts.keep(ranking(as_measures(rows), allowed))
    by_place = [F.asc("pos")]
    parts["ranking_resolutividad"] = (ranking_resolution(ranked).select("pos", EJECUTIVO, "text"), by_place)
    parts["ranking_cantidad"] = (
        ranking_quantity(ranked).select("pos", EJECUTIVO, "corregidas", "asignadas"),
        by_place,
    )
    parts["consolidado_filtrado"] = (export_detail(rows), detail_order())
    return parts


def run_id(clock: Callable[[], datetime] = datetime.now) -> str:
    return f"{clock():%Y%m%d_%H%M%S}"


def write_report(
    parts: Mapping[str, Part],
    base: str,
    name: str,
    file_format: str = "parquet",
    clock: Callable[[], datetime] = datetime.now,
) -> str:
    """Write each part to ``base/name_<run id>/<part>`` and return that folder.

    A part may come with its order. Sorting cuts it into ranges, so all tasks write and
    the files, read by name, are in order.
    """
    folder = f"{base.rstrip('/')}/{name}_{run_id(clock)}"
    for part, content in parts.items():
        frame, order = content if isinstance(content, tuple) else (content, None)
        if order:
            frame = frame.orderBy(*order)
        writer = frame.write.mode("overwrite")
        if file_format == "csv":
            writer = writer.option("header", True)
        writer.format(file_format).save(f"{folder}/{part}")
    if isinstance(parts, Bundle):
        parts.release()
    return folder
