"""All report tables for one filter state."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kpiloom.columns import DIA, EJECUTIVO, N, STATUS, TORRE
from kpiloom.config import DB, KpiFilter, Profile
from kpiloom.operators.counts import (
    OWN_SPAN,
    Span,
    daily_counts,
    daily_order,
    daily_resolution,
    daily_totals,
    week_span,
)
from kpiloom.plans import reports
from kpiloom.sources.snapshot import SnapshotStore


def filter_span(measures: DataFrame, flt: KpiFilter, profile: Profile) -> Span:
    """Days of the daily tables: dense in week mode, over the filtered rows or over all."""
    if not (profile.dense_weeks and flt.by_week):
        return None
    if profile.span_from_filtered:
        return OWN_SPAN
    return week_span(KpiFilter(mode=flt.mode, weeks=flt.weeks).apply(measures))


def stored_kpi_cards(store: SnapshotStore, flt: KpiFilter | None = None, profile: Profile = DB) -> DataFrame:
    """Headline figures of a selection of the newest snapshot, from merged bitmaps and masks.

    Read are the cells, or where executives are chosen their slices: never a row for each of an
    executive's days.
    """
    flt = flt or KpiFilter()
    stored = store.slices() if flt.executives else store.cells()
    return reports.kpi_cards_merged(flt.apply(stored), profile)


def snapshot_tables(
    store: SnapshotStore,
    flt: KpiFilter | None = None,
    profile: Profile = DB,
    ranked: Sequence[str] | DataFrame | None = None,
) -> dict[str, Callable[[], DataFrame]]:
    """``dashboard_tables`` over the newest snapshot, headline figures from what is stored for them."""
    tables = dashboard_tables(store.cuboid(), flt, profile, ranked)
    return tables | {"kpi_cards": lambda: stored_kpi_cards(store, flt, profile)}


def dashboard_tables(
    measures: DataFrame,
    flt: KpiFilter | None = None,
    profile: Profile = DB,
    ranked: Sequence[str] | DataFrame | None = None,
) -> dict[str, Callable[[], DataFrame]]:
    """How to build each table. Nothing is planned or run before one is called for, since
    those that place every executive run a job while they are built."""
    flt = flt or KpiFilter()
    selected = flt.apply(measures)
    span = filter_span(measures, flt, profile)
    tables = {
        "kpi_cards": lambda: reports.kpi_cards(selected, profile),
        "diario_torre": lambda: daily_counts(selected, TORRE, span),
        "diario_status": lambda: daily_counts(selected, STATUS, span),
        "diario_ejecutivo": lambda: daily_counts(selected, EJECUTIVO, span),
        "totales_torre": lambda: daily_totals(selected, TORRE, profile.grand_total, span),
        "totales_status": lambda: daily_totals(selected, STATUS, profile.grand_total, span),
        "totales_ejecutivo": lambda: daily_totals(selected, EJECUTIVO, profile.grand_total, span),
    }
    if not profile.full_dashboard:
        return tables
    return tables | {
        "mensual": lambda: reports.monthly_report(selected),
        "resolutividad_diaria": lambda: daily_resolution(selected, EJECUTIVO, span),
        "torta_torre": lambda: reports.share_by(selected, TORRE),
        "volumen_ejecutivo": lambda: reports.share_by(selected, EJECUTIVO),
        "barras_resolutividad": lambda: reports.resolution_rate(selected),
        "composicion_status": lambda: reports.status_mix(selected),
        "ranking_resolutividad": lambda: reports.ranking_resolution(reports.ranking(selected, ranked)),
        "ranking_cantidad": lambda: reports.ranking_quantity(reports.ranking(selected, ranked)),
    }


def dashboard_orders(profile: Profile = DB) -> dict[str, list[Column]]:
    """The keys that put each table of ``dashboard_tables`` in report order."""

    def totals(key: str) -> list[Column]:
        # Keys by their total, then the grand total; inside each the days, then the total.
        own = F.max(F.when(F.col("level").isin(1, 3), F.col(N))).over(Window.partitionBy(key, F.col("level") >= 2))
        return [F.asc(F.col("level") >= 2), F.desc(own), F.asc(key), F.col(DIA).asc_nulls_last()]

    place = [F.asc("pos")]
    orders = {"kpi_cards": []}
    for name, key in (("torre", TORRE), ("status", STATUS), ("ejecutivo", EJECUTIVO)):
        orders[f"diario_{name}"] = daily_order(key)
        orders[f"totales_{name}"] = totals(key)
    if not profile.full_dashboard:
        return orders
    return orders | {
        "mensual": reports.monthly_order(),
        "resolutividad_diaria": daily_order(EJECUTIVO),
        "torta_torre": [F.desc(N), F.asc(TORRE)],
        "volumen_ejecutivo": [F.desc(N), F.asc(EJECUTIVO)],
        "barras_resolutividad": reports.resolution_rate_order(),
        "composicion_status": [F.asc("exec_order"), F.desc(N), F.asc(STATUS)],
        "ranking_resolutividad": place,
        "ranking_cantidad": place,
    }


def build_dashboard(
    measures: DataFrame,
    flt: KpiFilter | None = None,
    profile: Profile = DB,
    ranked: Sequence[str] | DataFrame | None = None,
) -> dict[str, DataFrame]:
    """All tables by name; an empty selection gives tables without rows.

    Pass a stored or cached cuboid: each table then reads that and not the detail.
    """
    return {name: build() for name, build in dashboard_tables(measures, flt, profile, ranked).items()}
