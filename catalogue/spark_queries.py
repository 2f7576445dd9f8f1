"""One query per operator and report, over the whole of the given tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from catalogue import views
from kpiloom.columns import (
    DIA,
    EJECUTIVO,
    FECHA,
    MES,
    MES_NUM,
    N,
    PEDIDO,
    REQUIRED,
    SEMANA,
    STATUS,
    TORRE,
    WEEK_END,
    WEEK_LABEL,
    WEEK_START,
    YEAR,
)
from kpiloom.config import DB, SEMANA_MODE, V1, WORKBOOK, KpiFilter
from kpiloom.functions.calendar_es import MESES, half_month, month_name_of, with_calendar
from kpiloom.functions.numbers import percent_text, ratio
from kpiloom.functions.text import child_label
from kpiloom.operators.clean import DATE_FORMATS, DETECT, clean, filter_allow_list, format_votes, lenient_timestamp
from kpiloom.operators.counts import (
    OWN_SPAN,
    count_by,
    daily_counts,
    daily_resolution,
    daily_totals,
    week_span,
)
from kpiloom.operators.cuboid import as_measures, build_cuboid
from kpiloom.operators.filters import filter_date_range
from kpiloom.plans import export, options, reports, stored_kpi_cards
from kpiloom.session import checkpoint_folder
from kpiloom.sources.naming import normalise_columns
from kpiloom.sources.snapshot import SnapshotStore
from kpiloom.streaming.deltas import add_delta, compact_deltas, read_deltas
from kpiloom.streaming.refresh import daily_windows, month_key, weekly_windows

Query = Callable[[SparkSession, str], DataFrame]

EVENT_PROFILES = {p.name: p.with_rules(min_month=1) for p in (DB, WORKBOOK, V1)}
HALF_OF_JANUARY = ("2024-01-05", "2024-01-10")
WEEK_35 = KpiFilter(mode=SEMANA_MODE, weeks=(35,))
DAYS_OF_WEEK_35 = [date.fromisocalendar(year, 35, day) for year in range(1995, 2002) for day in range(1, 8)]
MONTHS_IN_SCOPE = MESES[DB.min_month - 1 :]
COMBINED = KpiFilter(months=("Agosto", "Diciembre"), fortnight=1, towers=("ASIA", "EUROPE"))


# --- sources and cleaning ------------------------------------------------------------


def normalised(spark, folder):
    headers = ["Fecha", "Ejecutivo", "Número de pedido", "Status Real", "Torre"]
    return normalise_columns(views.gestiones_raw(spark, folder).toDF(*headers))


def clean_dates(spark, folder):
    line = F.col("linea")
    text = (
        F.when(line == 3, "no-date")
        .when(line == 5, F.date_format(FECHA, "dd/MM/yyyy"))
        .otherwise(F.date_format(FECHA, "yyyy-MM-dd HH:mm:ss"))
    )
    rows = views.lines(spark, folder).withColumn(FECHA, text)
    return rows.select(PEDIDO, lenient_timestamp(rows, FECHA, "yyyy-MM-dd HH:mm:ss").alias(FECHA))


def clean_dates_detected(spark, folder):
    """Dates as day/month/year with and without time, some in ISO form, some broken: the format is found from them."""
    line = F.col("linea")
    text = (
        F.when(line == 3, "no-date")
        .when(line == 5, F.date_format(FECHA, "yyyy-MM-dd"))
        .when(line == 6, F.date_format(FECHA, "d/M/yyyy"))
        .otherwise(F.date_format(FECHA, "dd/MM/yyyy HH:mm:ss"))
    )
    rows = views.lines(spark, folder).withColumn(FECHA, text)
    return rows.select(PEDIDO, lenient_timestamp(rows, FECHA, DETECT).alias(FECHA))


def date_format_votes(spark, folder):
    """How many dates each format reads, where half the rows are month first and a third day first."""
    line = F.col("linea")
    text = F.when(line % 2 == 1, F.date_format(FECHA, "MM/dd/yyyy")).when(line % 3 == 1, F.date_format(FECHA, "dd/MM/yyyy"))
    rows = views.lines(spark, folder).withColumn(FECHA, text.otherwise(F.date_format(FECHA, "dd.MM.yyyy")))
    named = {f: i for i, f in enumerate(DATE_FORMATS)}
    votes = F.col("votes")
    wanted = {"iso": None, "mes_dia": "M/d/yyyy[ H:mm[:ss]]", "dia_mes": "d/M/yyyy[ H:mm[:ss]]", "puntos": "d.M.yyyy[ H:mm[:ss]]"}
    return format_votes(rows).select(*[votes[named[f]].alias(k) for k, f in wanted.items()])


def clean_gestiones(spark, folder):
    line = F.col("linea")
    padded = views.lines(spark, folder).withColumns(
        {
            EJECUTIVO: F.when(line == 2, "   ").otherwise(
                F.concat(F.lit(" \t\u00a0"), F.col(EJECUTIVO), F.lit("\u2003 "))
            ),
            TORRE: F.when(line != 4, F.concat(F.lit("\n"), F.col(TORRE), F.lit(" "))),
            STATUS: F.when(line == 5, " ").otherwise(F.concat(F.col(STATUS), F.lit("\u3000"))),
        }
    )
    return clean(padded.drop("linea"), WORKBOOK)


def allow_list(spark, folder):
    return filter_allow_list(views.gestiones(spark, folder), views.first_names(spark, folder, 7))


def allow_list_table(spark, folder):
    detail = views.gestiones(spark, folder)
    # A list that is itself a table: whoever handled a corrected order in December.
    corrected = detail.filter((F.col(STATUS) == "Corregido") & (F.month(FECHA) == 12))
    return filter_allow_list(detail, corrected.select(EJECUTIVO))


def calendar_columns(spark, folder):
    days = views.gestiones_measures(spark, folder).select(DIA).distinct()
    return with_calendar(days, DIA).select(
        DIA,
        MES,
        F.col(YEAR).cast("bigint").alias(YEAR),
        F.col(SEMANA).cast("bigint").alias(SEMANA),
        WEEK_START,
        WEEK_END,
        WEEK_LABEL,
    )


def format_percent(spark, folder):
    measures = views.gestiones_measures(spark, folder)
    parts = count_by(measures, EJECUTIVO, DIA, STATUS)
    # A day of an executive has one row per status, so the window stays small.
    parts = parts.withColumn("b", F.sum(N).over(Window.partitionBy(EJECUTIVO, DIA)))
    share = ratio(F.col(N), F.col("b"))
    return parts.select(
        F.col(N).alias("a"),
        "b",
        percent_text(share, 0).alias("text_0"),
        percent_text(share, 2).alias("text_2"),
    ).distinct()


# --- filters -------------------------------------------------------------------------


def filtered(flt: KpiFilter) -> Query:
    return lambda spark, folder: flt.apply(views.gestiones(spark, folder))


def filter_executive(spark, folder):
    flt = KpiFilter(executives=tuple(views.first_names(spark, folder, 3)))
    return flt.apply(views.gestiones(spark, folder))


def filter_dates(spark, folder):
    return filter_date_range(views.eventos(spark, folder), *HALF_OF_JANUARY)


# --- reports -------------------------------------------------------------------------


def over_measures(report: Callable[..., DataFrame], *args, **kwargs) -> Query:
    return lambda spark, folder: report(views.gestiones_measures(spark, folder), *args, **kwargs)


def cards(profile: str) -> Query:
    return lambda spark, folder: reports.kpi_cards(
        views.eventos_measures(spark, folder), EVENT_PROFILES[profile]
    )


def kpi_cards_filtered(spark, folder):
    return reports.kpi_cards(COMBINED.apply(views.gestiones_measures(spark, folder)), DB)


def _published(spark, folder) -> SnapshotStore:
    store = SnapshotStore(spark, checkpoint_folder(spark, "store"))
    store.publish(views.gestiones(spark, folder))
    return store


def stored_cards(flt: KpiFilter) -> Query:
    """Published first; then figures come from merged bitmaps and masks."""
    return lambda spark, folder: stored_kpi_cards(_published(spark, folder), flt)


def stored_cards_of_executives(spark, folder):
    flt = KpiFilter(executives=tuple(views.first_names(spark, folder, 3)), fortnight=2)
    return stored_kpi_cards(_published(spark, folder), flt)


def snapshot_reload(spark, folder):
    """A second delivery without the third lines of October 1996: per month its rows, orders, and the versions that wrote it."""
    store = _published(spark, folder)
    later = views.lines(spark, folder).where(~((F.col("linea") == 3) & (F.date_format(FECHA, "yyyy-MM") == "1996-10")))
    store.publish(clean(later.drop("linea")))
    folders = {m["folder"] for m in store.version(0)["months"]}
    kept = [m["anio"] * 100 + m["mes"] for m in store.current()["months"] if m["folder"] in folders]
    month = (F.year(FECHA) * 100 + F.month(FECHA)).alias("mes")
    counts = store.detail().groupBy(month).agg(F.count("*").alias("filas"), F.count(PEDIDO).alias(N))
    return counts.withColumn("version", F.when(F.col("mes").isin(kept), 0).otherwise(1).cast("bigint"))


def deliveries_add_up(spark, folder):
    """Two streams of batches into one target, compacted in between: the cuboid of all of them."""
    target, rows = checkpoint_folder(spark, "deltas"), views.eventos(spark, folder)
    half, part = F.pmod(F.crc32(F.col(EJECUTIVO).cast("binary")), F.lit(2)), F.dayofmonth(FECHA) <= 15
    for batch, chosen in enumerate((part, ~part)):
        for stream in (0, 1):
            add_delta(spark, target, rows.where(chosen & (half == stream)), f"s{stream}", batch)
        if not batch:
            compact_deltas(spark, target)
    return read_deltas(spark, target)


def dense(report: Callable[..., DataFrame], key: str) -> Query:
    def run(spark, folder):
        selected = WEEK_35.apply(views.gestiones_measures(spark, folder))
        return report(selected, key, span=OWN_SPAN)

    return run


def dense_totals(key: str) -> Query:
    def run(spark, folder):
        return daily_totals(WEEK_35.apply(views.gestiones_measures(spark, folder)), key, span=OWN_SPAN)

    return run


def daily_dense_span_of_all(spark, folder):
    """The workbook rule: days span the weeks of all rows, rows are those of two towers."""
    measures = views.gestiones_measures(spark, folder)
    selected = KpiFilter(mode=SEMANA_MODE, weeks=(35,), towers=("ASIA", "EUROPE")).apply(measures)
    return daily_counts(selected, EJECUTIVO, span=week_span(WEEK_35.apply(measures)))


def daily_wide_by_tower(spark, folder):
    """Week 35 of each year; a column for each of its days, whether it has orders or not."""
    selected = WEEK_35.apply(views.gestiones_measures(spark, folder))
    return reports.daily_wide(selected, TORRE, DAYS_OF_WEEK_35)


def resolution_wide(spark, folder):
    selected = WEEK_35.apply(views.gestiones_measures(spark, folder))
    return reports.resolution_wide(selected, DAYS_OF_WEEK_35)


def daily_wide_of_days_found(spark, folder):
    """All days there are, over a thousand columns; given back as the rows they came from, for SQL to check."""
    wide = reports.daily_wide(views.gestiones_measures(spark, folder), TORRE)
    headers = [c for c in wide.columns if c not in (TORRE, "total", reports.LEVEL)]
    cells = F.map_from_arrays(F.array(*map(F.lit, headers)), F.array(*[F.col(f"`{h}`") for h in headers]))
    return wide.select(TORRE, "total", reports.LEVEL, F.explode(cells).alias("dia", N))


def monthly_counts(spark, folder):
    counts = reports.monthly_counts(views.gestiones_measures(spark, folder))
    return counts.select(TORRE, EJECUTIVO, month_name_of(F.col(MES_NUM)).alias(MES), N)


def monthly_report(spark, folder):
    report = reports.monthly_report(views.gestiones_measures(spark, folder))
    return report.withColumn(MES_NUM, F.col(MES_NUM).cast("bigint"))


def monthly_wide(spark, folder):
    return reports.monthly_wide(views.gestiones_measures(spark, folder), MONTHS_IN_SCOPE)


def monthly_labels(spark, folder):
    rows = views.gestiones_measures(spark, folder).select(EJECUTIVO).distinct()
    return rows.select(child_label(F.col(EJECUTIVO)).alias("etiqueta"))


def ranked(presentation: Callable[[DataFrame], DataFrame]) -> Query:
    def run(spark, folder):
        names = views.first_names(spark, folder, 7)
        return presentation(reports.ranking(views.gestiones_measures(spark, folder), names))

    return run


def ranking_everyone(spark, folder):
    return reports.ranking(views.gestiones_measures(spark, folder), None)


def ranking_export(spark, folder):
    names = views.first_names(spark, folder, 7)
    return export.ranking_bundle(views.gestiones(spark, folder), names)["ranking_resolutividad"][0]


# --- options and export --------------------------------------------------------------


def months_offered(profile) -> Query:
    def run(spark, folder):
        offered = options.month_options(views.gestiones_measures(spark, folder), profile)
        kind = "bigint" if profile.months_by_number else "date"
        return offered.select("value", F.col("orden").cast(kind).alias("orden"))

    return run


def export_rows(spark, folder):
    return export.select_rows(views.eventos(spark, folder), KpiFilter(fortnight=1), *HALF_OF_JANUARY)


def export_detail(spark, folder):
    return export.export_detail(with_calendar(export_rows(spark, folder)))


def export_passthrough(spark, folder):
    """A delivery with columns `MES` and `ANIO` of its own: both reach the export beside the month's name."""
    own = views.eventos(spark, folder).withColumns(
        {"MES": F.concat(F.lit("m"), F.dayofmonth(FECHA)), "ANIO": F.concat(F.lit("a"), F.year(FECHA))}
    )
    rows = export.select_rows(own, KpiFilter(fortnight=1), *HALF_OF_JANUARY)
    return export.export_detail(with_calendar(rows))


def export_counts(spark, folder):
    return export.export_bundle(export_rows(spark, folder))["resumen_cantidad"][0].drop("total")


def export_shares(spark, folder):
    return export.export_bundle(export_rows(spark, folder))["resumen_resolutividad"][0]


def export_row_count(spark, folder):
    return export.export_row_count(export_rows(spark, folder))


def preview_detail(spark, folder):
    return export.preview(with_calendar(views.gestiones(spark, folder)))


# --- time buckets --------------------------------------------------------------------


def windows(count: Callable[..., DataFrame]) -> Query:
    return lambda spark, folder: count(views.eventos(spark, folder))


def buckets(key: Callable) -> Query:
    def run(spark, folder):
        rows = as_measures(views.eventos(spark, folder))
        return count_by(rows.withColumn("inicio", key(F.col(DIA))), "inicio", TORRE)

    return run


QUERIES: dict[str, Query] = {
    "scan_gestiones": lambda spark, folder: views.gestiones_raw(spark, folder).select(*REQUIRED),
    "normalise_columns": normalised,
    "clean_dates": clean_dates,
    "clean_dates_detected": clean_dates_detected,
    "date_format_votes": date_format_votes,
    "clean_gestiones": clean_gestiones,
    "filter_allow_list": allow_list,
    "filter_allow_list_table": allow_list_table,
    "calendar_columns": calendar_columns,
    "format_percent": format_percent,
    "filter_month": filtered(KpiFilter(months=("Agosto", "Diciembre"))),
    "filter_fortnight": filtered(KpiFilter(fortnight=1)),
    "filter_fortnight_second": filtered(KpiFilter(fortnight=2)),
    "filter_week": filtered(KpiFilter(mode=SEMANA_MODE, weeks=(35, 36))),
    "filter_tower": filtered(KpiFilter(towers=("ASIA", "EUROPE"))),
    "filter_executive": filter_executive,
    "filter_combined": filtered(COMBINED),
    "filter_date_range": filter_dates,
    "base_cuboid": lambda spark, folder: build_cuboid(views.gestiones(spark, folder)),
    "count_by_tower": over_measures(count_by, TORRE),
    "count_by_executive": over_measures(count_by, EJECUTIVO),
    "status_mix_by_executive": over_measures(reports.status_mix),
    "kpi_cards": cards("db"),
    "kpi_cards_workbook": cards("workbook"),
    "kpi_cards_v1": cards("v1"),
    "kpi_cards_filtered": kpi_cards_filtered,
    "kpi_cards_stored": stored_cards(KpiFilter()),
    "kpi_cards_stored_filtered": stored_cards(COMBINED),
    "kpi_cards_stored_week": stored_cards(KpiFilter(mode=SEMANA_MODE, weeks=(35, 40), years=(1996, 1998))),
    "kpi_cards_stored_executives": stored_cards_of_executives,
    "snapshot_reload": snapshot_reload,
    "deliveries_add_up": deliveries_add_up,
    "daily_count_by_tower": over_measures(daily_counts, TORRE),
    "daily_count_by_status": over_measures(daily_counts, STATUS),
    "daily_count_by_executive": over_measures(daily_counts, EJECUTIVO),
    "daily_totals_by_tower": over_measures(daily_totals, TORRE),
    "daily_totals_by_status": over_measures(daily_totals, STATUS),
    "daily_totals_by_executive": over_measures(daily_totals, EJECUTIVO),
    "daily_totals_by_tower_workbook": over_measures(daily_totals, TORRE, WORKBOOK.grand_total),
    "daily_wide_by_tower": daily_wide_by_tower,
    "daily_wide_of_days_found": daily_wide_of_days_found,
    "daily_dense_by_tower": dense(daily_counts, TORRE),
    "daily_dense_by_status": dense(daily_counts, STATUS),
    "daily_dense_by_executive": dense(daily_counts, EJECUTIVO),
    "daily_dense_totals_by_tower": dense_totals(TORRE),
    "daily_dense_totals_by_status": dense_totals(STATUS),
    "daily_dense_totals_by_executive": dense_totals(EJECUTIVO),
    "daily_dense_span_of_all": daily_dense_span_of_all,
    "daily_resolution_by_executive": over_measures(daily_resolution, EJECUTIVO),
    "daily_resolution_dense": dense(daily_resolution, EJECUTIVO),
    "daily_resolution_wide": resolution_wide,
    "monthly_count": monthly_counts,
    "monthly_report": monthly_report,
    "monthly_wide": monthly_wide,
    "monthly_labels": monthly_labels,
    "share_by_tower": over_measures(reports.share_by, TORRE),
    "share_by_executive": over_measures(reports.share_by, EJECUTIVO),
    "chart_resolution_rate": over_measures(reports.resolution_rate),
    "ranking_resolution": ranked(reports.ranking_resolution),
    "ranking_quantity": ranked(reports.ranking_quantity),
    "ranking_everyone": ranking_everyone,
    "ranking_export": ranking_export,
    "options_month": months_offered(DB),
    "options_month_v1": months_offered(V1),
    "options_week": over_measures(options.week_options),
    "options_week_v1": over_measures(options.week_options, V1),
    "options_tower": over_measures(options.key_options, TORRE),
    "options_executive": over_measures(options.key_options, EJECUTIVO),
    "date_bounds": over_measures(options.date_bounds),
    "export_detail": export_detail,
    "export_passthrough": export_passthrough,
    "export_daily_counts": export_counts,
    "export_daily_resolution": export_shares,
    "export_row_count": export_row_count,
    "preview_detail": preview_detail,
    "events_tumbling_day": windows(daily_windows),
    "events_tumbling_week": windows(weekly_windows),
    "events_tumbling_fortnight": buckets(half_month),
    "events_tumbling_month": buckets(month_key),
}
