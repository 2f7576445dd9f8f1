"""Multi-part exports as written to disk."""

from __future__ import annotations

from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from kpiloom import DB, WORKBOOK, KpiFilter
from kpiloom.functions.calendar_es import with_calendar
from kpiloom.operators import clean
from kpiloom.plans import build_dashboard, dashboard_tables, export_bundle, ranking_bundle, write_report
from kpiloom.plans.export import run_id, select_rows
from kpiloom.operators.cuboid import as_measures, build_cuboid
from kpiloom.sources import normalise_columns
from tests.fixtures import NAMES

pytestmark = pytest.mark.usefixtures("light")

CLOCK = lambda: datetime(2025, 11, 5, 7, 8, 9)


@pytest.fixture(scope="module")
def detail(raw):
    return with_calendar(clean(normalise_columns(raw), WORKBOOK)).cache()


@pytest.fixture(scope="module")
def chosen(detail):
    return select_rows(detail, KpiFilter(), "2024-08-05", "2025-12-31 23:59:59")


def test_run_id():
    assert run_id(CLOCK) == "20251105_070809"
    assert len(run_id()) == 15


@pytest.mark.parametrize("wide", [False, True])
def test_full_report(spark, chosen, folder, wide):
    path = write_report(export_bundle(chosen, DB, wide), folder, "reporte_completo", clock=CLOCK)
    assert path == f"{folder}/reporte_completo_20251105_070809"
    parts = {p.name for p in Path(path).iterdir() if p.is_dir()}
    assert parts == {"datos_detallados", "resumen_cantidad", "resumen_resolutividad"}
    written = spark.read.parquet(f"{path}/datos_detallados")
    assert written.count() == 9 and "WeekLabel" not in written.columns and "Fecha_Dia" not in written.columns
    assert dict(written.dtypes)["FECHA"] == "date"
    counts = spark.read.parquet(f"{path}/resumen_cantidad")
    if wide:
        total = counts.filter("EJECUTIVO = 'Total General'").first()
        assert total.total == 8 and total["04-08-2025"] == 2
    else:
        assert counts.filter("level = 3").first().n == 8
    shares = spark.read.parquet(f"{path}/resumen_resolutividad")
    ana = shares.filter("EJECUTIVO = 'Ana'").orderBy(*shares.columns).first()
    assert ana.total == 4


def test_detail_files_are_in_order(spark, chosen, folder):
    path = write_report(export_bundle(chosen, DB), folder, "r", file_format="csv", clock=CLOCK)
    dates = []
    for file in sorted(Path(f"{path}/datos_detallados").glob("part-*.csv")):
        lines = file.read_text().splitlines()
        dates += [line.split(",")[0] for line in lines[1:]]
    assert len(dates) == 9 and dates == sorted(dates)


def test_single_part_report_keeps_the_time_of_day(spark, chosen, folder):
    path = write_report(export_bundle(chosen, WORKBOOK), folder, "consolidado_filtrado", clock=CLOCK)
    assert [p.name for p in Path(path).iterdir() if p.is_dir()] == ["datos"]
    assert dict(spark.read.parquet(f"{path}/datos").dtypes)["FECHA"] == "timestamp_ntz"


def test_ranking_report(spark, detail, folder):
    path = write_report(ranking_bundle(detail, NAMES), folder, "ranking_kpi_completo", clock=CLOCK)
    ranked = spark.read.parquet(f"{path}/ranking_resolutividad").orderBy("pos").collect()
    assert [tuple(r) for r in ranked] == [(1, "Beto", "50.00%"), (2, "Caro", "50.00%"), (3, "Ana", "25.00%")]
    amounts = spark.read.parquet(f"{path}/ranking_cantidad").orderBy("pos")
    assert [tuple(r)[2:] for r in amounts.collect()] == [(1, 2), (1, 2), (1, 4)]
    assert spark.read.parquet(f"{path}/consolidado_filtrado").count() == 9


@pytest.mark.parametrize(
    "flt, profile",
    [(KpiFilter(), DB), (KpiFilter(mode="semana", weeks=(32,)), WORKBOOK), (KpiFilter(towers=("no",)), DB)],
)
def test_dashboard_from_detail_and_from_cuboid(detail, flt, profile):
    direct = build_dashboard(as_measures(detail), flt, profile, NAMES)
    rolled = build_dashboard(build_cuboid(detail).cache(), flt, profile, NAMES)
    assert list(direct) == list(rolled) and len(direct) == 15
    for name in direct:
        bags = [sorted(map(str, d[name].select(*direct[name].columns).collect())) for d in (direct, rolled)]
        assert bags[0] == bags[1], name
        assert bool(bags[0]) == (not flt.towers), name


@pytest.mark.parametrize("profile, days", [(DB, 7), (WORKBOOK, 371)])
def test_dense_tables_span_own_weeks_or_those_of_everyone(detail, profile, days):
    one = KpiFilter(mode="semana", weeks=(32,), executives=("Ana",))
    table = dashboard_tables(as_measures(detail), one, profile)["diario_torre"]()
    assert table.filter("TORRE = 'T1'").count() == days


def test_first_generation_dashboard_is_smaller(detail):
    from kpiloom import V1

    tables = build_dashboard(as_measures(detail), KpiFilter(mode="semana", weeks=(32,)), V1)
    assert "ranking_resolutividad" not in tables
    assert tables["diario_torre"].agg(F.count("*")).first()[0] == 4  # present days only
