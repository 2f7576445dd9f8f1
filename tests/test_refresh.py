"""Snapshots, polling and streams."""

from __future__ import annotations

import time
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from kpiloom import WORKBOOK, KpiFilter
from kpiloom.columns import LAYOUT_ANIO, LAYOUT_MES
from kpiloom.functions.calendar_es import with_calendar
from kpiloom.operators import as_measures, build_cuboid, clean
from kpiloom.operators.counts import count_by
from kpiloom.plans import reports
from kpiloom.plans.export import export_detail
from kpiloom.plans.load import load_to_snapshot
from kpiloom.sources import SnapshotStore, hand_off, normalise_columns
from kpiloom.sources.naming import GESTIONES_SCHEMA
from kpiloom.streaming import (
    append_deltas,
    daily_windows,
    read_delta_rows,
    read_deltas,
    refresh_if_newer,
    refresh_snapshot,
    replace_on_delivery,
    stream_deliveries,
    weekly_windows,
)

COLUMNS = [f.name for f in GESTIONES_SCHEMA]


@pytest.fixture(scope="module")
def typed(raw):
    named = normalise_columns(raw)
    return named.withColumn("FECHA", F.col("FECHA").try_cast("timestamp_ntz")).select(*COLUMNS).cache()


def bag(df, *columns):
    return sorted(map(str, df.select(*columns).collect()))


def cuboid_bag(df):
    return bag(df, "TORRE", "EJECUTIVO", "STATUS_REAL", "Fecha_Dia", "n", "filas")


def deliver(typed, folder, parts):
    """Each part as one file; modification times tell their order."""
    for i, part in enumerate(parts):
        part.coalesce(1).write.mode("append").parquet(folder)
        if i + 1 < len(parts):
            time.sleep(1.1)


def halves(typed):
    first = typed.filter("EJECUTIVO = 'Ana' OR EJECUTIVO IS NULL")
    return [first, typed.subtract(first)]


def test_publish_and_read(spark, raw, folder):
    store = SnapshotStore(spark, folder)
    assert store.current() is None and store.last_updated() is None
    with pytest.raises(LookupError):
        store.detail()
    assert load_to_snapshot(raw, store, 0, WORKBOOK) == 9
    expected = clean(normalise_columns(raw), WORKBOOK)
    assert cuboid_bag(store.cuboid()) == cuboid_bag(build_cuboid(expected))
    assert bag(store.detail(), *expected.columns) == bag(expected, *expected.columns)
    assert abs((store.last_updated() - datetime.now(store.last_updated().tzinfo)).total_seconds()) < 3600 * 24
    assert load_to_snapshot(raw.filter("Torre = 'T2'"), store, 1, WORKBOOK) == 4
    assert store.current()["filas"] == 4
    old = sorted(r.path for r in store.superseded(keep=1).collect())
    # Both months lost rows, so each kind of table has two folders of the first version to remove.
    first = {m["folder"] for m in store.version(0)["months"]}
    assert len(old) == 8 and all(any(f in path for f in first) for path in old)
    assert store.superseded().isEmpty()
    assert load_to_snapshot(raw, store, 1, WORKBOOK) == 4 and store.current()["version"] == 1  # a repeat
    store.register_views()
    assert spark.table("gestiones").count() == 4
    assert spark.table("gestiones_cuboid").agg(F.sum("filas")).first()[0] == 4


def test_hand_off(spark, typed):
    kept = hand_off(clean(typed, WORKBOOK), "filtradas")
    assert spark.table("filtradas").count() == 9 and kept.is_cached
    kept.unpersist()


def test_empty_snapshot(spark, raw, folder):
    store = SnapshotStore(spark, folder)
    assert load_to_snapshot(raw.filter("false"), store, 0, WORKBOOK) == 0
    assert store.cuboid().isEmpty() and reports.kpi_cards(store.cuboid()).isEmpty()
    assert store.detail().isEmpty() and "TORRE" in store.detail().columns
    store.register_views()
    assert spark.table("gestiones").isEmpty()


def test_a_reader_outlives_the_next_version_and_a_repeat(spark, raw, folder):
    store = SnapshotStore(spark, folder)
    load_to_snapshot(raw, store, 0, WORKBOOK)
    open_reader = store.detail()
    store.publish(clean(normalise_columns(raw), WORKBOOK), 0, stream="another")
    load_to_snapshot(raw.filter("false"), store, 0, WORKBOOK)
    assert open_reader.count() == 9 and store.current()["version"] == 1


def test_columns_of_the_layout_names_survive(spark, raw, folder):
    store = SnapshotStore(spark, folder)
    load_to_snapshot(raw.withColumns({"Mes": F.lit("x"), "Anio": F.lit("y")}), store, 0, WORKBOOK)
    found = store.detail().select("MES", "ANIO").distinct().collect()
    assert [tuple(r) for r in found] == [("x", "y")]
    august = export_detail(with_calendar(KpiFilter(months=("Agosto",)).apply(store.detail())))
    assert {"MES", "ANIO", " Mes"} <= set(august.columns) and august.count() == 6


def test_month_filters_skip_folders(spark, raw, folder):
    store = SnapshotStore(spark, folder)
    load_to_snapshot(raw, store, 0, WORKBOOK)
    detail = store.detail()
    for flt in (KpiFilter(months=("Agosto",)), KpiFilter(mode="semana", weeks=(32,))):
        chosen = flt.apply(detail)
        scan = chosen._jdf.queryExecution().executedPlan().toString()
        assert LAYOUT_MES in scan.split("PartitionFilters: [")[1].split("]")[0]
        read = {r[0] for r in chosen.select(F.input_file_name()).distinct().collect()}
        assert read and all("=8/" in f for f in read)
        assert chosen.count() == flt.apply(detail.drop(LAYOUT_ANIO, LAYOUT_MES)).count()
    one = KpiFilter(months=("Agosto",)).apply(store.cuboid())
    assert all("=8/" in r[0] for r in one.select(F.input_file_name()).distinct().collect())


def test_failed_refresh_keeps_the_last_snapshot(spark, typed, folder):
    store = SnapshotStore(spark, folder)
    assert refresh_snapshot(store, lambda: typed, WORKBOOK)
    before = store.current()

    def unreachable():
        raise OSError("source away")

    broken = typed.withColumn("FECHA", F.raise_error(F.lit("bad block")).cast("timestamp_ntz"))
    assert not refresh_snapshot(store, unreachable, WORKBOOK)
    assert not refresh_snapshot(store, lambda: broken, WORKBOOK)
    assert store.current() == before
    assert store.detail().count() == 9
    assert refresh_snapshot(store, lambda: typed.filter("TORRE = 'T1'"), WORKBOOK)
    assert store.current()["version"] == before["version"] + 1
    assert store.detail().count() == 5


def test_reload_only_if_newer(spark, typed, folder):
    source, store = f"{folder}/in", SnapshotStore(spark, f"{folder}/store")
    loads = []

    def load():
        loads.append(1)
        return spark.read.parquet(source)

    assert refresh_if_newer(store, source, load, WORKBOOK) is None  # nothing there yet
    typed.write.parquet(source)
    seen = refresh_if_newer(store, source, load, WORKBOOK)
    assert seen is not None and len(loads) == 1
    assert refresh_if_newer(store, source, load, WORKBOOK, seen) == seen and len(loads) == 1
    time.sleep(1.1)
    typed.filter("TORRE = 'T2'").write.mode("overwrite").parquet(source)
    assert refresh_if_newer(store, source, load, WORKBOOK, seen) > seen
    assert store.detail().count() == 4


def test_each_delivery_replaces_the_last(spark, typed, folder):
    source, store = f"{folder}/in", SnapshotStore(spark, f"{folder}/store")
    last = typed.filter("TORRE = 'T1'")
    deliver(typed, source, [typed, typed, last])
    for _ in range(2):  # a restart finds nothing new
        query = replace_on_delivery(spark, source, store, f"{folder}/progress", WORKBOOK, once=True)
        query.awaitTermination()
        assert query.exception() is None
        assert store.current()["version"] == 2
        assert cuboid_bag(store.cuboid()) == cuboid_bag(build_cuboid(clean(last, WORKBOOK)))


def test_deltas_add_up(spark, typed, folder):
    source, target = f"{folder}/in", f"{folder}/deltas"
    parts = halves(typed)
    deliver(typed, source, parts[:1])
    append_deltas(spark, source, target, f"{folder}/progress", WORKBOOK, once=True, max_files=1).awaitTermination()
    deliver(typed, source, parts[1:])
    append_deltas(spark, source, target, f"{folder}/progress", WORKBOOK, once=True, max_files=1).awaitTermination()
    assert cuboid_bag(read_deltas(spark, target)) == cuboid_bag(build_cuboid(clean(typed, WORKBOOK)))


def finish(query):
    query.awaitTermination()
    assert query.exception() is None


def test_raw_headers_other_order_and_further_columns_stream(spark, raw, folder):
    """What a batch load understands a stream understands too, in CSV and Parquet."""
    expected = cuboid_bag(build_cuboid(clean(normalise_columns(raw), WORKBOOK)))
    other_order = raw.select(F.lit("k").alias("Canal"), *reversed(raw.columns))
    for kind, rows in (("parquet", raw), ("csv", other_order)):
        writer = rows.coalesce(1).write.format(kind)
        (writer.option("header", True) if kind == "csv" else writer).save(f"{folder}/{kind}/in")
        store = SnapshotStore(spark, f"{folder}/{kind}/store")
        arguments = (spark, f"{folder}/{kind}/in")
        finish(replace_on_delivery(*arguments, store, f"{folder}/{kind}/p", WORKBOOK, once=True, file_format=kind))
        assert store.current()["filas"] == 9
        if kind == "parquet":
            assert cuboid_bag(store.cuboid()) == expected
        else:
            assert store.detail().select("CANAL").distinct().collect() == [("k",)]
        finish(append_deltas(*arguments, f"{folder}/{kind}/d", f"{folder}/{kind}/q", WORKBOOK, True, file_format=kind))
        assert read_deltas(spark, f"{folder}/{kind}/d").agg(F.sum("filas")).first()[0] == 9
        assert export_detail(read_delta_rows(spark, f"{folder}/{kind}/d")).count() == 9


def test_a_delivery_without_a_required_column_fails_and_the_last_stays(spark, raw, folder):
    store = SnapshotStore(spark, f"{folder}/store")
    assert refresh_snapshot(store, lambda: raw, WORKBOOK)  # raw headers
    assert not refresh_snapshot(store, lambda: raw.drop("Torre"), WORKBOOK)
    raw.drop("Torre").coalesce(1).write.parquet(f"{folder}/in")
    query = replace_on_delivery(spark, f"{folder}/in", store, f"{folder}/p", WORKBOOK, once=True)
    with pytest.raises(Exception, match="required columns missing"):
        query.awaitTermination()
    assert store.current()["version"] == 0 and store.detail().count() == 9


def test_a_new_progress_folder_is_served(spark, typed, folder):
    source, store = f"{folder}/in", SnapshotStore(spark, f"{folder}/store")
    deliver(typed, source, [typed, typed])
    finish(replace_on_delivery(spark, source, store, f"{folder}/p1", WORKBOOK, once=True))
    typed.filter("TORRE = 'T2'").coalesce(1).write.parquet(f"{folder}/later")
    finish(replace_on_delivery(spark, f"{folder}/later", store, f"{folder}/p2", WORKBOOK, once=True))
    assert store.current()["version"] == 2 and store.detail().count() == 4


@pytest.mark.parametrize("windows, name", [(daily_windows, "day"), (weekly_windows, "week")])
def test_streamed_windows_equal_batch(spark, typed, folder, windows, name):
    source = f"{folder}/in"
    deliver(typed, source, list(reversed(halves(typed))))  # out of order: late rows count too
    stream = clean(stream_deliveries(spark, source, max_files=1), WORKBOOK)
    query = (
        windows(stream).writeStream.format("memory").queryName(f"windows_{name}").outputMode("complete")
        .option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    batch = windows(clean(typed, WORKBOOK))
    assert bag(spark.table(f"windows_{name}"), "inicio", "TORRE", "n") == bag(batch, "inicio", "TORRE", "n")


def test_watermark_on_zoneless_dates(spark, typed, folder):
    typed.write.parquet(f"{folder}/in")
    stream = clean(stream_deliveries(spark, f"{folder}/in"), WORKBOOK)
    query = (
        daily_windows(stream, lateness="1 day").writeStream.format("memory").queryName("bounded")
        .outputMode("append").option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    # Closed days only; the newest is still open.
    assert spark.table("bounded").count() == daily_windows(clean(typed, WORKBOOK)).count() - 1


def test_weeks_start_on_monday(typed):
    starts = [r.inicio for r in weekly_windows(clean(typed, WORKBOOK)).collect()]
    assert starts and all(day.weekday() == 0 for day in starts)


def test_streaming_cuboid_equals_reports_from_detail(typed):
    detail = clean(typed, WORKBOOK)
    assert bag(count_by(build_cuboid(detail), "TORRE"), "TORRE", "n") == bag(
        count_by(as_measures(detail), "TORRE"), "TORRE", "n"
    )
