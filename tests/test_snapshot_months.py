"""Snapshots month by month: merged figures, reloads that write what changed, publishers that race."""

from __future__ import annotations

import threading
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from kpiloom import DB, V1, WORKBOOK, KpiFilter
from kpiloom.columns import DIA, EJECUTIVO, FECHA, FILAS, PEDIDO, STATUS, TORRE
from kpiloom.operators import as_measures, build_cuboid
from kpiloom.operators.figures import executive_slices, figure_cells, merged_totals, number_names
from kpiloom.plans import reports, snapshot_tables, stored_kpi_cards
from kpiloom.sources import SnapshotStore, announce, snapshot
from kpiloom.sources.snapshot import NAME_PARTS, month_checksums


def orders(spark, rows=900, start="2024-08-01", days=420, executives=23):
    """Work orders over more than a year, spread by a rule; a third of them on one executive and one day."""
    i = F.col("id")
    day = F.when(i % 3 == 0, 17).otherwise(i * 7 % days)
    who = F.when(i % 3 == 1, "hot").otherwise(F.concat(F.lit("e"), i * 11 % executives))
    status = F.element_at(F.array(*map(F.lit, ("Corregido", "Capacidad", "Pendiente"))), (i % 5 % 3 + 1).cast("int"))
    return spark.range(rows).select(
        (F.to_timestamp_ntz(F.lit(start)) + F.make_dt_interval(day.cast("int"), (i % 24).cast("int"))).alias(FECHA),
        who.alias(EJECUTIVO),
        F.when(i % 10 != 0, i.cast("string")).alias(PEDIDO),
        status.alias(STATUS),
        F.concat(F.lit("T"), i % 4).alias(TORRE),
    )


FILTERS = [
    KpiFilter(),
    KpiFilter(months=("Agosto", "Enero")),
    KpiFilter(fortnight=1),
    KpiFilter(fortnight=2, towers=("T1",), years=(2024,)),
    KpiFilter(mode="semana", weeks=(1, 32, 52)),
    KpiFilter(mode="semana", weeks=(36, 40), months=("Septiembre",)),
    KpiFilter(executives=("e3", "hot", "nobody")),
    KpiFilter(executives=("e3",), fortnight=2, months=("Octubre",)),
    KpiFilter(towers=("none",)),
    KpiFilter(executives=("nobody",)),
]


@pytest.fixture(scope="module")
def published(spark, tmp_path_factory):
    store = SnapshotStore(spark, str(tmp_path_factory.mktemp("store")))
    store.publish(orders(spark))
    return store


@pytest.mark.parametrize("flt", FILTERS, ids=str)
def test_merged_figures_equal_those_from_detail(spark, published, flt):
    for profile in (DB, WORKBOOK, V1) if flt == FILTERS[0] else (DB,):
        expected = reports.kpi_cards(as_measures(flt.apply(orders(spark))), profile).collect()
        assert stored_kpi_cards(published, flt, profile).collect() == expected
    assert len(expected) == (0 if "none" in flt.towers or flt.executives == ("nobody",) else 1)


def test_figures_read_no_executive_days(published):
    for flt, kind, columns in ((FILTERS[3], "cells", {"bits"}), (FILTERS[7], "slices", {EJECUTIVO})):
        frame = stored_kpi_cards(published, flt)
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert f"/{kind}" in plan and "/cuboid" not in plan and "/detail" not in plan
        assert plan.count("FileScan") == 1 and all(c in plan for c in columns)
    # A month is cut into half months by weeks, whatever its days and executives.
    most = published.cells().groupBy("TORRE", "STATUS_REAL", F.trunc(DIA, "month")).count().agg(F.max("count")).first()[0]
    assert most <= 7
    assert snapshot_tables(published)["kpi_cards"]().collect() == stored_kpi_cards(published).collect()


def test_more_executives_than_a_bitmap_holds(spark):
    cuboid = build_cuboid(
        spark.range(70_000).select(
            F.to_timestamp_ntz(F.lit("2025-09-03")).alias(FECHA),
            F.concat(F.lit("e"), "id").alias(EJECUTIVO),
            F.lit("1").alias(PEDIDO),
            F.lit("Corregido").alias(STATUS),
            F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias(TORRE),
        )
    )
    none = spark.createDataFrame([], f"{EJECUTIVO} string, numero long")
    numbers = number_names(cuboid, none, 0).cache()
    assert numbers.agg(F.min("numero"), F.max("numero"), F.count_distinct("numero")).first() == (0, 69_999, 70_000)
    row = merged_totals(figure_cells(cuboid, numbers)).first()
    assert (row["n"], row["ejecutivos"], row["dias"]) == (70_000, 70_000, 1)
    assert merged_totals(executive_slices(cuboid)).first() == row
    later = number_names(cuboid.withColumn(EJECUTIVO, F.concat(EJECUTIVO, F.lit("0"))), numbers, 70_000)
    assert later.agg(F.min("numero"), F.count_distinct("numero")).first() == (70_000, later.count())


def test_numbering_goes_over_kept_names_and_not_over_the_cuboid(spark, folder, monkeypatch):
    seen = []

    def watched(names, count, numbered_on=snapshot.numbered_on):
        placed = numbered_on(names, count)
        plan = placed._jdf.queryExecution().executedPlan().toString()
        seen.append((names, names.storageLevel.useMemory, "InMemoryTableScan" in plan))
        return placed

    monkeypatch.setattr(snapshot, "numbered_on", watched)
    store = SnapshotStore(spark, folder)
    store.publish(orders(spark, rows=90, days=20))
    store.publish(orders(spark, rows=180, days=20, executives=40))
    assert [kept for _, *kept in seen] == [[True, True]] * 2
    assert not any(names.storageLevel.useMemory for names, *_ in seen)
    known = store._names(store.current()["names"]).collect()
    both = orders(spark, rows=90).collect() + orders(spark, rows=180, executives=40).collect()
    assert sorted(r[EJECUTIVO] for r in known) == sorted({r[EJECUTIVO] for r in both})
    assert sorted(r["numero"] for r in known) == list(range(len(known)))


def folders(store, version):
    return {(m["anio"], m["mes"]): m["folder"] for m in store.version(version)["months"]}


def everything(store, flt=FILTERS[0]):
    detail = store.detail()
    return (
        sorted(map(str, detail.select(*sorted(detail.columns)).collect())),
        sorted(map(str, store.cuboid().select(TORRE, EJECUTIVO, STATUS, DIA, "n", FILAS).collect())),
        stored_kpi_cards(store, flt).collect(),
        stored_kpi_cards(store, KpiFilter(executives=("hot", "new"))).collect(),
    )


def test_a_reload_writes_the_months_that_changed(spark, folder):
    store = SnapshotStore(spark, f"{folder}/a")
    first = orders(spark)
    store.publish(first)
    # The same rows in another order and other files: nothing is written.
    store.publish(first.repartition(5).orderBy(F.rand(3)))
    assert folders(store, 1) == folders(store, 0) and store.version(1)["names"] == store.version(0)["names"]
    # One row of one month gets another executive, one of another month its order number.
    changed = first.withColumn(EJECUTIVO, F.when(F.col(PEDIDO) == "8", "new").otherwise(F.col(EJECUTIVO)))
    rows = store.publish(changed)
    before, after = folders(store, 1), folders(store, 2)
    different = [m for m in after if after[m] != before[m]]
    assert different == [(2024, 9)] and set(after) == set(before) and rows == 900
    assert len([p for p in Path(folder, "a", "detail").iterdir() if p.is_dir()]) == 2
    full = SnapshotStore(spark, f"{folder}/b")
    full.publish(changed)
    assert everything(store) == everything(full)
    assert store.version(2)["names"]["count"] == store.version(0)["names"]["count"] + 1
    # A month that is gone is gone, one that is new is added, the others stay.
    other = changed.where("month(FECHA) <> 10").union(orders(spark, 50, "2026-01-05", 20))
    store.publish(other)
    last = folders(store, 3)
    assert {m for m in last if m not in after} == {(2026, 1)} and {m for m in after if m not in last} == {(2024, 10)}
    assert all(last[m] == after[m] for m in last if m in after)
    again = SnapshotStore(spark, f"{folder}/c")
    again.publish(other)
    assert everything(store) == everything(again)
    gone = sorted(r.path for r in store.superseded(keep=1).collect())
    assert sum("/detail/" in g for g in gone) == 2  # September of the first version, October
    assert not set(gone) & {r.path for r in store.superseded(keep=4).collect()}


def test_other_columns_change_every_month(spark, folder):
    store = SnapshotStore(spark, folder)
    store.publish(orders(spark, 60))
    store.publish(orders(spark, 60).withColumn("CANAL", F.lit("web")))
    assert not set(folders(store, 0).values()) & set(folders(store, 1).values())
    assert store.detail().select("CANAL").distinct().collect() == [("web",)]


def test_checksums_tell_nulls_and_repeats_apart(spark):
    at = "TIMESTAMP_NTZ '2025-09-01 00:00:00' AS FECHA"
    sums = [
        month_checksums(spark.sql(f"SELECT {at}, {values} FROM range({n})"), ["FECHA", "a", "b"])[2025, 9]
        for values, n in (("NULL AS a, 'x' AS b", 1), ("'x' AS a, NULL AS b", 1), ("'x' AS a, NULL AS b", 2), ("'x' AS a, NULL AS b", 3))
    ]
    assert len({str(s) for s in sums}) == 4
    assert sums[1][2] == sums[3][2] != sums[2][2] == 0  # what the xor does not see, count and sum do


def test_publishers_that_race_each_get_a_version(spark, folder, monkeypatch):
    """Both read the same newest version; each tries its number before either manifest is there."""
    store = SnapshotStore(spark, folder)
    store.publish(orders(spark, 30))
    meet, put, tries = threading.Barrier(3), announce.put_if_absent, []

    def late(session, path, content):
        tries.append((content["stream"], content["version"]))
        if len([t for t in tries if t[0] == content["stream"]]) == 1:
            meet.wait(timeout=120)
        return put(session, path, content)

    monkeypatch.setattr(announce, "put_if_absent", late)
    done = {}

    def publish(name, rows):
        done[name] = SnapshotStore(spark, folder).publish(orders(spark, rows), 0, stream=name)

    threads = [threading.Thread(target=publish, args=(f"s{n}", n)) for n in (40, 50, 60)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert done == {"s40": 40, "s50": 50, "s60": 60}
    assert sorted(v for _, v in tries)[:3] == [1, 1, 1]
    versions = [store.version(v) for v in range(4)]
    assert [v["version"] for v in versions] == [0, 1, 2, 3] and announce.newest(spark, store.manifest_path) == 3
    assert {v["stream"]: v["filas"] for v in versions[1:]} == done
    assert set(versions[3]["streams"]) == set(done)  # nobody's batch is forgotten
    assert store.detail().count() == versions[3]["filas"]
    monkeypatch.undo()
    for name, rows in done.items():  # repeats, whoever came last
        assert store.publish(orders(spark, 5), 0, stream=name) == rows
    assert store.current()["version"] == 3


def test_a_file_is_put_once(spark, folder):
    path = announce.numbered(f"{folder}/m", 0)
    assert announce.newest(spark, f"{folder}/m") is None
    wins, start = [], threading.Barrier(4)

    def put(i):
        start.wait()
        if announce.put_if_absent(spark, path, {"by": i}):
            wins.append(i)

    threads = [threading.Thread(target=put, args=(i,)) for i in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(wins) == 1 and announce.read(spark, path) == {"by": wins[0]}
    for number in range(1, 12):
        assert announce.put_if_absent(spark, announce.numbered(f"{folder}/m", number), {})
        assert announce.newest(spark, f"{folder}/m") == number


def test_the_list_of_executives_is_written_anew_now_and_then(spark, folder, monkeypatch):
    monkeypatch.setattr("kpiloom.sources.snapshot.NAME_PARTS", 2)
    assert NAME_PARTS > 2
    store = SnapshotStore(spark, folder)
    for n in range(4):
        store.publish(orders(spark, 40 + n).withColumn(EJECUTIVO, F.concat(EJECUTIVO, F.lit(str(n)))))
    names = store.current()["names"]
    assert len(names["parts"]) <= 2
    numbers = store._names(names)
    assert numbers.count() == names["count"] == numbers.select("numero").distinct().count()
    assert stored_kpi_cards(store).collect() == reports.kpi_cards(as_measures(store.detail())).collect()
