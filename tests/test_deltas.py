"""Additive deliveries: the ledger, several streams into one target, compaction."""

from __future__ import annotations

import threading

import pytest
from pyspark.sql import functions as F

from kpiloom import WORKBOOK
from kpiloom.operators import build_cuboid, clean
from kpiloom.sources import announce
from kpiloom.streaming import add_delta, append_deltas, compact_deltas, ledger, read_delta_rows, read_deltas
from tests.test_refresh import bag, cuboid_bag, finish, halves, typed  # noqa: F401


def rows_of(cleaned, *names):
    return cleaned.where(F.col("EJECUTIVO").isin(*names))


def state(spark, target):
    cuboid = cuboid_bag(read_deltas(spark, target))
    rows = read_delta_rows(spark, target)
    # Whatever was compacted, the rows give the same counts.
    assert cuboid_bag(build_cuboid(rows)) == cuboid
    return cuboid


def test_two_streams_a_compaction_and_both_again(spark, typed, folder):  # noqa: F811
    target, cleaned = f"{folder}/target", clean(typed, WORKBOOK)
    names = [r[0] for r in cleaned.select("EJECUTIVO").distinct().orderBy("EJECUTIVO").collect()]
    assert len(names) == 3

    def deliver(stream, *who):
        raw = typed.where(F.trim("EJECUTIVO").isin(*who))
        raw.coalesce(1).write.mode("append").parquet(f"{folder}/in-{stream}")
        finish(append_deltas(spark, f"{folder}/in-{stream}", target, f"{folder}/p-{stream}", WORKBOOK, once=True))

    ana, beto, caro = (cuboid_bag(build_cuboid(rows_of(cleaned, n))) for n in names)
    deliver("a", names[0])
    deliver("b", names[1])  # also its batch 0
    assert state(spark, target) == sorted(ana + beto)
    first = compact_deltas(spark, target)
    assert sorted(first.values()) == [0, 0] and state(spark, target) == sorted(ana + beto)
    deliver("b", names[2])
    assert state(spark, target) == sorted(ana + beto + caro)
    # The same rows once more through the other stream: they add up, as new deliveries do.
    deliver("a", names[2])
    deliver("b", names[0])
    twice = cuboid_bag(build_cuboid(rows_of(cleaned, names[2]).union(rows_of(cleaned, names[2])).union(rows_of(cleaned, names[0])).union(rows_of(cleaned, names[0]))))
    assert state(spark, target) == sorted(beto + twice)
    second = compact_deltas(spark, target)
    assert sorted(second.values()) == [1, 2] and state(spark, target) == sorted(beto + twice)
    assert ledger(spark, target).count() == 5
    # A restart of either finds nothing new.
    for stream in "ab":
        finish(append_deltas(spark, f"{folder}/in-{stream}", target, f"{folder}/p-{stream}", WORKBOOK, once=True))
    assert state(spark, target) == sorted(beto + twice)


def test_what_is_not_entered_does_not_count(spark, typed, folder, monkeypatch):  # noqa: F811
    target, cleaned = f"{folder}/t", clean(typed, WORKBOOK)
    one, other = (clean(h, WORKBOOK) for h in halves(typed))
    assert add_delta(spark, target, one, "7", 0)

    def breaks(*_):
        raise OSError("lost")

    monkeypatch.setattr(announce, "put_if_absent", breaks)
    with pytest.raises(OSError):
        add_delta(spark, target, other, "7", 1)
    monkeypatch.undo()
    assert state(spark, target) == cuboid_bag(build_cuboid(one))
    assert add_delta(spark, target, other, "7", 1)  # the batch again
    assert not add_delta(spark, target, cleaned, "7", 1)  # and again: the first stays
    assert state(spark, target) == cuboid_bag(build_cuboid(cleaned))
    assert {(r["stream"], r["batch"]) for r in ledger(spark, target).collect()} == {("7", 0), ("7", 1)}


def test_compactions_at_once_lose_nothing(spark, typed, folder, monkeypatch):  # noqa: F811
    target, cleaned = f"{folder}/t", clean(typed, WORKBOOK)
    one, other = (clean(h, WORKBOOK) for h in halves(typed))
    add_delta(spark, target, one, "s", 0)
    meet, put, calls = threading.Barrier(2), announce.put_if_absent, []

    def late(session, path, content):
        calls.append(content["number"])
        if len(calls) <= 2:
            meet.wait(timeout=120)
        return put(session, path, content)

    monkeypatch.setattr(announce, "put_if_absent", late)
    done = []
    threads = [threading.Thread(target=lambda: done.append(compact_deltas(spark, target))) for _ in range(2)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    monkeypatch.undo()
    assert done == [{"s": 0}] * 2 and calls == [0, 0, 1]  # the loser merged once more, into nothing new
    assert announce.newest(spark, f"{target}/bases") == 1
    add_delta(spark, target, other, "s", 1)
    assert state(spark, target) == cuboid_bag(build_cuboid(cleaned))


def test_deliveries_with_further_columns(spark, typed, folder):  # noqa: F811
    target = f"{folder}/t"
    one, other = (clean(h, WORKBOOK) for h in halves(typed))
    add_delta(spark, target, one.withColumn("LOTE", F.lit(5)), "1e5", 0)  # names and ids that look like others
    add_delta(spark, target, other.withColumn("CANAL", F.lit("web")), "1e5", 1)
    rows = read_delta_rows(spark, target)
    assert {"LOTE", "CANAL"} <= set(rows.columns) and rows.count() == 9
    assert rows.where("LOTE = 5").count() == one.count() and rows.where("CANAL = 'web'").count() == other.count()


def test_only_folders_in_the_ledger_are_read(spark, typed, folder):  # noqa: F811
    target, cleaned = f"{folder}/t", clean(typed, WORKBOOK)
    for batch in range(3):
        add_delta(spark, target, cleaned, "s", batch)
    compact_deltas(spark, target)
    add_delta(spark, target, cleaned, "s", 3)
    frame = read_deltas(spark, target)
    frame.collect()
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan
    assert bag(frame.agg(F.sum("filas")), "sum(filas)") == ["Row(sum(filas)=36)"]
