"""Half months and months as streams: totals of the batch query, and state that goes."""

from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import functions as F

from kpiloom.streaming import fortnight_windows, month_windows
from tests.test_refresh import bag
from tests.test_snapshot_months import orders

HEADERS = "FECHA timestamp_ntz, EJECUTIVO string, NUMERO_DE_PEDIDO string, STATUS_REAL string, TORRE string"


def run(spark, folder, windows, name, lateness, key="TORRE"):
    stream = spark.readStream.schema(HEADERS).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    query = (
        windows(stream, key, lateness).writeStream.format("memory").queryName(name).outputMode("append" if lateness else "complete")
        .option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    assert query.exception() is None
    return spark.table(name), query.recentProgress


def deliver(rows, folder, months):
    """A file a month, one after the other; the stream takes them by time of modification."""
    import time

    for month in months:
        rows.where(F.trunc("FECHA", "month") == month).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        time.sleep(1.1)


MONTHS = [date(2024, m, 1) for m in (8, 9, 10, 11, 12)]


@pytest.mark.parametrize("windows, closed", [(fortnight_windows, date(2024, 12, 1)), (month_windows, date(2024, 12, 1))])
def test_closed_buckets_equal_batch_and_leave_no_state(spark, folder, light, windows, closed):
    rows = orders(spark, 600, days=150)  # August to December
    deliver(rows, folder, MONTHS)
    found, progress = run(spark, folder, windows, f"{windows.__name__}_bounded", "5 days")
    batch = windows(rows)
    newest = rows.agg(F.to_date(F.max("FECHA"))).first()[0]
    assert newest == date(2024, 12, 28)
    # December's first half ended over five days before the newest day.
    edge = date(2024, 12, 16) if windows is fortnight_windows else closed
    expected = batch.where(F.col("inicio") < edge)
    assert bag(found, "inicio", "TORRE", "n") == bag(expected, "inicio", "TORRE", "n")
    still_open = batch.where(F.col("inicio") >= edge)
    state = progress[-1]["stateOperators"][0]["numRowsTotal"]
    assert state == still_open.count() > 0
    most = max(p["stateOperators"][0]["numRowsTotal"] for p in progress)
    assert most <= batch.count() / 2  # never anything like all buckets


def test_lateness_is_that_of_rows_not_of_buckets(spark, folder, light):
    """The first row of a month does not close the month before: rows that come a few days late still count."""
    rows = orders(spark, 600, days=150)
    august, september = (rows.where(F.month("FECHA") == m) for m in (8, 9))
    late = august.where("day(FECHA) > 20")
    deliver(august.where("day(FECHA) <= 20"), folder, MONTHS[:1])
    deliver(september.where("day(FECHA) = 2"), folder, MONTHS[1:2])
    deliver(late, folder, MONTHS[:1])  # within 15 days
    deliver(september.where("day(FECHA) > 20"), folder, MONTHS[1:2])
    deliver(september.where("day(FECHA) between 3 and 20"), folder, MONTHS[1:2])  # closes August
    deliver(late, folder, MONTHS[:1])  # too late now
    deliver(rows.where("month(FECHA) = 12"), folder, MONTHS[4:])
    found, progress = run(spark, folder, month_windows, "late_months", "15 days")
    # August's four towers are gone with the fifth file, and the rows that came later do not bring them back.
    assert [p["stateOperators"][0]["numRowsTotal"] for p in progress][:6] == [4, 6, 6, 8, 4, 4]
    august_found = found.where("inicio = DATE '2024-08-01'")
    expected = month_windows(august.where("day(FECHA) <= 20").union(late))
    assert bag(august_found, "inicio", "TORRE", "n") == bag(expected, "inicio", "TORRE", "n")


def test_without_a_bound_all_rows_count(spark, folder, light):
    rows = orders(spark, 200, days=60)
    deliver(rows, folder, [MONTHS[1], MONTHS[0]])
    found, _ = run(spark, folder, fortnight_windows, "unbounded", None, "EJECUTIVO")
    assert bag(found, "inicio", "EJECUTIVO", "n") == bag(fortnight_windows(rows, "EJECUTIVO"), "inicio", "EJECUTIVO", "n")


def test_half_months_begin_on_the_first_and_the_sixteenth(spark):
    rows = orders(spark, 400, days=400)
    starts = {r["inicio"] for r in fortnight_windows(rows).select("inicio").distinct().collect()}
    assert len(starts) > 24 and {s.day for s in starts} == {1, 16}
