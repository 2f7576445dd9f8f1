"""What the physical plans must and must not contain."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from catalogue import views
from catalogue.oracle import ORACLE
from catalogue.spark_queries import QUERIES as CATALOGUE
from kpiloom import KpiFilter
from kpiloom.operators import as_measures
from kpiloom.operators.counts import OWN_SPAN, daily_counts, daily_resolution
from kpiloom.plans import reports

FOLDER = "/root/testdata/sf0.001"
QUERIES = {name: run for name, run in entry_points.queries().items() if name in CATALOGUE}


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def formatted(df) -> str:
    """The plan with its filters in full."""
    execution = df._jdf.queryExecution()
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return execution.explainString(mode)


def final_plan(df) -> str:
    """The plan as run, since reuse is settled then; the sections it started from are cut."""
    df._jdf.collectToPython()
    kept, skip_below = [], None
    for line in plan_of(df).splitlines():
        depth = len(line) - len(line.lstrip(" :|"))
        if skip_below is not None and depth > skip_below:
            continue
        skip_below = depth if "== Initial Plan ==" in line else None
        if skip_below is None:
            kept.append(line)
    return "\n".join(kept)


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(CATALOGUE) == set(ORACLE)
    assert set(QUERIES) <= set(entry_points.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_python_no_cross_join_no_lone_window_over_detail(spark, name):
    plan = plan_of(QUERIES[name](spark, FOLDER))
    assert not re.search(r"PythonUDF|ArrowEval|BatchEvalPython|MapInPandas|FlatMapGroups", plan)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    lines = plan.splitlines()
    for at, line in enumerate(lines):
        if re.search(r"\bWindow \[", line) and re.search(r"windowspecdefinition\([^,]+ (ASC|DESC)", line):
            below = "\n".join(lines[at:])
            assert "HashAggregate" in below or "Scan ExistingRDD" in below, line


@pytest.mark.parametrize(
    "report",
    [
        reports.kpi_cards,
        reports.monthly_report,
        reports.monthly_counts,
        lambda m: reports.monthly_wide(m, ["Agosto"]),
        lambda m: reports.share_by(m, "TORRE"),
        lambda m: daily_counts(m, "TORRE"),
        lambda m: daily_counts(m, "EJECUTIVO", OWN_SPAN),
        lambda m: daily_resolution(m, "EJECUTIVO", OWN_SPAN),
        reports.resolution_rate,
    ],
)
def test_detail_is_scanned_once(spark, report, folder):
    views.gestiones(spark, FOLDER).write.parquet(f"{folder}/detail")
    detail = spark.read.parquet(f"{folder}/detail")
    scans = re.findall(r"FileScan parquet \[([^\]]*)\]", final_plan(report(as_measures(detail))))
    assert len(scans) == 1


@pytest.mark.parametrize("wide", [lambda m: reports.daily_wide(m, "TORRE"), reports.resolution_wide])
def test_wide_tables_of_many_days_scan_once_and_generate_little(spark, wide, folder):
    """1,014 days: found in the job that counts, and no expression for each of them before the last step."""
    days = F.explode(F.sequence(F.lit("2022-01-01").cast("date"), F.lit("2024-10-10").cast("date"))).alias("d")
    rows = spark.range(3).select(days, F.concat(F.lit("e"), "id").alias("EJECUTIVO"))
    rows = rows.withColumn("FECHA", F.col("d").cast("timestamp_ntz")).drop("d")
    rows = rows.selectExpr("*", "'p' AS NUMERO_DE_PEDIDO", "'Corregido' AS STATUS_REAL", "EJECUTIVO AS TORRE")
    rows.write.parquet(f"{folder}/detail")
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    detail = spark.read.parquet(f"{folder}/detail").mapInArrow(count, spark.read.parquet(f"{folder}/detail").schema)
    found = wide(as_measures(detail))
    assert len(found.columns) in (1014 + 2, 1014 + 3)
    assert found.count() in (3, 4) and seen.value == 3 * 1014  # read once, also by the actions that follow
    aggregates = [x for x in plan_of(found).splitlines() if "Aggregate(" in x]
    assert aggregates and max(map(len, aggregates)) < 2000


def test_columns_and_filters_reach_the_scan(spark, folder):
    views.gestiones(spark, FOLDER).withColumn("NOTA", F.lit("x")).write.parquet(f"{folder}/detail")
    detail = spark.read.parquet(f"{folder}/detail")
    report = daily_counts(as_measures(KpiFilter(towers=("ASIA",)).apply(detail)), "TORRE")
    plan = formatted(report)
    assert "NOTA" not in plan and "EJECUTIVO" not in plan
    assert "EqualTo(TORRE,ASIA)" in plan or "In(TORRE, [ASIA])" in plan
    dated = formatted(QUERIES["filter_date_range"](spark, FOLDER))
    assert "GreaterThanOrEqual(ts,2024-01-05" in dated
    assert "LessThanOrEqual(ts,2024-01-10" in dated
    assert "IsNotNull(l_shipdate)" in formatted(QUERIES["count_by_tower"](spark, FOLDER))


def test_counts_are_combined_before_the_shuffle(spark):
    for name in ("base_cuboid", "count_by_executive", "kpi_cards", "daily_count_by_tower", "monthly_count"):
        plan = plan_of(QUERIES[name](spark, FOLDER))
        assert "partial_sum" in plan or "partial_count" in plan, name


def test_no_side_is_broadcast_beyond_the_threshold(spark):
    """Joins carry no hint: without room for a broadcast they become shuffled joins."""
    size = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
        for name in ("count_by_tower", "monthly_report", "filter_allow_list_table"):
            assert "BroadcastExchange" not in plan_of(QUERIES[name](spark, FOLDER)), name
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", size)
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")


PLACING = [reports.status_mix, lambda m: reports.ranking(m, None), lambda m: reports.ranking(m, m.select("EJECUTIVO").limit(50))]


@pytest.mark.parametrize("report", PLACING)
def test_placing_everyone_starts_no_job_and_reads_once(spark, report, folder):
    views.gestiones(spark, FOLDER).write.parquet(f"{folder}/detail")
    measures = as_measures(spark.read.parquet(f"{folder}/detail"))
    context = spark.sparkContext
    context.setJobGroup(folder, "planning")
    try:
        frame = report(measures)
        frame.explain()
        assert context.statusTracker().getJobIdsForGroup(folder) == []
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    plan = final_plan(frame)
    # The allowed names of the last one are read from the detail as well, in their own right.
    assert plan.count("FileScan") <= (2 if report is PLACING[2] else 1)


def test_the_ranges_of_positions_are_the_only_forced_broadcast(spark):
    measures = views.gestiones_measures(spark, FOLDER)
    size = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plan = plan_of(reports.ranking(measures, None))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", size)
    assert len(re.findall(r"BroadcastExchange", plan)) == 1 and "_start" in plan


def test_preview_takes_the_top_without_a_full_sort(spark):
    assert "TakeOrderedAndProject" in plan_of(QUERIES["preview_detail"](spark, FOLDER))


def test_entry_runs(spark):
    assert not entry_points.entry(spark).isEmpty()
