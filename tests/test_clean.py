from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from kpiloom import DB, WORKBOOK
from kpiloom.operators.clean import DETECT, clean, detect_format, filter_allow_list, format_votes, lenient_timestamp
from kpiloom.sources import normalise_columns, read_delivery, require_columns
from kpiloom.sources.files import last_modified
from kpiloom.sources.naming import GESTIONES_SCHEMA
from tests.fixtures import HEADERS, NAMES


@pytest.mark.parametrize(
    "text, text_format, expected",
    [
        ("2025-08-04 09:00", None, datetime(2025, 8, 4, 9)),
        ("2025-08-04", None, datetime(2025, 8, 4)),
        ("2025-08-04T09:00:01", None, datetime(2025, 8, 4, 9, 0, 1)),
        ("04/08/2025", None, None),
        ("no-date", None, None),
        ("2025-02-30", None, None),
        ("04/08/2025", "dd/MM/yyyy", datetime(2025, 8, 4)),
        ("2025-08-04", "dd/MM/yyyy", None),
    ],
)
def test_lenient_dates(spark, text, text_format, expected):
    df = spark.createDataFrame([(text,)], "FECHA string")
    assert df.select(lenient_timestamp(df, "FECHA", text_format)).first()[0] == expected


@pytest.mark.parametrize("kind", ["timestamp_ntz", "timestamp", "date"])
def test_typed_dates_are_kept(spark, kind):
    df = spark.sql(f"SELECT CAST('2025-08-04' AS {kind}) AS FECHA")
    out = df.select(lenient_timestamp(df, "FECHA").alias("x"))
    assert out.dtypes == [("x", "timestamp_ntz")]
    assert out.first().x == datetime(2025, 8, 4)


def test_numbers_are_not_dates_in_scope(spark):
    df = spark.createDataFrame([(45000, "Ana", "P", "x", "T")], "FECHA int, EJECUTIVO string, NUMERO_DE_PEDIDO string, STATUS_REAL string, TORRE string")
    assert clean(df).isEmpty()


def test_minimum_month_is_a_rule(raw):
    assert clean(normalise_columns(raw), WORKBOOK).count() == 9
    assert clean(normalise_columns(raw), WORKBOOK.with_rules(min_month=1)).count() == 10


def test_allow_list_as_names_and_as_table(spark, raw):
    everyone = clean(normalise_columns(raw), WORKBOOK)
    some = filter_allow_list(everyone, ["Ana", "Caro"])
    # A name listed twice must not double rows.
    table = spark.createDataFrame([("Ana",), ("Caro",), ("Ana",), (None,)], "EJECUTIVO string")
    assert sorted(map(tuple, some.collect()), key=str) == sorted(
        map(tuple, filter_allow_list(everyone, table).select(*some.columns).collect()), key=str
    )
    assert clean(normalise_columns(raw), WORKBOOK, allowed=["Beto"]).count() == 3
    assert clean(normalise_columns(raw), WORKBOOK.with_rules(allow_list=NAMES[:1])).count() == 4


def test_further_columns_pass_through(raw):
    named = normalise_columns(raw.withColumn("Última nota", F.lit("n")))
    assert "ÚLTIMA_NOTA" in clean(named, DB).columns


def test_colliding_headers_are_an_error(spark):
    df = spark.createDataFrame([(1, 2)], "`año` int, `ano` int")
    with pytest.raises(ValueError, match="ANO"):
        normalise_columns(df)


def test_missing_columns_are_an_error(raw):
    with pytest.raises(ValueError, match="TORRE"):
        require_columns(normalise_columns(raw.drop("Torre")))


@pytest.mark.parametrize("file_format", ["csv", "parquet"])
def test_delivery_files(spark, raw, folder, file_format):
    path = f"{folder}/in"
    raw.write.format(file_format).option("header", True).save(path)
    loaded = read_delivery(spark, path, file_format)
    assert loaded.columns == ["FECHA", "EJECUTIVO", "TORRE", "STATUS_REAL", "NUMERO_DE_PEDIDO"]
    assert loaded.count() == raw.count()
    assert clean(loaded, WORKBOOK).count() == clean(normalise_columns(raw), WORKBOOK).count()
    assert last_modified(spark, path) is not None


def test_csv_keeps_leading_zeros(spark, folder):
    spark.createDataFrame([("00123", "2025-08-04", "A", "T", "S")], "`Número de pedido` string, Fecha string, Ejecutivo string, Torre string, `Status Real` string").write.option("header", True).csv(f"{folder}/in")
    assert read_delivery(spark, f"{folder}/in", "csv").first().NUMERO_DE_PEDIDO == "00123"


def test_csv_headers_are_checked_against_a_schema(spark, folder):
    open(f"{folder}/a.csv", "w").write("FECHA,EJECUTIVO,OTRA,STATUS_REAL,TORRE\n2025-08-04,Ana,P,x,T\n")
    with pytest.raises(Exception):
        read_delivery(spark, f"{folder}/a.csv", "csv", schema=GESTIONES_SCHEMA).collect()


def test_fixture_headers_are_the_required_ones(raw):
    assert raw.columns == HEADERS


FOUND = [
    # What is in the column, the format found, and what comes of it.
    (["2025-08-04 09:00", "2025-08-05", "x"], None, [datetime(2025, 8, 4, 9), datetime(2025, 8, 5), None]),
    (["08/13/2025", "08/04/2025 10:30"], "M/d/yyyy[ H:mm[:ss]]", [datetime(2025, 8, 13), datetime(2025, 8, 4, 10, 30)]),
    (["13/08/2025", "4/8/2025 9:05:01"], "d/M/yyyy[ H:mm[:ss]]", [datetime(2025, 8, 13), datetime(2025, 8, 4, 9, 5, 1)]),
    (["13.08.2025", "14.08.2025"], "d.M.yyyy[ H:mm[:ss]]", [datetime(2025, 8, 13), datetime(2025, 8, 14)]),
    (["2025/08/04 23:59", None], "yyyy/M/d[ H:mm[:ss]]", [datetime(2025, 8, 4, 23, 59), None]),
    # A mixed column: one format wins, the others are null.
    (["13/08/2025", "2025-08-04", "14/08/2025"], "d/M/yyyy[ H:mm[:ss]]", [datetime(2025, 8, 13), None, datetime(2025, 8, 14)]),
    # Readable either way: the month comes first.
    (["04/08/2025", "05/09/2025"], "M/d/yyyy[ H:mm[:ss]]", [datetime(2025, 4, 8), datetime(2025, 5, 9)]),
    # One day past 12 settles it for all.
    (["04/08/2025", "05/09/2025", "31/12/2025"], "d/M/yyyy[ H:mm[:ss]]", [datetime(2025, 8, 4), datetime(2025, 9, 5), datetime(2025, 12, 31)]),
    (["no", "", None], None, [None, None, None]),
]


@pytest.mark.parametrize("texts, text_format, expected", FOUND)
def test_the_format_is_found_from_the_column(spark, texts, text_format, expected):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, FECHA string")
    assert detect_format(df) == text_format
    found = df.select("i", lenient_timestamp(df, "FECHA", DETECT).alias("x")).orderBy("i").collect()
    assert [r["x"] for r in found] == expected


def test_votes_are_one_aggregate_over_one_column(spark, raw, folder):
    raw.write.parquet(f"{folder}/in")
    votes = format_votes(spark.read.parquet(f"{folder}/in"), "Fecha")
    plan = votes._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<Fecha:string>" in plan and plan.count("FileScan") == 1
    assert votes.first()["votes"][0] == 12


def test_cleaning_finds_the_format(spark, raw):
    named = normalise_columns(raw)
    turned = named.withColumn("FECHA", F.date_format(F.col("FECHA").try_cast("timestamp"), "dd/MM/yyyy HH:mm"))
    expected = clean(named, WORKBOOK)
    assert sorted(map(str, clean(turned, WORKBOOK, DETECT).collect())) == sorted(map(str, expected.collect()))
    typed = named.withColumn("FECHA", F.col("FECHA").try_cast("timestamp_ntz"))
    assert detect_format(typed) is None and clean(typed, WORKBOOK, DETECT).count() == 9
