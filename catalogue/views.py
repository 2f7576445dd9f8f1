"""The given tables in the shape of the work-order model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kpiloom.columns import (
    CAPACIDAD,
    CORREGIDO,
    EJECUTIVO,
    FECHA,
    PEDIDO,
    STATUS,
    TORRE,
)
from kpiloom.config import DB
from kpiloom.operators.clean import clean
from kpiloom.operators.cuboid import as_measures

PENDIENTE = "Pendiente"
EVENTS = DB.with_rules(min_month=1)


# The columns in use. Stating them spares a job per table to read them off the files.
SCHEMAS = {
    "lineitem": (
        "l_orderkey bigint, l_suppkey bigint, l_linenumber int, l_returnflag string,"
        " l_shipdate timestamp_ntz"
    ),
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int",
    "nation": "n_nationkey int, n_regionkey int",
    "region": "r_regionkey int, r_name string",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string",
}


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")


def lines(spark: SparkSession, folder: str) -> DataFrame:
    """Work orders with the line number, unclean.

    The dimensions are joined with each other first, so the lines are joined once. Which
    join it is, Spark decides on real sizes: suppliers grow with the data.
    """
    towers = (
        _table(spark, folder, "supplier")
        .join(_table(spark, folder, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(_table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select("s_suppkey", "s_name", "r_name")
    )
    flag = F.col("l_returnflag")
    status = F.when(flag == "R", CORREGIDO).when(flag == "A", CAPACIDAD).when(flag == "N", PENDIENTE)
    line = F.col("l_linenumber")
    return (
        _table(spark, folder, "lineitem")
        .join(towers, F.col("l_suppkey") == F.col("s_suppkey"))
        .select(
            F.col("l_shipdate").alias(FECHA),
            F.col("s_name").alias(EJECUTIVO),
            F.when(line == 7, F.lit(None)).otherwise(F.col("l_orderkey").cast("string")).alias(PEDIDO),
            status.alias(STATUS),
            F.col("r_name").alias(TORRE),
            line.alias("linea"),
        )
    )


def gestiones_raw(spark: SparkSession, folder: str) -> DataFrame:
    return lines(spark, folder).drop("linea")


def gestiones(spark: SparkSession, folder: str) -> DataFrame:
    return clean(gestiones_raw(spark, folder))


def gestiones_measures(spark: SparkSession, folder: str) -> DataFrame:
    return as_measures(gestiones(spark, folder))


def first_names(spark: SparkSession, folder: str, count: int) -> list[str]:
    """The first supplier names, the stand-in for a configured list of executives."""
    names = _table(spark, folder, "supplier").select("s_name").orderBy("s_name").limit(count)
    return [row[0] for row in names.collect()]


def eventos(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.col("event_type")
    status = F.when(kind == "purchase", CORREGIDO).when(kind == "error", CAPACIDAD).otherwise(PENDIENTE)
    raw = _table(spark, folder, "events").select(
        F.col("ts").alias(FECHA),
        F.col("user_id").cast("string").alias(EJECUTIVO),
        F.col("event_id").cast("string").alias(PEDIDO),
        status.alias(STATUS),
        kind.alias(TORRE),
    )
    return clean(raw, EVENTS)


def eventos_measures(spark: SparkSession, folder: str) -> DataFrame:
    return as_measures(eventos(spark, folder))
