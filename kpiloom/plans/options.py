"""Values offered by the selectors, sorted, and the date bounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpiloom.columns import DIA
from kpiloom.config import DB, Profile
from kpiloom.functions.calendar_es import iso_week, month_name_of, week_label


def month_options(measures: DataFrame, profile: Profile = DB) -> DataFrame:
    """``value, orden``: months by number, or by the first day they appear."""
    number = F.month(DIA).alias("orden")
    if profile.months_by_number:
        offered = measures.select(number).distinct()
        return offered.select(month_name_of(F.col("orden")).alias("value"), "orden").orderBy("orden")
    first = measures.groupBy(number).agg(F.min(DIA).alias("primera"))
    offered = first.select(month_name_of(F.col("orden")).alias("value"), F.col("primera").alias("orden"))
    return offered.orderBy("orden")


def week_options(measures: DataFrame, profile: Profile = DB) -> DataFrame:
    """``value, label``; a week number has one label per year it occurs in."""
    days = measures.select(DIA).distinct()
    value = iso_week(F.col(DIA))
    label = week_label(F.col(DIA)) if profile.week_columns else F.concat(F.lit("Semana "), value.cast("string"))
    offered = days.select(value.cast("bigint").alias("value"), label.alias("label")).distinct()
    return offered.orderBy("value", "label")


def as_options(options: DataFrame, label: str = "label", value: str = "value") -> DataFrame:
    """One struct column ``option`` of label and value."""
    return options.select(F.struct(F.col(label).alias("label"), F.col(value).alias("value")).alias("option"))


def key_options(measures: DataFrame, key: str) -> DataFrame:
    return measures.select(F.col(key).alias("value")).distinct().orderBy("value")


def date_bounds(measures: DataFrame) -> DataFrame:
    """One row ``min_fecha, max_fecha``."""
    return measures.agg(F.min(DIA).alias("min_fecha"), F.max(DIA).alias("max_fecha"))
