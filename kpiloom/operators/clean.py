"""From a loaded table to the rows the reports are about."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kpiloom.columns import EJECUTIVO, FECHA, LAYOUT_MES, STATUS, TORRE
from kpiloom.config import DB, Profile
from kpiloom.functions.text import strip


# Text formats that a column may be found to have; None is ISO form. The first of those that
# read equally many values is taken, so a column of days up to 12 throughout is read month first.
DATE_FORMATS = (
    None,
    "M/d/yyyy[ H:mm[:ss]]",
    "d/M/yyyy[ H:mm[:ss]]",
    "yyyy/M/d[ H:mm[:ss]]",
    "M-d-yyyy[ H:mm[:ss]]",
    "d-M-yyyy[ H:mm[:ss]]",
    "d.M.yyyy[ H:mm[:ss]]",
    "yyyyMMdd[ HH:mm[:ss]]",
)
DETECT = "detect"  # in place of a text format: the one that reads most of the column


def _parsed(text: Column, text_format: str | None) -> Column:
    if text_format is None:
        return text.try_cast("timestamp_ntz")
    return F.try_to_timestamp(text, F.lit(text_format)).cast("timestamp_ntz")


def format_votes(df: DataFrame, name: str = FECHA, candidates: Sequence[str | None] = DATE_FORMATS) -> DataFrame:
    """One row: how many values each candidate reads, in the order given. One aggregate over one column."""
    text = F.col(name).cast("string")
    votes = [F.count(_parsed(text, c)) for c in candidates]
    return df.agg(F.array(*votes).alias("votes"))


def detect_format(df: DataFrame, name: str = FECHA, candidates: Sequence[str | None] = DATE_FORMATS) -> str | None:
    """The candidate that reads most values of a text column; a job over that column.

    A column has one format: values in any other become null when it is applied. Ties go to the
    candidate named first; ISO form if none reads a value, or the column is no text.
    """
    if not isinstance(df.schema[name].dataType, T.StringType):
        return None
    votes = format_votes(df, name, candidates).first()["votes"]
    best = max(range(len(candidates)), key=lambda i: (votes[i], -i))
    return candidates[best] if votes[best] else None


def lenient_timestamp(df: DataFrame, name: str = FECHA, text_format: str | None = None) -> Column:
    """The column as zone-less timestamp; what cannot be read becomes null.

    Text is read in ISO form, in the one ``text_format`` given, or with ``DETECT`` in the one found
    in the column. A column that is a timestamp already is returned as it is, which keeps its
    filters on the file scan.
    """
    column = F.col(name)
    kind = df.schema[name].dataType
    if isinstance(kind, T.TimestampNTZType):
        return column
    if isinstance(kind, (T.TimestampType, T.DateType)):
        return column.cast("timestamp_ntz")
    if text_format == DETECT:
        text_format = detect_format(df, name)
    return _parsed(column.cast("string"), text_format)


def filter_allow_list(df: DataFrame, allowed: Sequence[str] | DataFrame, key: str = EJECUTIVO) -> DataFrame:
    """Rows whose key is allowed: a literal list, or a table with a column of that name."""
    if isinstance(allowed, DataFrame):
        # Repeated names go before they are moved. Whether the list is small enough to
        # broadcast is Spark's call, on its real size; a hot name in a shuffled join is split.
        return df.join(allowed.select(key).distinct(), key, "left_semi")
    return df.filter(F.col(key).isin(list(allowed)))


def clean(
    df: DataFrame,
    profile: Profile = DB,
    text_format: str | None = None,
    allowed: Sequence[str] | DataFrame | None = None,
) -> DataFrame:
    """Read dates, require date, executive, tower and status, and keep the months in scope.

    The order number may be null. ``allowed`` overrides the profile's allow-list.
    """
    if not isinstance(df.schema[FECHA].dataType, T.TimestampNTZType):
        df = df.withColumn(FECHA, lenient_timestamp(df, FECHA, text_format))
    # Stated one by one, since na.drop() does not reach the file scan.
    present = [F.col(c).isNotNull() for c in (FECHA, EJECUTIVO, TORRE, STATUS)]
    if profile.min_month > 1:
        month = F.col(LAYOUT_MES) if LAYOUT_MES in df.columns else F.month(FECHA)
        present.append(month >= profile.min_month)
    df = df.filter(reduce(and_, present))
    if profile.trim:
        df = df.withColumns({c: strip(F.col(c)) for c in (EJECUTIVO, TORRE, STATUS)})
        df = df.filter((F.col(EJECUTIVO) != "") & (F.col(TORRE) != ""))
    allowed = profile.allow_list if allowed is None else allowed
    return df if allowed is None else filter_allow_list(df, allowed)
