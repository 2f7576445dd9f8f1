"""File deliveries: CSV with a header row, or Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kpiloom.sources.naming import normalise_columns, require_columns

CSV_NULL = "\u0000"


def read_delivery(
    spark: SparkSession,
    path: str,
    file_format: str = "parquet",
    schema: T.StructType | None = None,
    options: dict[str, str] | None = None,
) -> DataFrame:
    """A delivery with normalised, checked column names.

    CSV columns are text unless a schema is given: nothing is inferred, so no pass over
    the data is spent on it and order numbers keep their leading zeros.
    """
    reader = spark.read.format(file_format)
    if file_format == "csv":
        # With a schema, headers are compared with it instead of being overruled by it.
        # Spark reads both an absent and a quoted empty text as null unless null has a
        # mark of its own; a blank status must stay a blank status.
        reader = reader.options(header=True, enforceSchema=False, nullValue=CSV_NULL)
    if schema is not None:
        reader = reader.schema(schema)
    return require_columns(normalise_columns(reader.options(**(options or {})).load(path)))


def last_modified(spark: SparkSession, path: str):
    """Newest modification time below ``path``, from the file listing; no content is read."""
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return listing.agg(F.max("modificationTime")).first()[0]
