"""Position in a total order without a single-task window, and without a job while the frame is built."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

BUCKETS = 256
_SPAN = 1 << 40


def with_position(df: DataFrame, keys: list[Column], name: str, buckets: int = BUCKETS) -> DataFrame:
    """Add the 1-based position of each row by ascending ``keys`` (nulls first), which must leave no ties.

    A window without partition would pull all rows into one task. Here about ``buckets`` keys, chosen
    by a hash of themselves, cut the order into ranges; rows are placed inside their range, and the sizes
    of the ranges before it are added. Which keys cut follows from the keys alone, so the ranges are
    the same wherever the plan is run. Every use of ``df`` takes all of its columns, so that Spark reuses
    the shuffle below instead of making it again. A key's range is found by halving, in about ten comparisons.
    """
    columns = df.columns
    every = F.max(F.struct(*[F.col(f"`{c}`") for c in columns])).alias("every")
    keyed = df.withColumn("_key", F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)]))
    rows = keyed.agg(F.struct(F.count(F.lit(1)).alias("n"), every)).scalar()["n"]
    hashed = F.pmod(F.xxhash64("_key"), F.lit(_SPAN)) / F.lit(float(_SPAN))
    chosen = keyed.where(hashed < F.lit(float(buckets)) / rows)
    cuts = chosen.agg(F.struct(F.sort_array(F.collect_list("_key")).alias("cuts"), every)).scalar()["cuts"]
    ranged = keyed.withColumn("_cuts", cuts).withColumn("_range", _smaller("_cuts", F.col("_key"), buckets)).drop("_cuts")
    # A row for each range: few, whatever the rows.
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_size"), every)
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.col("_range").alias("_at"), F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy("_key"))
    placed = ranged.withColumn("_inside", inside).join(F.broadcast(starts), F.col("_range") == F.col("_at"))
    return placed.select(*[F.col(f"`{c}`") for c in columns], (F.col("_start") + F.col("_inside")).alias(name))


def _smaller(cuts: str, key: Column, buckets: int) -> Column:
    """How many of the sorted cuts are below the key.

    The steps reach over four times ``buckets`` cuts; were there more, those beyond would share the last range.
    """
    steps = F.array(*[F.lit(1 << k) for k in reversed(range((4 * buckets).bit_length()))])

    def halve(at: Column, step: Column) -> Column:
        # Past the end there is no cut, hence no step.
        return F.when(F.get(cuts, at + step - 1) < key, at + step).otherwise(at)

    return F.aggregate(steps, F.lit(0), halve)
