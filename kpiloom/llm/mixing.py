"""Mixing sources to target weights by Pareto order sampling.

Each source has a target in words. What it asks beyond whole copies of all its documents is a sample:
every document draws u from a hash of itself, is ranked by its random odds u / (1 - u) divided by its odds of
inclusion, and the first ones are taken until the words are full. The size of a sample is fixed in
words; the document at its edge gives what is missing.

A source may hold a third of all rows, so nothing is placed per source in one task: rows are sorted
in ranges over source and rank, and running sums are made of sums per range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kpiloom.llm.common import written_rows
from kpiloom.operators.position import with_position
from kpiloom.session import checkpoint_folder, cut_lineage

WORD = r"[^\x20\x09-\x0D]+"
# The weights that sources take in turn, the share of all words that the mix has,
# and how often a source may be repeated at most.
WEIGHTS = (3, 1, 2)
SHARE = (3, 2)
COPIES = 2
_DIGITS = 13  # hexadecimal digits of a draw: 52 bits, which a double holds exactly


def _written(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the checkpoint folder, whose size Spark then knows."""
    folder = checkpoint_folder(spark, name)
    df.write.option("compression", "zstd").parquet(folder)
    return spark.read.parquet(folder)


def _same_source(other: str) -> Column:
    return F.col("source").eqNullSafe(F.col(other))


def source_targets(
    sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: tuple[int, int] = SHARE, copies: int = COPIES
) -> DataFrame:
    """source, source_size, weight, target, for rows (source, size).

    Sources in the order of their code points, null last, take the `weights` in turn and share
    `share` (a fraction) of all words by them. No target passes `copies` times its source's size;
    what a source cannot use is shared out again by weight, until no target is above.
    """
    spark = sizes.sparkSession
    totals = cut_lineage(sizes.groupBy("source").agg(F.sum("size").alias("source_size")))
    # Few rows beside the documents, but as many as there are sources: placed in ranges too.
    placed = with_position(totals, [F.col("source").isNull(), F.col("source")], "place")
    turn = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("place") - 1, len(weights)) + 1).cast("int"))
    weighed = _written(spark, placed.select("source", "source_size", turn.cast("long").alias("weight")), "sources")
    most = F.col("source_size") * copies
    # Each round those above their bound are set to it and the rest is shared anew. Shares only
    # rise from round to round, so whoever is bound stays bound.
    bound, left, free, full = 0, 0.0, 1, F.lit(False)
    while True:
        words, weight, capped, above = weighed.agg(
            F.coalesce(F.sum("source_size"), F.lit(0)),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0)),
            F.coalesce(F.sum(F.when(full, most)), F.lit(0)),
            F.count_if(full),
        ).first()
        if bound and above <= bound:
            break
        left, free, bound = words * share[0] / share[1] - capped, weight, above
        if not free:
            break
        full = most < F.col("weight") * left / free
        if not above and weighed.where(full).isEmpty():
            break
    target = F.when(full, most.cast("double")).otherwise(F.col("weight") * F.lit(left) / F.lit(max(free, 1)))
    return weighed.withColumn("target", target)


def running_sums(ranked: DataFrame, group: str, order: list[Column], value: str, name: str) -> DataFrame:
    """Adds the sum of `value` over all earlier rows of the group, in an order without ties.

    Rows are sorted in ranges over group and order; a range is fixed by a checkpoint. Each adds up
    inside, and starts where the sums of the ranges before it end: a number a range and group.
    """
    placed = cut_lineage(ranked.orderBy(F.col(group).asc_nulls_last(), *order).withColumn("_slot", F.monotonically_increasing_id()))
    placed = placed.withColumn("_part", F.shiftrightunsigned("_slot", 33))
    earlier = Window.partitionBy("_group").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy(F.col(group).alias("_group"), "_part")
        .agg(F.sum(value).alias("_sum"))
        .select("_group", F.col("_part").alias("_at"), F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_start"))
    )
    inside = Window.partitionBy("_part", group).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    summed = placed.withColumn("_before", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    joined = summed.join(starts, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_part") == F.col("_at")))
    return joined.withColumn(name, F.col("_start") + F.col("_before")).drop("_slot", "_part", "_group", "_at", "_sum", "_start", "_before")


def pareto_rank(draw: Column, inclusion: Column) -> Column:
    """Random odds over the odds of inclusion, for a draw strictly between 0 and 1."""
    return (draw / (1 - draw)) / (inclusion / (1 - inclusion))


def mix(
    documents: DataFrame, weights: Sequence[int] = WEIGHTS, share: tuple[int, int] = SHARE, copies: int = COPIES
) -> DataFrame:
    """For each row of `documents`: doc_id, source, size, source_size, target, copies, taken.

    size is the number of words `[^\\x20\\x09-\\x0D]+` (null text: 0), target that of the row's source
    (`source_targets`). `copies` is how often every document of the source is taken whole; taken adds what the sample
    takes once more: all of it, none, or at the sample's edge a part. So the words taken of a source
    are its target without the fraction, and no document gives more than `copies` (the parameter) times its size.

    The draw is a hash of doc_id and text, so reruns agree and rows do not depend on each other's place. Rows that
    repeat both draw the same; which of them is taken is then open, how many is not. The null source is a
    source, a null text counts as the empty one; sources without words have target 0 and take
    nothing. An empty table gives no rows; other columns are not read.
    """
    spark = documents.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    draw = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(" "), text).cast("binary"))
    # Texts are read once; what follows works on a short row a document.
    sized = written_rows(
        documents.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.col("source").cast("string").alias("source"),
            F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
            draw.alias("draw"),
        )
    )
    targets = source_targets(sized, weights, share, copies)
    wanted = F.floor("target")
    # Whole copies, then words beyond them; both are exact.
    whole = F.when(F.col("source_size") > 0, F.floor(wanted / F.greatest("source_size", F.lit(1)))).otherwise(0)
    planned = targets.select(
        F.col("source").alias("_source"), "source_size", "target", whole.cast("long").alias("copies")
    ).withColumn("beyond", F.floor("target") - F.col("copies") * F.col("source_size"))
    planned = _written(spark, planned, "targets")
    docs = sized.join(planned, _same_source("_source")).drop("_source")
    columns = ["doc_id", "source", "size", "source_size", "target", "copies"]
    drawn = (F.conv(F.substring("draw", 1, _DIGITS), 16, 10).cast("double") + 0.5) / float(1 << 4 * _DIGITS)
    in_sample = (F.col("beyond") > 0) & (F.col("size") > 0)
    sampled = (
        docs.where(in_sample)
        .withColumn("rank", pareto_rank(drawn, F.col("beyond") / F.col("source_size")))
        .select(*columns, "beyond", "rank", "draw", "_row")
    )
    # Equal draws are repeated rows: the row's key spreads them over the ranges.
    ranked = running_sums(sampled, "source", [F.asc("rank"), F.asc("draw"), F.asc("_row")], "size", "before")
    part = F.greatest(F.least(F.col("beyond") - F.col("before"), F.col("size")), F.lit(0))
    taken = ranked.withColumn("taken", F.col("copies") * F.col("size") + part)
    rest = docs.where(~in_sample).withColumn("taken", F.col("copies") * F.col("size"))
    return taken.select(*columns, "taken").union(rest.select(*columns, "taken"))
