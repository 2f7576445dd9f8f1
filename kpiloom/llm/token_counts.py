"""Exact histogram of encoded lengths, and what it answers for every context limit."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kpiloom.session import cut_lineage

# Where the public vocabularies lie; files are read in the tasks and never copied.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the split pattern that belongs to the byte-level vocabularies.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


@lru_cache(maxsize=2)
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    return tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def encoded_lengths(documents: DataFrame, text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """One row (n_tokens) for each row of `documents`; null and empty texts have 0 tokens."""

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(vocabulary).encode_ordinary
        for batch in batches:
            counts = [len(encode(t)) if t else 0 for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(counts, pa.int64())], ["n_tokens"])

    return documents.select(F.col(text)).mapInArrow(lengths, "n_tokens long")


def length_histogram(lengths: DataFrame, width: int = 1024) -> DataFrame:
    """A row for each length that occurs, with sums from both ends.

    n_tokens, n_docs (of that length), docs_up_to and tokens_up_to (that length or less),
    docs_over and tokens_over (more), share_up_to (exact quantile: the smallest length whose
    share is q or more is the q-quantile), and truncated_total, the tokens left when every
    document is cut at n_tokens.

    Rows are counted per length before any shuffle, so lengths that many documents share cost
    nothing extra. The running sums go in two steps, over ranges of `width` lengths and inside
    each range, so no task gets all lengths; what meets in one place is one row a range.
    An empty table gives no rows.
    """
    # Used twice below: written down, since the encoding before it would else run twice.
    counts = cut_lineage(lengths.groupBy("n_tokens").agg(F.count("*").alias("n_docs"))).withColumn(
        "part", F.floor(F.col("n_tokens") / width)
    )
    ranges = counts.groupBy("part").agg(
        F.sum("n_docs").alias("docs"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("tokens")
    )
    below = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    ranges = ranges.select(
        "part",
        F.coalesce(F.sum("docs").over(below), F.lit(0)).alias("docs_before"),
        F.coalesce(F.sum("tokens").over(below), F.lit(0)).alias("tokens_before"),
        F.sum("docs").over(whole).alias("docs"),
        F.sum("tokens").over(whole).alias("tokens"),
    )
    inside = Window.partitionBy("part").orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    up_to = counts.join(ranges, "part").select(
        "n_tokens",
        "n_docs",
        (F.col("docs_before") + F.sum("n_docs").over(inside)).alias("docs_up_to"),
        (F.col("tokens_before") + F.sum(F.col("n_docs") * F.col("n_tokens")).over(inside)).alias("tokens_up_to"),
        "docs",
        "tokens",
    )
    return up_to.select(
        "n_tokens",
        "n_docs",
        "docs_up_to",
        "tokens_up_to",
        (F.col("docs") - F.col("docs_up_to")).alias("docs_over"),
        (F.col("tokens") - F.col("tokens_up_to")).alias("tokens_over"),
        (F.col("docs_up_to") / F.col("docs")).alias("share_up_to"),
        (F.col("tokens_up_to") + F.col("n_tokens") * (F.col("docs") - F.col("docs_up_to"))).alias("truncated_total"),
    )


def at_limits(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """Documents over and tokens left for any context limits, lengths that occur or not.

    limit, docs_over (documents longer than the limit), tokens_left (each document cut there).
    """
    wanted = [
        F.struct(
            F.lit(limit).cast("long").alias("limit"),
            F.coalesce(F.sum(F.when(F.col("n_tokens") > limit, F.col("n_docs"))), F.lit(0)).alias("docs_over"),
            F.coalesce(F.sum(F.least(F.col("n_tokens"), F.lit(limit)) * F.col("n_docs")), F.lit(0)).alias("tokens_left"),
        )
        for limit in limits
    ]
    return histogram.agg(F.array(*wanted).alias("answers")).select(F.inline("answers"))
