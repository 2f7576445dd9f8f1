"""Exact top-k inner products by the threshold algorithm over sorted per-dimension lists.

Vectors are cut into blocks. In a block each dimension has its list of rows in the order of
that component, and a query reads all lists in step, from the end that its own component
favours. Rows seen are scored in full (random access); the sum over the dimensions of query
component times the value reached bounds every row not seen, and reading stops when that
bound cannot beat the k-th score. Blocks are independent; their winners are merged by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCHEMA = "query_id long, vec_id long, score long"
EXACT = 2.0**53  # a double holds every integer up to here


class Lists:
    """The rows of one block: ids in order, components, and each dimension's sorted list."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.values = ids[order], values[order]
        self.order = np.argsort(self.values, axis=0, kind="stable")
        self.sorted = np.take_along_axis(self.values, self.order, axis=0)

    def top(self, query: np.ndarray, own: int | None, k: int, first: int = 16) -> tuple[np.ndarray, np.ndarray, int]:
        """Places and scores of the k best rows other than `own`, and the depth that was read."""
        n, axes = len(self.ids), np.flatnonzero(query)
        down = query[axes] > 0
        seen, scored = np.zeros(n, bool), np.zeros(n, bool)
        best, scores = np.empty(0, np.int64), np.empty(0, self.values.dtype)
        depth, step = 0, first
        while depth < n:
            to = min(n, depth + step)
            for axis, falls in zip(axes, down, strict=True):
                part = slice(n - to, n - depth) if falls else slice(depth, to)
                seen[self.order[part, axis]] = True
            if not len(axes):  # all scores are 0: the smallest ids win
                seen[:to] = True
            fresh = np.flatnonzero(seen & ~scored)
            scored[fresh] = True
            fresh = fresh if own is None else fresh[self.ids[fresh] != own]
            best = np.concatenate([best, fresh])
            scores = np.concatenate([scores, self.values[fresh] @ query])
            keep = np.lexsort((best, -scores))[:k]
            best, scores, depth = best[keep], scores[keep], to
            reached = np.where(down, self.sorted[n - to, axes], self.sorted[to - 1, axes])
            # A row not seen can reach the bound itself, and win a tie by its id: go on at equality.
            if len(best) == k and scores[-1] > (reached * query[axes]).sum():
                break
            step = 2 * step
        return best, scores, depth


def _pair(queries: pa.Table, rows: pa.Table, k: int) -> pa.Table:
    found: tuple[list, list, list] = ([], [], [])
    if len(queries) and len(rows):
        def matrix(t: pa.Table) -> np.ndarray:
            flat = t.column("components").combine_chunks().flatten().to_numpy(zero_copy_only=False)
            return flat.reshape(len(t), -1)

        q, r = matrix(queries), matrix(rows)
        peak = float(np.abs(q.astype(np.float64)).max(initial=0)) * float(np.abs(r.astype(np.float64)).max(initial=0))
        # Doubles are exact, and fast, for all but huge components; Python's integers take those.
        kind = np.float64 if peak * max(q.shape[1], 1) < EXACT else object
        lists = Lists(rows.column("vec_id").to_numpy(), r.astype(kind))
        for own, query in zip(queries.column("query_id").to_pylist(), q.astype(kind), strict=True):
            best, scores, _ = lists.top(query, own, k)
            found[0].extend([own] * len(best))
            found[1].extend(lists.ids[best].tolist())
            found[2].extend(max(-(1 << 63), min((1 << 63) - 1, int(x))) for x in scores)
    return pa.table(
        {name: pa.array(part, pa.int64()) for name, part in zip(("query_id", "vec_id", "score"), found, strict=True)}
    )


def top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = 5,
    scale: int = 256,
    block_rows: int = 16_384,
    query_rows: int = 8_192,
) -> DataFrame:
    """For each query row its `k` best other rows: query_id, rank (from 1), vec_id, score.

    `vectors` has vec_id and embedding; components become floor(scale * x), x as double. Score
    is the integer inner product; ties go to the smaller vec_id. All rows are candidates: they
    are dealt into blocks of about `block_rows`, the queries into blocks of about `query_rows`,
    and each pair of blocks is one task's work, so memory is bounded by the two parameters
    whatever the size of the table or the values in it.

    Null vectors, and those with a null, NaN or infinite component, take no part; nor do rows
    without a vec_id. Only vectors of as many components are compared. Rows that repeat a vec_id
    are candidates each for themselves, but never for a query of that id; a repeated query row
    of equal vector is answered once. An empty vector scores 0. Scores beyond 64 bits are cut to the
    nearest long. An empty table gives no rows; other columns are not read.
    """
    plain = (
        vectors.select(
            F.col("vec_id").cast("long").alias("vec_id"),
            is_query.alias("asks"),
            F.transform("embedding", lambda x: x.cast("double")).alias("x"),
        )
        .where(
            F.col("vec_id").isNotNull()
            & F.col("x").isNotNull()
            & ~F.exists("x", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        )
        .select(
            "vec_id",
            F.coalesce("asks", F.lit(False)).alias("asks"),
            F.size("x").alias("n_dims"),
            F.transform("x", lambda x: F.floor(x * F.lit(float(scale)))).alias("components"),
        )
    )
    rows, asked = plain.agg(F.count("*"), F.count_if("asks")).first()
    blocks, query_blocks = -(-rows // block_rows) or 1, -(-asked // query_rows) or 1

    def dealt(df: DataFrame, mine: str, n: int, theirs: str, others: int) -> DataFrame:
        return df.withColumn(mine, F.pmod(F.xxhash64("vec_id", F.lit(17)), F.lit(n)).cast("int")).withColumn(
            theirs, F.explode(F.sequence(F.lit(0), F.lit(others - 1)))
        )

    queries = plain.where("asks").select(F.col("vec_id").alias("query_id"), "n_dims", "components").distinct()
    queries = dealt(queries.withColumnRenamed("query_id", "vec_id"), "q", query_blocks, "b", blocks).withColumnRenamed(
        "vec_id", "query_id"
    )
    candidates = dealt(plain.drop("asks"), "b", blocks, "q", query_blocks)
    keys = ["q", "b", "n_dims"]

    def pair(left: pa.Table, right: pa.Table) -> pa.Table:
        return _pair(left, right, k)

    best = queries.groupBy(*keys).cogroup(candidates.groupBy(*keys)).applyInArrow(pair, SCHEMA)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (
        best.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
