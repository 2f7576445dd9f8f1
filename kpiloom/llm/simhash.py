"""SimHash near duplicates by tiled exact comparison.

Fingerprints are compared exactly, in tiles of one population count. Two numbers that differ in
at most r bits have population counts at most r apart, so pairs of tiles further apart are never
formed. Inside a pair of tiles numpy does exclusive-or and counts bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpiloom.llm.common import pieces_of, with_row_id
from kpiloom.llm.components import connected_components
from kpiloom.llm.flat import text_parts
from kpiloom.session import cut_lineage

SEED = 42  # fixed value
TILE = 16_384
PART = 1 << 20  # bytes of a text whose words are held as objects
TASK_PAIRS = 1 << 28  # comparisons that make a task


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """SimHash of one text, as a signed long; see `fingerprints`."""
    counts, total = np.zeros(64, np.int64), 0
    for hashes in _shingle_hashes(text, shingle):
        bits = np.unpackbits(np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
        total += len(hashes)
    return int(_pack(counts[None] * 2 > total)[0]) if total else 0


def _shingle_hashes(text: str | None, shingle: int) -> Iterator[list[int]]:
    """The hashes of all shingles, those of one part of the text at a time."""
    # bytes.lower changes A-Z only, and bytes.split cuts at ASCII white space only.
    digest = xxhash.xxh64_intdigest
    words: list[bytes] = []
    few = True
    for part in text_parts((text or "").encode().lower(), PART):
        words += part.split()
        if len(words) < shingle:
            continue
        few = False
        joined = b" ".join(words)
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = [0, *ends[: len(words) - shingle].tolist()]
        yield [digest(joined[a:b], SEED) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=True)]
        words = words[len(words) - shingle + 1 :]
    if few and words:
        yield [digest(b" ".join(words), SEED)]


def _pack(bits: np.ndarray) -> np.ndarray:
    return np.packbits(bits, axis=1, bitorder="little").view(np.int64).reshape(-1)


def fingerprints(documents: DataFrame, shingle: int = 4, numbered: bool = False) -> DataFrame:
    """The rows of `documents` with `_row` and `_fp` (signed long) in place of the text.

    Words `[^\\x20\\x09-\\x0D]+` of the text in lower case (A-Z only), shingles of `shingle` words
    joined by a space, repeats included; a text of fewer words is one shingle. A bit is set if
    over half the XXH64 (seed 42) values have it. Null and empty texts have fingerprint 0.
    `numbered` documents have their `_row`, others are given one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces_of(whole, "text"):
                found = [fingerprint(t, shingle) for t in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_row"), batch.column("doc_id"), pa.array(found, pa.int64())],
                    ["_row", "doc_id", "_fp"],
                )

    rows = documents if numbered else with_row_id(documents)
    rows = rows.select("_row", F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "_row long, doc_id long, _fp long")


def _forest(left: np.ndarray, right: np.ndarray, same: bool, distance: int) -> list[tuple[int, int]]:
    """Links within two tiles, less those that others of them already imply.

    Rows of `left` are compared with all of `right`, one row at first, then ever more at a time. Pairs
    already in one set are left out before any is looked at by itself, so what is looked at follows the rows and not
    the pairs. What is returned spans the same components, with fewer links than rows.
    """
    parent = np.arange(len(left) + len(right))
    links: list[tuple[int, int]] = []
    most = max(1, (1 << 18) // max(1, len(right)))
    i, step, stale = 0, 1, False
    while i < len(left):
        x, y = np.nonzero(np.bitwise_count(left[i : i + step, None] ^ right[None, :]) <= distance)
        x += i
        i, step = i + step, min(2 * step, most)
        if same:
            x, y = x[x < y], y[x < y]
        if not len(x):
            continue
        while stale and not np.array_equal(up := parent[parent], parent):
            parent = up
        stale = False
        a, b = parent[x], parent[y if same else len(left) + y]
        apart = np.flatnonzero(a != b)
        if not len(apart):
            continue
        sets: dict[int, int] = {}  # of this step: sets by the root they went to

        def root(k: int) -> int:
            while (up := sets.get(k, k)) != k:
                sets[k] = k = sets.get(up, up)
            return k

        for u, v, p, q in zip(a[apart].tolist(), b[apart].tolist(), x[apart].tolist(), y[apart].tolist(), strict=True):
            ru, rv = root(u), root(v)
            if ru != rv:
                sets[ru] = rv
                links.append((int(left[p]), int(right[q])))
        for k in list(sets):
            parent[k] = root(k)
        stale = True
    return links


def near_pairs(values: DataFrame, distance: int = 4, tile: int = TILE) -> DataFrame:
    """Links (a, b) that connect the distinct longs `_fp` of `values` as all pairs within `distance` bits do.

    Each population count (65 at most) is dealt into tiles of about `tile` values by a hash, so
    a tile's size is bounded; each pair of tiles whose counts are near enough is one row of
    work with its two tiles in it.
    """
    distinct = values.select("_fp").distinct().withColumn("p", F.bit_count("_fp").cast("int"))
    distinct = cut_lineage(distinct)
    sizes = {p: n for p, n in distinct.groupBy("p").count().collect()}
    tiles = {p: -(-n // tile) for p, n in sizes.items()}
    if not tiles:
        return distinct.selectExpr("_fp a", "_fp b")
    count = F.create_map(*[F.lit(x) for item in tiles.items() for x in item])
    split = distinct.withColumn("s", F.pmod(F.xxhash64("_fp", F.lit(5)), count[F.col("p")]).cast("int"))
    packed = cut_lineage(split.groupBy("p", "s").agg(F.collect_list("_fp").alias("fps")))

    def others(sign: int):
        """The tiles (q, t) of counts up to `distance` above (or below) p."""
        near = F.transform(F.sequence(F.lit(0), F.lit(distance)), lambda d: F.col("p") + sign * d)
        return F.flatten(
            F.transform(
                F.filter(near, lambda q: count[q].isNotNull()),
                lambda q: F.transform(F.sequence(F.lit(0), count[q] - 1), lambda t: F.struct(q.alias("q"), t.alias("t"))),
            )
        )

    # As many tasks as the comparisons are worth, whatever the bytes; a stated number is not joined into fewer.
    compared = sum(n * sizes.get(p + d, 0) for p, n in sizes.items() for d in range(distance + 1))
    pairs = sum(n * tiles.get(p + d, 0) for p, n in tiles.items() for d in range(distance + 1))
    tasks = max(1, min(pairs, compared // TASK_PAIRS))
    left = packed.select("p", "s", "fps", F.explode(others(1)).alias("o")).selectExpr("p", "s", "o.q q", "o.t t", "fps")
    right = packed.select("p", "s", "fps", F.explode(others(-1)).alias("o")).selectExpr(
        "o.q p", "o.t s", "p q", "s t", "fps other"
    )
    keys = ["p", "s", "q", "t"]
    work = left.where("p < q or s <= t").repartition(tasks, *keys).join(right.repartition(tasks, *keys), keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                a, b = (batch.column(c)[row].values.to_numpy().view(np.uint64) for c in ("fps", "other"))
                key = [batch.column(c)[row].as_py() for c in keys]
                links = np.array(_forest(a, b, key[:2] == key[2:], distance), np.uint64).reshape(-1, 2).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1])], ["a", "b"])

    return work.mapInArrow(run, "a long, b long")


def near_duplicates(documents: DataFrame, shingle: int = 4, distance: int = 4, numbered: bool = False) -> DataFrame:
    """For each row of `documents`: _row, doc_id, fingerprint (16 hex digits), component_id, root (one for each component).

    Rows link when their fingerprints differ in at most `distance` bits; component_id is the
    smallest doc_id that a row reaches over links, its own included. Equal fingerprints are one
    value from the start, so groups of copies cost one comparison. All links count; none is
    lost to a cap. Null and empty texts have fingerprint 0 and link like any other. Repeated
    rows each give a row. A null doc_id gives a row that links, but is never the smallest; a
    component of nulls only has a null component_id. An empty table gives no rows. Other
    columns are not read, but for `_row` if they are `numbered`.
    """
    rows = cut_lineage(fingerprints(documents, shingle, numbered))
    members = rows.groupBy("_fp").agg(F.min("doc_id").alias("least"))
    roots = connected_components(near_pairs(members, distance)).withColumnRenamed("node", "_fp")
    merged = members.join(roots, "_fp")
    smallest = merged.groupBy("root").agg(F.min("least").alias("smallest"))
    # Only values that stand in a link, or that several rows share, need the join below.
    of_value = members.join(merged.join(smallest, "root").select("_fp", "smallest", "root"), "_fp", "left").select(
        "_fp", F.coalesce("smallest", "least").alias("component_id"), F.coalesce("root", "_fp").alias("root")
    )
    digits = F.lower(F.lpad(F.hex("_fp"), 16, "0"))
    return rows.join(of_value, "_fp").select("_row", "doc_id", digits.alias("fingerprint"), "component_id", "root")
