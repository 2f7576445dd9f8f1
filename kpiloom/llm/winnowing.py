"""Benchmark decontamination by winnowing, in built-in functions only.

Texts become arrays of words, and each run of K words a hash. Of every W neighbouring hashes
the smallest is kept. With K + W - 1 = 10, every span of ten words has a kept hash inside, and
the same one wherever the span stands. One pass over all documents joins their kept hashes with
those of the benchmark. Documents with a hit are read again: there each kept hash has its place
(leftmost of equals), and each hit is extended by comparing the words around it, so no equality
of hashes decides the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kpiloom.llm.common import lower_ascii, written_rows
from kpiloom.session import cut_lineage

WINDOW = 10
K = 8  # so W = 3; the steps by doubling below are laid out for these
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # fixed value: all ASCII but digits and lower-case letters
# A packed value has the hash in front and the place in the last bits: the smallest one is the
# smallest hash, and of equals the leftmost. 2**30 words are more than a text can hold.
PLACE_BITS = 30
# Rows of benchmark windows up to which that side is sent to all executors; beyond, it is shuffled.
BROADCAST_ROWS = 200_000


def words(text: Column) -> Column:
    """The words of a text, in order; none for null."""
    cut = F.array_remove(F.split(lower_ascii(text), BETWEEN), "")
    return F.coalesce(cut, F.array().cast("array<string>"))


def _ahead(values: Column, by: int) -> Column:
    """The array from its element `by` on."""
    return F.slice(values, by + 1, F.greatest(F.size(values) - by, F.lit(0)))


def _zip_ahead(df: DataFrame, out: str, left: str, right: str, by: int, f) -> DataFrame:
    """Column `out`: f(left[i], right[i + by]) as far as both reach."""
    both = F.slice(left, 1, F.greatest(F.least(F.size(left), F.size(right) - by), F.lit(0)))
    return df.withColumn(out, F.zip_with(both, _ahead(F.col(right), by), f))


def _gram_hashes(df: DataFrame, words_column: str) -> DataFrame:
    """`_h8`: the hash of each eight neighbouring words, by doubling."""
    df = df.withColumn("_h1", F.transform(words_column, lambda w: F.xxhash64(w)))
    df = _zip_ahead(df, "_h2", "_h1", "_h1", 1, lambda a, b: F.xxhash64(a, b))
    df = _zip_ahead(df.drop("_h1"), "_h4", "_h2", "_h2", 2, lambda a, b: F.xxhash64(a, b))
    return _zip_ahead(df.drop("_h2"), "_h8", "_h4", "_h4", 4, lambda a, b: F.xxhash64(a, b)).drop("_h4")


def _least_of_three(df: DataFrame, out: str, column: str) -> DataFrame:
    df = _zip_ahead(df, "_m2", column, column, 1, lambda a, b: F.least(a, b))
    df = _zip_ahead(df, "_m3", "_m2", column, 2, lambda a, b: F.least(a, b)).drop("_m2", column)
    return df.withColumn(out, F.array_distinct("_m3")).drop("_m3")


def kept_hashes(df: DataFrame, words_column: str = "_words") -> DataFrame:
    """`_kept`: the hashes that winnowing keeps of each row's words, in place of the words."""
    return _least_of_three(_gram_hashes(df, words_column).drop(words_column), "_kept", "_h8")


def kept_places(df: DataFrame, words_column: str = "_words") -> DataFrame:
    """`_kept`: the packed (hash, place from 0) that winnowing keeps of each row's words."""
    df = _gram_hashes(df, words_column).withColumn(
        "_m1",
        F.transform("_h8", lambda h, i: F.shiftleft(F.shiftrightunsigned(h, PLACE_BITS), PLACE_BITS).bitwiseOR(i)),
    )
    return _least_of_three(df.drop("_h8"), "_kept", "_m1")


def _place(packed: Column) -> Column:
    return packed.bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).cast("int")


def _hash(packed: Column) -> Column:
    return F.shiftrightunsigned(packed, PLACE_BITS)


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """One row for each distinct window: its words, the hash that finds it, where that stands in it, its items.

    Windows of whole items under ten words (`short`) are found by the hash of all their words.
    """
    items = benchmark.select(F.col("item_id").cast("string").alias("_item"), words(F.col("text")).alias("_words"))
    long = kept_places(items.where(F.size("_words") >= WINDOW))
    starts = F.sequence(F.lit(0), F.size("_words") - WINDOW)
    long = long.select("_item", "_words", "_kept", F.explode(starts).alias("_start"))
    inside = F.filter("_kept", lambda m: _place(m).between(F.col("_start"), F.col("_start") + (WINDOW - K)))
    long = long.withColumn("_one", F.array_min(inside)).select(
        "_item",
        F.slice("_words", F.col("_start") + 1, WINDOW).alias("span"),
        _hash(F.col("_one")).alias("hash"),
        (_place(F.col("_one")) - F.col("_start")).alias("at"),
    )
    short = items.where(F.size("_words").between(1, WINDOW - 1)).select(
        "_item", F.col("_words").alias("span"), F.xxhash64("_words").alias("hash"), F.lit(None).cast("int").alias("at")
    )
    return long.union(short).groupBy("span").agg(
        F.first("hash").alias("hash"), F.first("at").alias("at"), F.collect_set("_item").alias("items")
    )


def _runs(n: int) -> Column:
    """Where runs of n words begin, from 1."""
    starts = F.sequence(F.lit(1), F.size("_words") - (n - 1))
    return F.when(F.size("_words") >= n, starts).otherwise(F.array().cast("array<int>"))


def _short_hashes(n: int) -> Column:
    """The hash of each run of n words."""
    return F.transform(_runs(n), lambda i: F.xxhash64(F.slice("_words", i, n)))


def _short_probes(n: int) -> Column:
    """Each run of n words as something to look up."""
    return F.transform(
        _runs(n),
        lambda i: F.struct(
            F.xxhash64(F.slice("_words", i, n)).alias("hash"),
            (i - 1).alias("place"),
            F.lit(0).alias("lead"),
            F.slice("_words", i, n).alias("around"),
        ),
    )


def _with_hits(docs: DataFrame, benchmark: DataFrame, short: list[int]) -> DataFrame:
    """_row, doc_id, n_words, any_hit: whether a kept hash is one of the benchmark's; written once.

    `short` are the lengths under ten words that some item has (nine at most); all runs of those
    lengths are looked up as well.
    """

    def hashed(df: DataFrame) -> DataFrame:
        # n_words and the hashes of short runs need the words, which go no further.
        extra = F.concat(F.array().cast("array<bigint>"), *[_short_hashes(n) for n in short])
        return kept_hashes(df.withColumn("n_words", F.size("_words").cast("long")).withColumn("_short", extra))

    items = benchmark.select(words(F.col("text")).alias("_words")).where(F.size("_words") > 0)
    whole = items.where(F.size("_words") < WINDOW).select(F.xxhash64("_words").alias("hash"))
    wanted = hashed(items.where(F.size("_words") >= WINDOW)).select(F.explode_outer("_kept").alias("hash")).union(whole)
    wanted = cut_lineage(wanted.distinct())
    side = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted

    kept = hashed(docs.select("_row", "doc_id", words(F.col("text")).alias("_words")))
    # The outer forms of explode and inline matter: for the inner ones Spark adds a filter on the
    # array's size below, and with it computes all that the array is made of once more.
    # A null hash stands for the row itself, which so survives the join.
    probed = kept.select(
        "_row", "doc_id", "n_words", F.explode_outer(F.concat(F.array(F.lit(None).cast("long")), "_kept", "_short")).alias("h")
    )
    joined = probed.join(side, F.col("h") == F.col("hash"), "left").where("h is null or hash is not null")
    return cut_lineage(
        joined.groupBy("_row").agg(
            F.first("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.count("hash").alias("n")
        ).select("_row", "doc_id", "n_words", (F.col("n") > 0).alias("any_hit"))
    )


def contaminated_words(documents: DataFrame, benchmark: DataFrame, numbered: bool = False) -> DataFrame:
    """For each row of `documents`: _row, doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items, spans.

    A word is hit if it lies inside any occurrence of a window of a benchmark item: ten
    consecutive words, or all words of an item that has fewer. `spans` lists the merged runs of
    hit words (first, last exclusive), `items` the items with occurring windows, sorted.

    Null and empty texts have no words; such items have no window. An item without an id counts
    for hits, but has no name in `items`. Repeated documents each give a row, repeated items and
    equal windows are one window. Empty tables give no rows, or rows without hits. Texts of any
    length are taken whole. Other columns are not read. Documents are read twice: those that
    are `numbered` come from `written_rows`, others are written by it.
    """
    windows = benchmark_windows(benchmark)
    n_windows, lengths = windows.agg(
        F.count("*"), F.collect_set(F.when(F.col("at").isNull(), F.size("span")))
    ).first()

    docs = documents if numbered else written_rows(documents.select("doc_id", "text"))
    docs = docs.select("_row", F.col("doc_id").cast("long").alias("doc_id"), "text")
    every = _with_hits(docs, benchmark, sorted(lengths))
    docs = docs.join(every.where("any_hit").select("_row"), "_row", "left_semi")
    docs = kept_places(docs.select("_row", words(F.col("text")).alias("_words")))

    # The words before and after a kept place that before and after a kept place are in some window with it.
    reach = WINDOW - K
    probes = F.transform(
        "_kept",
        lambda m: F.struct(
            _hash(m).alias("hash"),
            _place(m).alias("place"),
            F.least(_place(m), F.lit(reach)).alias("lead"),
            F.slice("_words", _place(m) - F.least(_place(m), F.lit(reach)) + 1, reach + WINDOW).alias("around"),
        ),
    )
    # Each length under ten that some item has: all spans of that length are looked up (9 lengths at most).
    probes = F.concat(probes, *[_short_probes(n) for n in sorted(lengths)])
    probed = docs.select("_row", F.inline_outer(probes))
    wanted = windows.withColumn("window", F.xxhash64("span"))
    side = wanted.select("hash", "at", "span", "window")
    hits = probed.join(F.broadcast(side) if n_windows <= BROADCAST_ROWS else side, "hash")

    offset = F.coalesce(F.col("at"), F.lit(0))
    same = (F.col("lead") >= offset) & (F.slice("around", F.col("lead") - offset + 1, F.size("span")) == F.col("span"))
    first = F.col("place") - offset
    found = (
        hits.where(same)
        .select("_row", "window", F.struct(first.alias("first"), (first + F.size("span")).alias("last")).alias("hit"))
        .groupBy("_row")
        .agg(F.collect_set("hit").alias("hits"), F.collect_set("window").alias("found"))
    )
    # Overlapping and adjoining windows become runs: of the words hit, in order, a run begins where the one
    # before is missing and ends where the next one is. Time is by the hits, however many a row has.
    kind = "array<struct<first:int,last:int>>"
    words_hit = F.flatten(F.transform("hits", lambda h: F.sequence(h["first"], h["last"] - 1)))
    hit = found.select("_row", "found", F.array_sort(F.array_distinct(words_hit)).alias("_hit"))
    word = F.col("_hit")
    begins = F.filter("_hit", lambda x, i: (i == 0) | (F.get(word, i - 1) != x - 1))
    ends = F.filter("_hit", lambda x, i: (i == F.size(word) - 1) | (F.get(word, i + 1) != x + 1))
    runs = F.zip_with(begins, ends, lambda a, b: F.struct(a.alias("first"), (b + 1).alias("last")))
    found = hit.select("_row", "found", runs.cast(kind).alias("spans"))
    named = (
        found.select("_row", "spans", F.explode("found").alias("window"))
        .join(wanted.select("window", "items"), "window")
        .select("_row", "spans", F.explode_outer("items").alias("_item"))
        .groupBy("_row")
        .agg(F.first("spans").alias("spans"), F.array_sort(F.collect_set("_item")).alias("items"))
    )
    result = every.join(named, "_row", "left").select(
        "_row",
        "doc_id",
        "n_words",
        F.coalesce("spans", F.array().cast(kind)).alias("spans"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"])
    return result.select(
        "_row",
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
        "items",
        "spans",
    )
