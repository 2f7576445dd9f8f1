"""The registered queries of the operators and, where SQL can say it, their SQL."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kpiloom.llm import (
    html_extract,
    langid,
    mixing,
    ngram_lm,
    periodic,
    sentence_pieces,
    simhash,
    substring,
    token_counts,
    topk,
    toxicity,
    whitening,
    winnowing,
)
from kpiloom.llm.common import prepare, table


def op1_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return html_extract.extract_pages(table(spark, folder, "pages"))


def op2_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = winnowing.contaminated_words(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.drop("_row", "items", "spans")


def op3_exact_top_k(spark: SparkSession, folder: str) -> DataFrame:
    return topk.top_k(table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0)


def op4_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_lm.score_documents(table(spark, folder, "documents"), ngram_lm.held_out_fold(F.col("doc_id")), order=3)


def op5_sentence_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return sentence_pieces.segmentations(
        table(spark, folder, "documents"), columns=("rank", "score", "n_pieces", "ids_sha256", "round_trip")
    )


def op6_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.length_histogram(token_counts.encoded_lengths(table(spark, folder, "documents")))


def op7_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.score_documents(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op8_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return langid.identify(table(spark, folder, "documents"))


def op9_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents")).drop("_row", "root")


def op10_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substring.remove_repeats(table(spark, folder, "documents")).drop("_row", "kept")


def looped(doc_id: int, n: int) -> tuple[int, int] | None:
    """Where a tenth of the documents begin to repeat themselves, and how many words go round."""
    g, tenth = divmod(zlib.crc32(str(doc_id).encode()), 10)
    if tenth:
        return None
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def op11_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    found = periodic.periodic_runs(table(spark, folder, "documents"), rewritten=looped)
    line = lambda r: F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period")))
    listed = F.concat_ws("", F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))))
    # The longest, of those the first, of those the one of smallest period: structs compare field by field.
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), -r["start"], -r["period"])))
    first = F.when(F.col("n_runs") > 0, longest)
    return found.select(
        "doc_id",
        "n_words",
        "n_runs",
        (-first["col2"]).alias("start"),
        first["length"].alias("length"),
        (-first["col3"]).alias("period"),
        F.floor(first["length"] * 1000 / -first["col3"]).alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents"))


def op13_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(table(spark, folder, "embeddings"))


def _prepared(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        prepare(spark)
        return query(spark, folder)

    return run


QUERIES = {name: _prepared(f) for name, f in list(globals().items()) if name.startswith("op")}

ORACLE: dict[str, str] = {
    "op12_source_mix": r"""
        WITH docs AS (
            SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                   md5(coalesce(CAST(doc_id AS VARCHAR), '') || ' ' || coalesce(text, '')) AS draw
            FROM documents),
        sources AS (
            SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
                   [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight
            FROM docs GROUP BY source),
        shared AS (  -- what is left for a source and those that bear more, if all that bear less are full
            SELECT *, (sum(source_size) OVER () * 3 / 2 - coalesce(sum(2 * source_size) OVER below, 0)) AS remaining,
                   sum(weight) OVER () - coalesce(sum(weight) OVER below, 0) AS free
            FROM sources
            WINDOW below AS (ORDER BY 2 * source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        edge AS (
            SELECT *, 2 * source_size < weight * remaining / free AS is_full FROM shared),
        level AS (
            SELECT arg_min(remaining, 2 * source_size / weight) AS remaining, arg_min(free, 2 * source_size / weight) AS free
            FROM edge WHERE NOT is_full),
        targets AS (
            SELECT source, source_size,
                   CASE WHEN is_full THEN CAST(2 * source_size AS DOUBLE) ELSE weight * level.remaining / level.free END AS target
            FROM edge, level),
        planned AS (
            SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target) AS BIGINT) // source_size ELSE 0 END AS copies
            FROM targets),
        wanted AS (
            SELECT *, CAST(floor(target) AS BIGINT) - copies * source_size AS beyond FROM planned),
        drawn AS (
            SELECT d.doc_id, d.source, d.size, d.draw, w.source_size, w.target, w.copies, w.beyond,
                   (CAST('0x' || substr(draw, 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u
            FROM docs d JOIN wanted w ON d.source IS NOT DISTINCT FROM w.source),
        ranked AS (
            SELECT *, (u / (1 - u)) / ((beyond / source_size) / (1 - beyond / source_size)) AS rank FROM drawn),
        placed AS (
            SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY rank, draw
                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
            FROM ranked)
        SELECT doc_id, source, size, source_size, target, CAST(copies AS BIGINT) AS copies,
               CAST(copies * size + greatest(least(beyond - before, size), 0) AS BIGINT) AS taken
        FROM placed
    """,
    "op3_exact_top_k": """
        WITH usable AS (
            SELECT vec_id, embedding FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        whole AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM usable),
        scored AS (
            SELECT q.vec_id AS query_id, c.vec_id,
                   CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM (SELECT * FROM whole WHERE vec_id % 50 = 0) q JOIN whole c ON q.vec_id <> c.vec_id),
        ranked AS (
            SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
            FROM scored)
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
    """,
}
