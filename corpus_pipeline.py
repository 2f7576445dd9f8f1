"""From raw documents to encoded training text, in five stages.

Each stage gets the rows that the one before kept, decides by one of the operators, and hands on
the columns of `documents`; the last one returns what was encoded.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kpiloom.llm import langid, sentence_pieces, simhash, substring, winnowing
from kpiloom.llm.common import crc_fold, prepare, table, written_rows
from kpiloom.session import checkpoint_folder

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(df: DataFrame) -> DataFrame:
    """The columns of `documents`, whatever else a table has; settings and code for the tasks."""
    prepare(df.sparkSession)
    return df.select(*COLUMNS)


# A document stays if the network gives one language at least this much of it.
LEAST_SHARE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language the network cannot tell.

    Those are null texts, texts without a letter, and texts in which no language has a share of
    `LEAST_SHARE` over all positions. The others keep all their columns, lang as given. Learned from the
    labelled rows of the usual folds; without any, texts with a letter stay.
    """
    rows = _documents(docs)
    model = langid.train(rows, crc_fold(F.col("doc_id"), 5) != 0)
    if model is None:
        return rows.where(F.col("text").rlike(langid.LETTER))
    told = langid.predict(rows, model, list(COLUMNS), carry_text=True)
    return _documents(told.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SHARE)))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: that of the smallest doc_id.

    Of its rows that repeat this doc_id the first by the row's place stays. Rows without a doc_id stay
    only where their whole group has none, one of them.
    """
    rows = written_rows(_documents(docs))
    groups = simhash.near_duplicates(rows, numbered=True)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "_row")).alias("first")
    kept = groups.groupBy("root").agg(first).select("first._row")
    return _documents(rows.join(kept.select("_row"), "_row", "left_semi"))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes from each text the passages that stood in a document of smaller doc_id.

    A text that loses words is joined anew by single spaces; one that loses all goes.
    """
    cut = substring.remove_repeats(_documents(docs), keep=["lang", "source", "n_chars"])
    stays = (F.col("n_words") > F.col("n_removed")) | (F.col("n_removed") == 0)
    changed = F.col("n_removed") > 0
    return cut.where(stays).select(
        "doc_id",
        F.col("kept").alias("text"),
        "lang",
        "source",
        F.when(changed, F.length("kept").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"),
    )


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold any window of a benchmark item."""
    rows = written_rows(_documents(docs))
    found = winnowing.contaminated_words(rows, table(spark, sf_dir, "benchmark"), numbered=True)
    return _documents(rows.join(found.where(~F.col("contaminated")).select("_row"), "_row", "left_semi"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The best segmentation of each text: doc_id, lang, source, score, n_pieces, ids_sha256, round_trip, margin.

    margin is by how much the best one beats the second, null where there is no other.
    """
    columns = ("rank", "score", "n_pieces", "ids_sha256", "round_trip", "margin")
    ways = sentence_pieces.segmentations(_documents(docs), n_best=2, columns=columns, keep=("doc_id", "lang", "source"))
    return ways.where(F.col("rank") == 1).drop("rank")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("encoding", encoding),
]

# Trained networks, fingerprint components and piece lattices are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each but the last is written to the checkpoint folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        folder = checkpoint_folder(spark, name)
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return STAGES[-1][1](spark, docs, sf_dir)
