"""What the operators share: reading tables, ASCII case, row keys, bounded samples, Arrow batches."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kpiloom.session import checkpoint_folder

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# Rows of an Arrow batch. Texts differ in size by orders of magnitude, so batches are kept
# small here and cut by bytes in the tasks (see pieces_of).
ARROW_ROWS = 500


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Session settings that the operators with Python tasks rely on, and their code for the executors."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    context = spark.sparkContext
    if not any(name.startswith("kpiloom-") for name in context._python_includes):
        root = Path(__file__).resolve().parents[2]
        archive = Path(tempfile.mkdtemp(prefix="kpiloom-code-"), "kpiloom-code.zip")
        with zipfile.ZipFile(archive, "w") as out:
            for file in sorted((root / "kpiloom").rglob("*.py")):
                out.write(file, file.relative_to(root))
        context.addPyFile(str(archive))


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else; `lower` does that for texts that are ASCII only."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower())
    )


def with_row_id(df: DataFrame, name: str = "_row") -> DataFrame:
    """A key for each row, so that rows with equal or null ids stay apart.

    It is made of the partition and the place in it, so a task that is run again after a loss repeats
    it, but another plan over the same files need not: their splits follow the cores at hand.
    """
    return df.withColumn(name, F.monotonically_increasing_id())


def written_rows(df: DataFrame) -> DataFrame:
    """The rows with `_row`, written once to the checkpoint folder: every plan over them has the same keys."""
    folder = checkpoint_folder(df.sparkSession, "rows")
    with_row_id(df).write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.parquet(folder)


def crc_fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo `folds`; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def pieces_of(batch: pa.RecordBatch, column: str, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batch cut so that `column` has at most `most` bytes in each piece, or one row."""
    sizes = [0 if v is None else v for v in pc.binary_length(batch.column(column)).to_pylist()]
    begin = total = 0
    for i, size in enumerate(sizes):
        if i > begin and total + size > most:
            yield batch.slice(begin, i - begin)
            begin, total = i, 0
        total += size
    if begin < len(sizes):
        yield batch.slice(begin)


def gathered(batches: Iterator[pa.RecordBatch], column: str, least: int) -> Iterator[pa.RecordBatch]:
    """The batches joined until `column` has `least` bytes."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += pc.sum(pc.binary_length(batch.column(column))).as_py() or 0
        if size >= least:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()
