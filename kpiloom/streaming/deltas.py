"""Deliveries that add up: a ledger of batches from any number of streams, and bases that merge them.

A batch writes its rows and their cuboid to folders of its own attempt and enters them in the
ledger, one file for each (stream, batch), put once. What is not entered does not count, so an attempt
that broke off or was repeated changes nothing, and streams do not see each other's numbers. A base
holds the merged cuboid and says for each stream up to which batch it reaches. Bases are
numbered and put once too, so of two compactions at a time one wins and the other starts again.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from kpiloom.columns import LAYOUT_ANIO, LAYOUT_MES
from kpiloom.config import DB, Profile
from kpiloom.operators.clean import clean
from kpiloom.operators.cuboid import build_cuboid, merge_cuboids
from kpiloom.sources import announce
from kpiloom.sources.snapshot import CUBOID_SCHEMA
from kpiloom.streaming.refresh import _arrivals, _delivered, _start, _stream_id

# Partition columns of an attempt; a blank, so that they are no user's column.
FLUJO, LOTE, INTENTO = "flujo de entrega", "numero de lote", "intento de carga"
_ATTEMPT = [T.StructField(FLUJO, T.StringType()), T.StructField(LOTE, T.LongType()), T.StructField(INTENTO, T.StringType())]
_ENTRY = "stream string, batch bigint, attempt string, filas bigint"


def _cuboid_schema() -> T.StructType:
    return T.StructType([f for f in CUBOID_SCHEMA.fields if f.name not in (LAYOUT_ANIO, LAYOUT_MES)])


def append_deltas(
    spark: SparkSession,
    folder: str,
    target: str,
    progress: str,
    profile: Profile = DB,
    once: bool = False,
    max_files: int = 32,
    file_format: str = "parquet",
    options: dict | None = None,
    **cleaning,
) -> StreamingQuery:
    """Each batch leaves its rows and a small cuboid below ``target``.

    Counts are additive, so no state is kept between batches and a row may come as late as it
    likes. Several streams may write to one target: a batch is known by its stream's progress folder and its
    number. Files are read as in ``replace_on_delivery``.
    """

    def write_delta(batch: DataFrame, batch_id: int) -> None:
        stream = json.loads(_stream_id(spark, progress))["id"]
        if announce.exists(spark, _entry_path(target, stream, batch_id)):
            return
        rows = _delivered(spark, batch, file_format, options)
        if rows is not None:
            add_delta(spark, target, clean(rows, profile, **cleaning), stream, batch_id)

    return _start(_arrivals(spark, folder, max_files), write_delta, progress, once)


def _entry_path(target: str, stream: str, batch: int) -> str:
    return announce.numbered(f"{target}/ledger/{stream}", batch)


def add_delta(spark: SparkSession, target: str, cleaned: DataFrame, stream: str, batch: int) -> bool:
    """Write one batch and enter it in the ledger; False if the ledger has it, whose rows then stay."""
    attempt = uuid.uuid4().hex
    place = f"{FLUJO}={stream}/{LOTE}={batch}/{INTENTO}={attempt}"
    cleaned.write.parquet(f"{target}/detail/{place}")
    stored = spark.read.schema(cleaned.schema).parquet(f"{target}/detail/{place}")
    build_cuboid(stored).write.parquet(f"{target}/cuboid/{place}")
    entry = {"stream": stream, "batch": batch, "attempt": attempt, "filas": stored.count()}
    return announce.put_if_absent(spark, _entry_path(target, stream, batch), entry)


def ledger(spark: SparkSession, target: str) -> DataFrame:
    """``stream, batch, attempt, filas`` of every batch that was entered."""
    return spark.read.schema(_ENTRY).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(f"{target}/ledger")


def _base(spark: SparkSession, target: str) -> dict:
    number = announce.newest(spark, f"{target}/bases")
    if number is None:
        return {"number": -1, "upto": {}, "path": None}
    return announce.read(spark, announce.numbered(f"{target}/bases", number))


def _after(upto: dict[str, int], stream: Column, batch: Column) -> Column:
    """Batches that a base does not hold. One number a stream, as a stream's batches come in order."""
    within = [(stream == name) & (batch <= last) for name, last in upto.items()]
    return ~reduce(or_, within, F.lit(False))


def _entered(spark: SparkSession, path: str, schema: T.StructType, entries: DataFrame) -> DataFrame:
    """The stored rows of the attempts that the entries name."""
    fields = [f for f in schema.fields if f.name not in (FLUJO, LOTE, INTENTO)]
    rows = spark.read.schema(T.StructType(fields + _ATTEMPT)).parquet(path)
    # On partition columns only: Spark prunes the folders by the entries.
    named = entries.select(F.col("stream").alias(FLUJO), F.col("batch").alias(LOTE), F.col("attempt").alias(INTENTO))
    return rows.join(named, [FLUJO, LOTE, INTENTO], "left_semi").drop(FLUJO, LOTE, INTENTO)


def _deltas(spark: SparkSession, target: str, entries: DataFrame) -> DataFrame:
    return _entered(spark, f"{target}/cuboid", _cuboid_schema(), entries)


def read_deltas(spark: SparkSession, target: str) -> DataFrame:
    """The cuboid over all deliveries entered so far: the newest base, and the batches it does not hold."""
    base = _base(spark, target)
    entries = ledger(spark, target).where(_after(base["upto"], F.col("stream"), F.col("batch")))
    parts = _deltas(spark, target, entries)
    if base["path"]:
        parts = spark.read.schema(_cuboid_schema()).parquet(f"{target}/{base['path']}").unionByName(parts)
    return merge_cuboids(parts)


def read_delta_rows(spark: SparkSession, target: str) -> DataFrame:
    """The cleaned rows of all deliveries entered so far, for previews and detail exports."""
    path = f"{target}/detail"
    return _entered(spark, path, spark.read.option("mergeSchema", True).parquet(path).schema, ledger(spark, target))


def compact_deltas(spark: SparkSession, target: str) -> dict[str, int]:
    """Merge the cuboids of all batches entered so far into a new base; returns the last batch of each stream in it.

    Readers take the new base from the moment it is announced. The ledger as it was then is stored
    beside it. Cuboid folders of the batches it holds may go after that; the ledger and the rows stay.
    """
    while True:
        base = _base(spark, target)
        # One look at the ledger: batches entered meanwhile are left to the next base.
        path = f"base/{uuid.uuid4().hex}"
        ledger(spark, target).write.parquet(f"{target}/{path}/ledger")
        entries = spark.read.schema(_ENTRY).parquet(f"{target}/{path}/ledger")
        last = entries.groupBy("stream").agg(F.max("batch").alias("batch")).collect()  # a row a stream
        upto = {r["stream"]: r["batch"] for r in last}
        parts = _deltas(spark, target, entries.where(_after(base["upto"], F.col("stream"), F.col("batch"))))
        if base["path"]:
            parts = parts.unionByName(spark.read.schema(_cuboid_schema()).parquet(f"{target}/{base['path']}"))
        merge_cuboids(parts).write.parquet(f"{target}/{path}/cuboid")
        number = base["number"] + 1
        content = {"number": number, "upto": upto, "path": f"{path}/cuboid", "ledger": f"{path}/ledger"}
        if announce.put_if_absent(spark, announce.numbered(f"{target}/bases", number), content):
            return upto
