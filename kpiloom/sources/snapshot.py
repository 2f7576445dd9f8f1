"""Versioned Parquet snapshots of the cleaned table, replaced month by month.

A version is a manifest: for each month the folder that holds it and a checksum of its rows. A reload
writes the months whose rows changed and names the folders of earlier versions for the others. Every
attempt to write lies in a folder of its own and becomes visible only by the manifest, put last,
whole, and never over another one. So a failed or repeated write does not disturb readers,
and of publishers that race each ends with a version of its own.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from datetime import datetime, timezone

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kpiloom.columns import DIA, EJECUTIVO, FECHA, FILAS, LAYOUT_ANIO, LAYOUT_MES, N, STATUS, TORRE
from kpiloom.operators.cuboid import build_cuboid
from kpiloom.operators.figures import BITS, BLOQUE, DIAS, NUMERO, executive_slices, figure_cells, new_names, numbered_on
from kpiloom.sources import announce

LOTE = "lote de carga"  # partition column of one attempt to write; a blank, as in the layout's names
KINDS = ("detail", "cuboid", "cells", "slices")
NAME_PARTS = 32  # parts of the list of executives before it is written anew

_LAYOUT_FIELDS = [T.StructField(LAYOUT_ANIO, T.IntegerType()), T.StructField(LAYOUT_MES, T.IntegerType())]


def _schema(texts: tuple[str, ...], *fields: tuple[str, T.DataType], layout: bool = True) -> T.StructType:
    found = [T.StructField(c, T.StringType()) for c in texts] + [T.StructField(c, kind) for c, kind in fields]
    return T.StructType(found + (_LAYOUT_FIELDS if layout else []))


_DAY = (DIA, T.DateType())
_COUNTS = ((N, T.LongType()), (FILAS, T.LongType()))
_MASK = (DIAS, T.IntegerType())
CUBOID_SCHEMA = _schema((TORRE, EJECUTIVO, STATUS), _DAY, *_COUNTS)
CELLS_SCHEMA = _schema((TORRE, STATUS), _DAY, (BLOQUE, T.LongType()), *_COUNTS, _MASK, (BITS, T.BinaryType()))
SLICES_SCHEMA = _schema((TORRE, EJECUTIVO, STATUS), _DAY, *_COUNTS, _MASK)
NAMES_SCHEMA = _schema((EJECUTIVO,), (NUMERO, T.LongType()), layout=False)
# What `superseded` needs of a manifest.
_LISTED = "version long, months array<struct<anio:int,mes:int,folder:string>>, names struct<parts:array<string>>"


def _layout(moment: Column) -> dict[str, Column]:
    return {LAYOUT_ANIO: F.year(moment), LAYOUT_MES: F.month(moment)}


def hand_off(df: DataFrame, name: str) -> DataFrame:
    """Keep a frame for later steps under a view name; what memory cannot hold goes to disk."""
    kept = df.persist(StorageLevel.MEMORY_AND_DISK)
    kept.createOrReplaceTempView(name)
    return kept


def row_hash(df: DataFrame, columns: Iterable[str]) -> Column:
    """A hash of a row's values, nulls told from absent ones; maps are hashed as their text."""
    parts: list[Column] = []
    for name in columns:
        quoted = F.col(f"`{name}`")
        parts += [F.to_json(quoted) if isinstance(df.schema[name].dataType, T.MapType) else quoted, quoted.isNull()]
    return F.xxhash64(*parts)


def month_checksums(rows: DataFrame, columns: list[str]) -> dict[tuple[int, int], list]:
    """For each year and month of ``FECHA`` the count of rows, and the sum and xor of their hashes.

    The order of rows and files does not matter. One aggregate; the calendar bounds what comes back.
    """
    hashed = rows.select(F.year(FECHA).alias("anio"), F.month(FECHA).alias("mes"), row_hash(rows, columns).alias("h"))
    sums = hashed.groupBy("anio", "mes").agg(
        F.count("*").alias(FILAS), F.sum(F.col("h").cast("decimal(20,0)")).alias("sum"), F.bit_xor("h").alias("xor")
    )
    return {(r["anio"], r["mes"]): [r[FILAS], str(r["sum"]), r["xor"]] for r in sums.collect()}


class SnapshotStore:
    """Snapshots below ``root``: numbered manifests, and folders per attempt, year and month for each kind of table.

    Kinds are the detail, the base cuboid, and for headline figures cells and executive slices (see
    ``figures``). Versions are numbered by the store, whatever the writers count.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def path(self, kind: str, folder: str = "") -> str:
        return f"{self.root}/{kind}/{folder}"

    @property
    def manifest_path(self) -> str:
        return f"{self.root}/manifest"

    # --- writing -----------------------------------------------------------------------

    def publish(
        self, cleaned: DataFrame, batch: int | None = None, stream: str = "load", rebalance: bool = True
    ) -> int:
        """Write what changed against the newest version, announce a new one, and return its rows.

        Batches of a stream are numbered upwards; one that was announced before is recognised and
        not written again.

        With a version before, one pass over the source sums up each month, and a second reads the
        months that differ. Should the source change in between, a month is as the second pass
        found it, or as in the version before; its checksum is that of the rows kept, so the next
        reload sees the difference. Other columns, or columns of other types, change every month.

        Tables are laid out by year and month so that month filters skip folders. The rebalance
        hint lets Spark cut a hot month into many files and join small ones, at the price of a
        shuffle; a source that arrives in order of date can do without. The cutting is adaptive
        execution's, hence that must be on.
        """
        if rebalance and self.spark.conf.get("spark.sql.adaptive.enabled") != "true":
            raise ValueError("rebalance needs spark.sql.adaptive.enabled")
        base = self.current()
        before = _announced(base, stream, batch)
        if before is not None:
            return before
        columns = cleaned.columns
        schema = T.StructType([T.StructField(f.name, f.dataType) for f in cleaned.schema.fields] + _LAYOUT_FIELDS)
        kept: list[dict] = []
        changed = cleaned
        if base is not None and T.StructType.fromJson(base["schema"]) == schema:
            found = month_checksums(cleaned, columns)
            kept = [m for m in base["months"] if found.get((m["anio"], m["mes"])) == m["checksum"]]
            rest = sorted(set(found) - {(m["anio"], m["mes"]) for m in kept})
            month = F.year(FECHA) * 100 + F.month(FECHA)
            changed = cleaned.where(month.isin([y * 100 + m for y, m in rest])) if rest else None
        names = base["names"] if base else {"parts": [], "count": 0}
        written: list[dict] = []
        if changed is not None:
            written, names = self._write(changed, columns, schema, names, rebalance)
        months = sorted(kept + written, key=lambda m: (m["anio"], m["mes"]))
        return self._announce(
            {
                "stream": stream,
                "batch": batch,
                FILAS: sum(m["checksum"][0] for m in months),
                "_loaded_at": datetime.now(timezone.utc).isoformat(),
                "schema": schema.jsonValue(),
                "months": months,
                "names": names,
            }
        )

    def _write(
        self, rows: DataFrame, columns: list[str], schema: T.StructType, names: dict, rebalance: bool
    ) -> tuple[list[dict], dict]:
        """Write the rows and what is counted from them; the months written and the names known then."""
        folder = f"{LOTE}={uuid.uuid4().hex}"
        laid_out = rows.withColumns(_layout(F.col(FECHA)))
        if rebalance:
            laid_out = laid_out.hint("rebalance", F.col(f"`{LAYOUT_ANIO}`"), F.col(f"`{LAYOUT_MES}`"))
        laid_out.write.partitionBy(LAYOUT_ANIO, LAYOUT_MES).parquet(self.path("detail", folder))
        # All else comes from the files just written: nothing of the source is read again.
        detail = self.spark.read.schema(schema).parquet(self.path("detail", folder))
        found = month_checksums(detail, columns)
        if found:
            self._write_kind("cuboid", folder, build_cuboid(detail))
            cuboid = self._read_folder("cuboid", folder, CUBOID_SCHEMA)
            names = self._number(cuboid, names)
            self._write_kind("cells", folder, figure_cells(cuboid, self._names(names)))
            self._write_kind("slices", folder, executive_slices(cuboid))
        return [{"anio": y, "mes": m, "folder": folder, "checksum": c} for (y, m), c in found.items()], names

    def _write_kind(self, kind: str, folder: str, rows: DataFrame) -> None:
        rows.withColumns(_layout(F.col(DIA))).write.partitionBy(LAYOUT_ANIO, LAYOUT_MES).parquet(self.path(kind, folder))

    def _read_folder(self, kind: str, folder: str, schema: T.StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(self.path(kind, folder))

    def _names(self, names: dict) -> DataFrame:
        if not names["parts"]:
            return self.spark.createDataFrame([], NAMES_SCHEMA)
        return self.spark.read.schema(NAMES_SCHEMA).parquet(*[self.path("names", p) for p in names["parts"]])

    def _number(self, cuboid: DataFrame, names: dict) -> dict:
        """Executives keep their number for ever, since kept months hold it in their bitmaps.

        New names are found once and kept: numbering goes over them several times, and would else go
        over all of the cuboid as often.
        """
        part = uuid.uuid4().hex
        found = new_names(cuboid, self._names(names)).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            numbered_on(found, names["count"]).write.parquet(self.path("names", part))
        finally:
            found.unpersist()
        fresh = self._names({"parts": [part]}).count()
        if not fresh:
            return names
        parts = [*names["parts"], part]
        if len(parts) > NAME_PARTS:
            whole = uuid.uuid4().hex
            self._names({"parts": parts}).write.parquet(self.path("names", whole))
            parts = [whole]
        return {"parts": parts, "count": names["count"] + fresh}

    def _announce(self, entry: dict) -> int:
        """Put the manifest under the next free number; a publisher that lost one takes the next."""
        stream, batch = entry["stream"], entry["batch"]
        while True:
            head = self.current()
            before = _announced(head, stream, batch)
            if before is not None:
                return before
            streams = dict(head["streams"]) if head else {}
            if batch is not None:
                streams[stream] = [batch, entry[FILAS]]
            entry |= {"version": head["version"] + 1 if head else 0, "streams": streams}
            if announce.put_if_absent(self.spark, announce.numbered(self.manifest_path, entry["version"]), entry):
                return entry[FILAS]

    # --- reading -----------------------------------------------------------------------

    def current(self) -> dict | None:
        """The newest announced version, or None before the first one."""
        number = announce.newest(self.spark, self.manifest_path)
        return None if number is None else self.version(number)

    def version(self, number: int) -> dict:
        return announce.read(self.spark, announce.numbered(self.manifest_path, number))

    def _newest(self) -> dict:
        newest = self.current()
        if newest is None:
            raise LookupError(f"no snapshot published below {self.root}")
        return newest

    def _months(self, kind: str, entry: dict, schema: T.StructType) -> DataFrame:
        """One scan over the folders that a version names; year and month are partition columns in it."""
        paths = [f"{self.path(kind, m['folder'])}/{LAYOUT_ANIO}={m['anio']}/{LAYOUT_MES}={m['mes']}" for m in entry["months"]]
        if not paths:
            return self.spark.createDataFrame([], schema)
        stored = T.StructType(schema.fields + [T.StructField(LOTE, T.StringType())])
        reader = self.spark.read.schema(stored).option("basePath", self.path(kind))
        return reader.parquet(*paths).select(*[F.col(f"`{f.name}`") for f in schema.fields])

    def detail(self) -> DataFrame:
        newest = self._newest()
        return self._months("detail", newest, T.StructType.fromJson(newest["schema"]))

    def cuboid(self) -> DataFrame:
        return self._months("cuboid", self._newest(), CUBOID_SCHEMA)

    def cells(self) -> DataFrame:
        return self._months("cells", self._newest(), CELLS_SCHEMA)

    def slices(self) -> DataFrame:
        return self._months("slices", self._newest(), SLICES_SCHEMA)

    def last_updated(self) -> datetime | None:
        newest = self.current()
        return datetime.fromisoformat(newest["_loaded_at"]) if newest else None

    def superseded(self, keep: int = 2) -> DataFrame:
        """Folders (``path``) that none of the newest ``keep`` versions names, for the storage to remove.

        Jobs still running may need the latest few. The list grows with every version, so it
        is a frame and not collected. Manifests stay: their numbers have no gaps.
        """
        newest = self.current()
        if newest is None:
            return self.spark.createDataFrame([], "path string")
        listed = self.spark.read.schema(_LISTED).json(f"{self.manifest_path}/*.json")
        month = F.explode("months").alias("m")
        place = F.format_string(f"%s/{LAYOUT_ANIO}=%d/{LAYOUT_MES}=%d", "m.folder", "m.anio", "m.mes")
        folders = listed.select("version", month).select("version", place.alias("place"))
        kinds = F.explode(F.array(*[F.lit(self.path(k)) for k in KINDS]))
        paths = folders.withColumn("kind", kinds).select("version", F.concat("kind", "place").alias("path"))
        parts = listed.select("version", F.explode("names.parts").alias("part"))
        paths = paths.union(parts.select("version", F.concat(F.lit(self.path("names")), "part")))
        last = paths.groupBy("path").agg(F.max("version").alias("last"))
        return last.where(F.col("last") <= newest["version"] - keep).select("path")

    def register_views(self, detail: str = "gestiones", cuboid: str = "gestiones_cuboid") -> None:
        """Point session views at the newest version; called only after it is announced."""
        new_detail, new_cuboid = self.detail(), self.cuboid()
        new_detail.createOrReplaceTempView(detail)
        new_cuboid.createOrReplaceTempView(cuboid)


def _announced(head: dict | None, stream: str, batch: int | None) -> int | None:
    """Rows of this batch, or of a later one of its stream, if it was announced."""
    last = head["streams"].get(stream) if head else None
    return last[1] if batch is not None and last is not None and batch <= last[0] else None
