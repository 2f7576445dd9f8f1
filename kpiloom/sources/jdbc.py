"""Database source and sink over Spark's JDBC connector."""

from __future__ import annotations

import os
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import datetime, time
from itertools import pairwise

from pyspark.sql import DataFrame, SparkSession

# The settings a deployment provides.
SETTINGS = ("HOST", "USUARIO", "CONTRASENA", "PUERTO", "BASE_DE_DATOS")

WRITE_BATCH = 1000
FETCH = 10_000
# Ends of the names of a table that is being loaded, and of the one it has replaced.
LOADING, REPLACED = "__carga", "__anterior"
CONNECTIONS = 16  # open at a time while a table is written
CONNECT_TIMEOUT_S = 60
MYSQL_URL = "jdbc:mysql://{host}:{port}/{database}?connectTimeout={timeout_ms}"


@dataclass(frozen=True)
class JdbcSplit:
    """How a table scan is cut into parallel range queries on a numeric or time column."""

    column: str
    lower: str
    upper: str
    partitions: int

    def options(self) -> dict[str, str]:
        return {
            "partitionColumn": self.column,
            "lowerBound": self.lower,
            "upperBound": self.upper,
            "numPartitions": str(self.partitions),
        }


def jdbc_options(
    env: Mapping[str, str] | None = None,
    url: str = MYSQL_URL,
    connect_timeout_s: int = CONNECT_TIMEOUT_S,
    query_timeout_s: int = 0,
) -> dict[str, str]:
    """Connection options from the environment; an incomplete one is an error.

    Executors open a connection per partition and close it, so nothing is pooled.
    """
    env = os.environ if env is None else env
    missing = [name for name in SETTINGS if not env.get(name)]
    if missing:
        raise ValueError(f"missing environment settings: {', '.join(missing)}")
    return {
        "url": url.format(
            host=env["HOST"],
            port=env["PUERTO"],
            database=env["BASE_DE_DATOS"],
            timeout_ms=connect_timeout_s * 1000,
        ),
        "user": env["USUARIO"],
        "password": env["CONTRASENA"],
        "queryTimeout": str(query_timeout_s),
    }


def read_options(
    options: Mapping[str, str], table: str, split: JdbcSplit | None = None, fetch_size: int = FETCH
) -> dict[str, str]:
    # A zone-less time stays as the database has it, whatever zones the JVM and the session are in.
    found = {**options, "dbtable": table, "fetchsize": str(fetch_size), "preferTimestampNTZ": "true"}
    if split is not None:
        found |= split.options()
    return found


def read_table(
    spark: SparkSession,
    options: Mapping[str, str],
    table: str,
    split: JdbcSplit | Sequence[str] | None = None,
    fetch_size: int = FETCH,
) -> DataFrame:
    """Scan a table; simple filters and the column list travel to the database.

    ``split`` cuts the scan into parallel ranges of equal width, or into the predicates given (see
    ``equal_ranges``). Without it one connection reads everything, which only suits small tables.
    """
    if split is None or isinstance(split, JdbcSplit):
        return spark.read.format("jdbc").options(**read_options(options, table, split, fetch_size)).load()
    found = read_options(options, table, None, fetch_size)
    return spark.read.jdbc(found.pop("url"), found.pop("dbtable"), predicates=list(split), properties=found)


def hours_query(table: str, column: str) -> str:
    """Rows per day and hour of a time column: an aggregate the database makes, bounded by the calendar."""
    day, hour = f"CAST({column} AS DATE)", f"EXTRACT(HOUR FROM {column})"
    return f"(SELECT {day} AS dia, {hour} AS hora, COUNT(*) AS n FROM {table} GROUP BY {day}, {hour}) horas"


def cut_points(hours: Sequence[tuple[datetime, int]], partitions: int) -> list[datetime]:
    """Where to cut ascending hours so that ranges hold about equally many rows.

    A range ends before the hour that would take it further past its share than it lacks now. An hour
    is not cut: one that holds more than a share makes a range of its own.
    """
    left, parts = sum(n for _, n in hours), partitions
    cuts: list[datetime] = []
    held = 0
    for hour, n in hours:
        share = (left + held) / parts
        if held and parts > 1 and held + n - share > share - held:
            cuts.append(hour)
            parts, held = parts - 1, 0
        held += n
        left -= n
    return cuts


def range_predicates(column: str, cuts: Sequence[datetime]) -> list[str]:
    """Predicates that part the rows at the cuts; rows without a time go with the first."""
    texts = [f"TIMESTAMP '{c:%Y-%m-%d %H:%M:%S}'" for c in cuts]
    if not texts:
        return ["1 = 1"]
    first = f"{column} < {texts[0]} OR {column} IS NULL"
    inner = [f"{column} >= {lo} AND {column} < {hi}" for lo, hi in pairwise(texts)]
    return [first, *inner, f"{column} >= {texts[-1]}"]


def equal_ranges(
    spark: SparkSession, options: Mapping[str, str], table: str, column: str, partitions: int = CONNECTIONS
) -> list[str]:
    """Predicates for ``read_table`` whose ranges hold about equally many rows, found from the table itself.

    Ranges of equal width, as the caller's bounds would give, put a busy season into one task.
    """
    counted = read_table(spark, options, hours_query(table, column))
    rows = counted.where("dia IS NOT NULL").select("dia", "hora", "n").collect()  # a row an hour at most
    hours = sorted((datetime.combine(r["dia"], time(int(r["hora"]))), int(r["n"])) for r in rows)
    return range_predicates(column, cut_points(hours, partitions))


def write_options(
    options: Mapping[str, str], table: str, batch_size: int = WRITE_BATCH, connections: int | None = CONNECTIONS
) -> dict[str, str]:
    found = {**options, "dbtable": table.lower(), "batchsize": str(batch_size)}
    if connections is not None:
        found["numPartitions"] = str(connections)
    return found


class Statements:
    """Statements that Spark's connector has no way to send, over one connection of the driver's."""

    def __init__(self, spark: SparkSession, options: Mapping[str, str]):
        jvm = spark._jvm
        properties = jvm.java.util.Properties()
        for name in ("user", "password"):
            if name in options:
                properties.setProperty(name, options[name])
        if "driver" in options:
            # By Spark's class loader, which knows the jars the session was given.
            loader = jvm.java.lang.Thread.currentThread().getContextClassLoader()
            none = spark._sc._gateway.new_array(jvm.java.lang.Class, 0)
            found = jvm.java.lang.Class.forName(options["driver"], True, loader).getDeclaredConstructor(none)
            driver = found.newInstance(spark._sc._gateway.new_array(jvm.java.lang.Object, 0))
            self.connection = driver.connect(options["url"], properties)
        else:
            self.connection = jvm.java.sql.DriverManager.getConnection(options["url"], properties)

    def has_table(self, name: str) -> bool:
        return self.connection.getMetaData().getTables(self.connection.getCatalog(), None, name, None).next()

    def run(self, statement: str) -> None:
        prepared = self.connection.createStatement()
        try:
            prepared.execute(statement)
        finally:
            prepared.close()

    def close(self) -> None:
        self.connection.close()


def replace_table(
    df: DataFrame,
    options: Mapping[str, str],
    table: str,
    batch_size: int = WRITE_BATCH,
    connections: int | None = CONNECTIONS,
) -> None:
    """Fill a new table beside the lower-cased one, then let it take the name in one statement.

    Readers see the old table or the new one, never half of either: MySQL's RENAME TABLE swaps
    both names at once. If the load breaks off, the old table stays as it was, and what was loaded is
    dropped by the next load. ``connections`` bounds how many the database has to serve at once.
    """
    name = table.lower()
    fresh, old = f"{name}{LOADING}", f"{name}{REPLACED}"
    found = write_options(options, fresh, batch_size, connections)
    df.write.format("jdbc").options(**found).mode("overwrite").save()
    statements = Statements(df.sparkSession, options)
    try:
        if statements.has_table(name):
            statements.run(f"DROP TABLE IF EXISTS {old}")  # of a load that broke off after its swap
            statements.run(f"RENAME TABLE {name} TO {old}, {fresh} TO {name}")
            statements.run(f"DROP TABLE IF EXISTS {old}")
        else:
            statements.run(f"RENAME TABLE {fresh} TO {name}")
    finally:
        statements.close()
