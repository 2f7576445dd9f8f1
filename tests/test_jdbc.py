"""Connection options and the calls made with them.

No database is started: what the connector is asked for is recorded instead.
"""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from kpiloom.plans.load import load_to_database
from kpiloom.sources import jdbc

ENV = {"HOST": "db", "USUARIO": "u", "CONTRASENA": "s", "PUERTO": "3306", "BASE_DE_DATOS": "kpi"}


def test_options_from_environment(monkeypatch):
    found = jdbc.jdbc_options(ENV)
    assert found["url"] == "jdbc:mysql://db:3306/kpi?connectTimeout=60000"
    assert (found["user"], found["password"]) == ("u", "s")
    for name, value in ENV.items():
        monkeypatch.setenv(name, value)
    assert jdbc.jdbc_options() == found


@pytest.mark.parametrize("missing", list(ENV))
@pytest.mark.parametrize("value", [None, ""])
def test_missing_setting_is_an_error(missing, value):
    env = {**ENV, missing: value} if value is not None else {k: v for k, v in ENV.items() if k != missing}
    with pytest.raises(ValueError, match=missing):
        jdbc.jdbc_options(env)


def test_read_in_parallel_ranges():
    split = jdbc.JdbcSplit("FECHA", "2024-01-01", "2026-01-01", 48)
    found = jdbc.read_options({"url": "x"}, "gestiones", split)
    assert found == {
        "url": "x", "dbtable": "gestiones", "fetchsize": "10000", "preferTimestampNTZ": "true", "partitionColumn": "FECHA",
        "lowerBound": "2024-01-01", "upperBound": "2026-01-01", "numPartitions": "48",
    }
    assert "partitionColumn" not in jdbc.read_options({"url": "x"}, "gestiones")


def test_write_options():
    found = jdbc.write_options({"url": "x"}, "CONSOLIDADO", connections=16)
    assert found == {"url": "x", "dbtable": "consolidado", "batchsize": "1000", "numPartitions": "16"}


class Recorder:
    """Stands in for a DataFrameReader or DataFrameWriter."""

    def __init__(self, end):
        self.calls, self.end = {}, end

    def format(self, name):
        self.calls["format"] = name
        return self

    def options(self, **values):
        self.calls["options"] = values
        return self

    def mode(self, name):
        self.calls["mode"] = name
        return self

    def load(self):
        return self.end

    def save(self):
        self.end()


def test_read_table_asks_the_connector(raw):
    class Session:
        read = Recorder(raw)

    assert jdbc.read_table(Session, {"url": "x"}, "t") is raw
    assert Session.read.calls == {"format": "jdbc", "options": {"url": "x", "dbtable": "t", "fetchsize": "10000", "preferTimestampNTZ": "true"}}


def test_load_replaces_the_table_and_counts_while_writing(raw, monkeypatch, folder):
    written = {}

    def replace(df, options, table, batch_size, connections):
        df.write.parquet(f"{folder}/{table}")
        written.update(columns=df.columns, options=options, batch=batch_size)

    monkeypatch.setattr("kpiloom.plans.load.replace_table", replace)
    assert load_to_database(raw, {"url": "x"}, "t") == raw.count()
    assert "NUMERO_DE_PEDIDO" in written["columns"] and written["batch"] == 1000


class Database:
    """Stands in for the connection: it knows names of tables, keeps the statements, and fails where told."""

    def __init__(self, monkeypatch, tables, fails=None):
        self.tables, self.log, self.fails = dict(tables), [], fails
        monkeypatch.setattr(jdbc, "Statements", lambda spark, options: self)

    def frame(self, content):
        database = self

        class Writer(Recorder):
            def save(self):
                name = self.calls["options"]["dbtable"]
                database.log.append(f"{self.calls['mode']} {name}")
                database.tables[name] = None  # created, not filled
                if database.fails == "load":
                    raise OSError("connection lost")
                database.tables[name] = content

        class Frame:
            write, sparkSession = Writer(None), None

        return Frame

    def has_table(self, name):
        return name in self.tables

    def run(self, statement):
        self.log.append(statement)
        if self.fails and statement.startswith(self.fails):
            raise OSError("refused")
        words = statement.replace(",", "").split()
        if words[0] == "DROP":
            self.tables.pop(words[-1], None)
        else:  # all names of one statement change together
            moves = list(zip(words[2::3], words[4::3], strict=True))
            moved = {new: self.tables[old] for old, new in moves[:1]}
            left = {k: v for k, v in self.tables.items() if k != moves[0][0]}
            for old, new in moves[1:]:
                moved[new] = left.pop(old)
            self.tables = left | moved

    def close(self):
        self.log.append("close")


def test_replace_swaps_names_once_the_load_is_done(monkeypatch):
    database = Database(monkeypatch, {"consolidado": "old", "other": "x"})
    jdbc.replace_table(database.frame("new"), {"url": "x"}, "CONSOLIDADO")
    assert database.log == [
        "overwrite consolidado__carga",
        "DROP TABLE IF EXISTS consolidado__anterior",
        "RENAME TABLE consolidado TO consolidado__anterior, consolidado__carga TO consolidado",
        "DROP TABLE IF EXISTS consolidado__anterior",
        "close",
    ]
    assert database.tables == {"consolidado": "new", "other": "x"}


def test_the_first_load_takes_the_name(monkeypatch):
    database = Database(monkeypatch, {})
    jdbc.replace_table(database.frame("new"), {"url": "x"}, "t")
    assert database.log == ["overwrite t__carga", "RENAME TABLE t__carga TO t", "close"]
    assert database.tables == {"t": "new"}


@pytest.mark.parametrize("fails", ["load", "RENAME", "DROP"])
def test_an_error_leaves_the_old_table_and_the_next_load_mends(monkeypatch, fails):
    database = Database(monkeypatch, {"t": "old", "t__anterior": "older"}, fails)
    with pytest.raises(OSError):
        jdbc.replace_table(database.frame("new"), {"url": "x"}, "T")
    assert database.tables["t"] == "old"
    assert database.log[-1] == ("close" if fails != "load" else "overwrite t__carga")
    database.fails = None
    jdbc.replace_table(database.frame("newer"), {"url": "x"}, "T")
    assert database.tables == {"t": "newer"}


def hours_of(rows):
    found = rows.groupBy(F.to_date("FECHA").alias("dia"), F.hour("FECHA").alias("hora")).agg(F.count("*").alias("n"))
    return found.where("dia is not null")


@pytest.mark.parametrize("partitions", [1, 4, 16])
def test_ranges_of_skewed_dates_hold_equally_many_rows(spark, monkeypatch, partitions):
    """Half of all rows in one month, a fifth of them on one day; some rows have no time."""
    i = F.col("id")
    minutes = (
        F.when(i % 10 < 2, 400 * 1440 + i * 7 % 1440).when(i % 10 < 5, 390 * 1440 + i * 13 % (30 * 1440)).otherwise(i * 1103 % (1400 * 1440))
    )
    rows = spark.range(20_000).select(
        F.when(i % 500 != 0, F.to_timestamp_ntz(F.lit("2022-01-01")) + F.make_dt_interval(mins=minutes.cast("int"))).alias("FECHA")
    )
    asked = []

    class Reader:
        def format(self, name):
            return self

        def options(self, **values):
            asked.append(values)
            return self

        def load(self):
            return hours_of(rows)

        def jdbc(self, url, table, predicates, properties):
            asked.append((url, table, predicates, properties))
            return rows

    class Session:
        read = Reader()

    predicates = jdbc.equal_ranges(Session, {"url": "x"}, "gestiones", "FECHA", partitions)
    # Counted by the database, not here; and read by these predicates.
    assert asked[0]["dbtable"] == (
        "(SELECT CAST(FECHA AS DATE) AS dia, EXTRACT(HOUR FROM FECHA) AS hora, COUNT(*) AS n FROM gestiones"
        " GROUP BY CAST(FECHA AS DATE), EXTRACT(HOUR FROM FECHA)) horas"
    )
    assert jdbc.read_table(Session, {"url": "x"}, "gestiones", predicates) is rows
    url, table, given, properties = asked[1]
    assert (url, table, given) == ("x", "gestiones", predicates) and properties["preferTimestampNTZ"] == "true"
    counts = rows.agg(*[F.count_if(F.expr(p.replace("TIMESTAMP '", "TIMESTAMP_NTZ '"))) for p in predicates]).first()
    assert len(counts) == partitions and sum(counts) == 20_000  # each row in one range, also those without a time
    assert max(counts) < 2 * min(counts)


def test_a_table_without_times_is_one_range(spark):
    assert jdbc.range_predicates("FECHA", jdbc.cut_points([], 8)) == ["1 = 1"]
    one = [(datetime(2025, 1, 1, 3), 100)]
    assert jdbc.cut_points(one, 8) == []
    hot = [(datetime(2025, 1, 1, h), n) for h, n in enumerate((5, 1000, 5, 5))]
    assert jdbc.cut_points(hot, 3) == [datetime(2025, 1, 1, 1), datetime(2025, 1, 1, 2)]


def test_load_error_reaches_the_caller(raw, monkeypatch):
    def fail(*_):
        raise OSError("database away")

    monkeypatch.setattr("kpiloom.plans.load.replace_table", fail)
    with pytest.raises(OSError, match="away"):
        load_to_database(raw, {"url": "x"}, "t")
