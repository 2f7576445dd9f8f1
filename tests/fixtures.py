"""The golden fixture: thirteen invented deliveries and what must come of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

HEADERS = ["Fecha", "Ejecutivo", "Torre", "Status Real", "Número de pedido"]

G1 = [
    ("2025-08-04 09:00", " Ana ", "T1", "Corregido", "P1"),
    ("2025-08-04 10:00", "Ana", "T1", "Capacidad", "P2"),
    ("2025-08-05 11:00", "Ana", "T2", "Pendiente", "P3"),
    ("2025-08-18 12:00", "Beto", "T1", "Pendiente", "P4"),
    ("2025-09-01 00:00", "Beto", "T1", "Corregido", None),
    ("2025-09-01 15:30", "Beto", "T1", "Corregido", "P4"),
    ("2025-12-31 08:00", "Caro", "T2", "Pendiente", "P6"),
    ("2024-08-05 08:00", "Caro", "T2", "Corregido", "P7"),
    ("2025-07-31 23:59", "Ana", "T1", "Corregido", "P8"),
    ("no-date", "Ana", "T1", "Corregido", "P9"),
    ("2025-08-06 00:00", "   ", "T1", "Corregido", "P10"),
    ("2025-08-06 00:00", "Ana", None, "Corregido", "P11"),
    ("2025-08-07 00:00", "Ana", "T2", "", "P12"),
]

NAMES = ("Ana", "Beto", "Caro")


def g1_raw(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(G1, ", ".join(f"`{h}` string" for h in HEADERS))


def rows(frame: DataFrame, *columns: str) -> set[tuple]:
    found = [tuple(r) for r in frame.select(*columns).collect()]
    assert len(found) == len(set(found))
    return set(found)
