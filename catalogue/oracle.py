"""SQL counterparts of the queries, written for DuckDB on the same tables.

They state each result independently of the engine: no shared helper builds both sides.
"""

from __future__ import annotations

from datetime import date

# --- the model's views ---------------------------------------------------------------

_LINES = """
lines AS (
  SELECT l.l_shipdate AS FECHA, s.s_name AS EJECUTIVO,
         CASE WHEN l.l_linenumber = 7 THEN NULL ELSE CAST(l.l_orderkey AS VARCHAR) END AS NUMERO_DE_PEDIDO,
         CASE l.l_returnflag WHEN 'R' THEN 'Corregido' WHEN 'A' THEN 'Capacidad'
                             WHEN 'N' THEN 'Pendiente' END AS STATUS_REAL,
         r.r_name AS TORRE, l.l_linenumber AS linea
  FROM lineitem l
  JOIN supplier s ON l.l_suppkey = s.s_suppkey
  JOIN nation n ON s.s_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey)"""

_GESTIONES = _LINES + """,
gestiones AS (
  SELECT FECHA, EJECUTIVO, NUMERO_DE_PEDIDO, STATUS_REAL, TORRE, CAST(FECHA AS DATE) AS dia, linea
  FROM lines
  WHERE FECHA IS NOT NULL AND EJECUTIVO IS NOT NULL AND TORRE IS NOT NULL
    AND STATUS_REAL IS NOT NULL AND month(FECHA) >= 8)"""

_EVENTOS = """
eventos AS (
  SELECT ts AS FECHA, CAST(user_id AS VARCHAR) AS EJECUTIVO, CAST(event_id AS VARCHAR) AS NUMERO_DE_PEDIDO,
         CASE event_type WHEN 'purchase' THEN 'Corregido' WHEN 'error' THEN 'Capacidad'
                         ELSE 'Pendiente' END AS STATUS_REAL,
         event_type AS TORRE, CAST(ts AS DATE) AS dia
  FROM events
  WHERE ts IS NOT NULL AND user_id IS NOT NULL AND event_type IS NOT NULL)"""

_EXPORT = _EVENTOS + """,
elegidas AS (
  SELECT * FROM eventos
  WHERE day(FECHA) <= 15
    AND FECHA BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-10 00:00:00')"""

_FIVE = "FECHA, EJECUTIVO, NUMERO_DE_PEDIDO, STATUS_REAL, TORRE"
_ORDERS = "count(NUMERO_DE_PEDIDO)"
_CORRECTED = "count(NUMERO_DE_PEDIDO) FILTER (WHERE STATUS_REAL = 'Corregido')"
_CAPACITY = "count(NUMERO_DE_PEDIDO) FILTER (WHERE STATUS_REAL = 'Capacidad')"
_SEVEN = "(SELECT s_name FROM supplier ORDER BY s_name LIMIT 7)"
_MONTH = (
    "['Enero','Febrero','Marzo','Abril','Mayo','Junio','Julio','Agosto','Septiembre',"
    "'Octubre','Noviembre','Diciembre'][CAST({0} AS INTEGER)]"
)
_SHORT = (
    "['ene','feb','mar','abr','may','jun','jul','ago','sep','oct','nov','dic']"
    "[CAST(month({0}) AS INTEGER)]"
)
_MONDAY = "CAST(date_trunc('week', dia) AS DATE)"
_SUNDAY = "(CAST(date_trunc('week', dia) AS DATE) + 6)"


def _short_day(day: str) -> str:
    return f"strftime({day}, '%d') || ' ' || {_SHORT.format(day)}"


_LABEL = (
    "'Semana ' || weekofyear(dia) || ' (' || "
    f"{_short_day(_MONDAY)} || ' - ' || {_short_day(_SUNDAY)} || ')'"
)


def _over_gestiones(body: str) -> str:
    return f"WITH {_GESTIONES}\n{body}"


def _filtered(condition: str) -> str:
    return _over_gestiones(f"SELECT {_FIVE} FROM gestiones WHERE {condition}")


# --- parametrised shapes -------------------------------------------------------------


def _cards(source: str, rows: str, days: str, handled: str, decimals: int) -> str:
    return f"""WITH {source},
t AS (SELECT {_ORDERS} AS n, count(DISTINCT EJECUTIVO) AS ejecutivos, count(DISTINCT dia) AS dias,
             {_CAPACITY} AS capacidad, {_CORRECTED} AS corregidas
      FROM {rows} HAVING count(*) > 0),
u AS (SELECT *, coalesce(({handled})::DOUBLE / nullif(n, 0), 0.0) AS atendidas,
             coalesce(corregidas::DOUBLE / nullif(n, 0), 0.0) AS resolutividad,
             CAST(trunc(({handled})::DOUBLE / {days} / ejecutivos) AS BIGINT) AS fte_dia
      FROM t)
SELECT *, printf('%.{decimals}f%%', atendidas * 100) AS atendidas_text,
       printf('%.{decimals}f%%', resolutividad * 100) AS resolutividad_text FROM u"""


def _daily(key: str) -> str:
    return _over_gestiones(f"""
SELECT {key}, dia AS Fecha_Dia, n, CAST(sum(n) OVER (PARTITION BY {key}) AS BIGINT) AS total
FROM (SELECT {key}, dia, {_ORDERS} AS n FROM gestiones GROUP BY 1, 2)""")


def _daily_totals(key: str, source: str = _GESTIONES, rows: str = "gestiones", grand: bool = True) -> str:
    sets = f"({key}, dia), ({key})" + (", (dia), ()" if grand else "")
    return f"""WITH {source}
SELECT CASE WHEN GROUPING({key}) = 1 THEN 'Total General' ELSE {key} END AS {key},
       dia AS Fecha_Dia, {_ORDERS} AS n,
       CAST(GROUPING({key}) * 2 + GROUPING(dia) AS BIGINT) AS level
FROM {rows} GROUP BY GROUPING SETS ({sets})"""


def _dense(key: str, resolution: bool = False, rows: str = "true") -> str:
    spine = f"""
a AS (SELECT * FROM gestiones WHERE weekofyear(FECHA) = 35),
w AS (SELECT * FROM a WHERE {rows}),
b AS (SELECT min({_MONDAY}) AS lo, max({_SUNDAY}) AS hi FROM a),
sp AS (SELECT CAST(unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS dia FROM b),
k AS (SELECT {key}, {_ORDERS} AS total FROM w GROUP BY 1),
x AS (SELECT {key}, dia, {_ORDERS} AS n, {_CORRECTED} AS co FROM w GROUP BY 1, 2),
d AS (SELECT k.{key}, sp.dia, coalesce(x.n, 0) AS n, coalesce(x.co, 0) AS co, k.total
      FROM k CROSS JOIN sp LEFT JOIN x ON x.{key} = k.{key} AND x.dia = sp.dia)"""
    if not resolution:
        return f"WITH {_GESTIONES},{spine}\nSELECT {key}, dia AS Fecha_Dia, n, total FROM d"
    return f"""WITH {_GESTIONES},{spine}
SELECT {key}, dia AS Fecha_Dia, co AS corregidas, n, p AS pct,
       printf('%.0f%%', p * 100) AS pct_text, total
FROM (SELECT *, coalesce(co::DOUBLE / nullif(n, 0), 0.0) AS p FROM d)"""


def _resolution(source: str = _GESTIONES, rows: str = "gestiones") -> str:
    return f"""WITH {source}
SELECT EJECUTIVO, dia AS Fecha_Dia, co AS corregidas, n, p AS pct,
       printf('%.0f%%', p * 100) AS pct_text,
       CAST(sum(n) OVER (PARTITION BY EJECUTIVO) AS BIGINT) AS total
FROM (SELECT *, coalesce(co::DOUBLE / nullif(n, 0), 0.0) AS p
      FROM (SELECT EJECUTIVO, dia, {_CORRECTED} AS co, {_ORDERS} AS n FROM {rows} GROUP BY 1, 2))"""


def _share(key: str) -> str:
    return _over_gestiones(f"""
SELECT {key}, n, n::DOUBLE / (SELECT {_ORDERS} FROM gestiones) AS share
FROM (SELECT {key}, {_ORDERS} AS n FROM gestiones GROUP BY 1)""")


def _ranked(columns: str, condition: str) -> str:
    return _over_gestiones(f"""
SELECT {columns} FROM (
  SELECT *, row_number() OVER (ORDER BY resolutividad DESC, EJECUTIVO) AS pos
  FROM (SELECT *, coalesce(corregidas::DOUBLE / nullif(asignadas, 0), 0.0) AS resolutividad
        FROM (SELECT EJECUTIVO, {_CORRECTED} AS corregidas, {_ORDERS} AS asignadas
              FROM gestiones WHERE {condition} GROUP BY 1)))""")


_BEST = f"EJECUTIVO IN {_SEVEN}"
_WEEK_35 = "SELECT * FROM gestiones WHERE weekofyear(FECHA) = 35"

# The days of week 35 of the years 1995 to 2001: a column each, present or not.
_DAYS_35 = [date.fromisocalendar(year, 35, day) for year in range(1995, 2002) for day in range(1, 8)]


def _wide(cell: str) -> str:
    return ",\n".join(f"{cell.format(f'DATE {d.isoformat()!r}')} AS \"{d:%d-%m-%Y}\"" for d in _DAYS_35)


_DAILY_WIDE = f"""WITH {_GESTIONES}, w AS ({_WEEK_35})
SELECT CASE WHEN GROUPING(TORRE) = 1 THEN 'Total General' ELSE TORRE END AS TORRE,
{_wide("count(NUMERO_DE_PEDIDO) FILTER (WHERE dia = {})")},
{_ORDERS} AS total, CAST(GROUPING(TORRE) AS BIGINT) AS level
FROM w GROUP BY GROUPING SETS ((TORRE), ()) HAVING count(*) > 0"""

_SHARE_OF_DAY = (
    "printf('%.0f%%', 100 * coalesce((count(NUMERO_DE_PEDIDO) FILTER (WHERE dia = {0} AND STATUS_REAL = 'Corregido'))::DOUBLE"
    " / nullif(count(NUMERO_DE_PEDIDO) FILTER (WHERE dia = {0}), 0), 0.0))"
)
_RESOLUTION_WIDE = f"""WITH {_GESTIONES}, w AS ({_WEEK_35})
SELECT EJECUTIVO,
{_wide(_SHARE_OF_DAY)},
{_ORDERS} AS total FROM w GROUP BY 1"""


def _dense_totals(key: str) -> str:
    return f"""WITH {_GESTIONES},
w AS (SELECT * FROM gestiones WHERE weekofyear(FECHA) = 35),
b AS (SELECT min({_MONDAY}) AS lo, max({_SUNDAY}) AS hi FROM w),
sp AS (SELECT CAST(unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS dia FROM b),
k AS (SELECT {key} AS k, CAST(0 AS BIGINT) AS level FROM w GROUP BY 1 UNION ALL SELECT 'Total General', 2 FROM w GROUP BY 2),
x AS (SELECT CASE WHEN GROUPING({key}) = 1 THEN 'Total General' ELSE {key} END AS k, dia, {_ORDERS} AS n,
             CAST(GROUPING({key}) * 2 AS BIGINT) AS level
      FROM w GROUP BY GROUPING SETS (({key}, dia), (dia)))
SELECT k.k AS {key}, sp.dia AS Fecha_Dia, coalesce(x.n, 0) AS n, k.level
FROM k CROSS JOIN sp LEFT JOIN x ON x.k = k.k AND x.level = k.level AND x.dia = sp.dia
UNION ALL
SELECT CASE WHEN GROUPING({key}) = 1 THEN 'Total General' ELSE {key} END, NULL, {_ORDERS},
       CAST(GROUPING({key}) * 2 + 1 AS BIGINT)
FROM w GROUP BY GROUPING SETS (({key}), ())"""


_MONTHLY_WIDE = _over_gestiones(
    "SELECT CASE WHEN GROUPING(EJECUTIVO) = 1 THEN TORRE ELSE '     ' || EJECUTIVO END AS etiqueta,\n"
    "CASE WHEN GROUPING(EJECUTIVO) = 1 THEN 'Torre' ELSE 'Ejecutivo' END AS tipo,\n"
    + ",\n".join(
        f"count(NUMERO_DE_PEDIDO) FILTER (WHERE month(FECHA) = {number}) AS \"{name}\""
        for number, name in ((8, "Agosto"), (9, "Septiembre"), (10, "Octubre"), (11, "Noviembre"), (12, "Diciembre"))
    )
    + f",\n{_ORDERS} AS total, TORRE, EJECUTIVO, any_value(torre_total) AS torre_total\n"
    f"FROM gestiones JOIN (SELECT TORRE, {_ORDERS} AS torre_total FROM gestiones GROUP BY 1) USING (TORRE)\n"
    "GROUP BY GROUPING SETS ((TORRE, EJECUTIVO), (TORRE))"
)

_BLANKS = r"[\s\x0b\x{85}\x{1c}-\x{1f}\p{Z}]+"


def _strip(value: str) -> str:
    return f"regexp_replace({value}, '^{_BLANKS}|{_BLANKS}$', '', 'g')"


_CLEAN_GESTIONES = f"""WITH {_LINES},
padded AS (
  SELECT FECHA, NUMERO_DE_PEDIDO,
         CASE WHEN linea = 2 THEN '   ' ELSE ' ' || chr(9) || chr(160) || EJECUTIVO || chr(8195) || ' ' END AS EJECUTIVO,
         CASE WHEN linea <> 4 THEN chr(10) || TORRE || ' ' END AS TORRE,
         CASE WHEN linea = 5 THEN ' ' ELSE STATUS_REAL || chr(12288) END AS STATUS_REAL
  FROM lines)
SELECT * FROM (
  SELECT FECHA, {_strip('EJECUTIVO')} AS EJECUTIVO, NUMERO_DE_PEDIDO,
         {_strip('STATUS_REAL')} AS STATUS_REAL, {_strip('TORRE')} AS TORRE
  FROM padded
  WHERE FECHA IS NOT NULL AND EJECUTIVO IS NOT NULL AND TORRE IS NOT NULL AND STATUS_REAL IS NOT NULL)
WHERE EJECUTIVO <> '' AND TORRE <> '' AND month(FECHA) >= 8"""

_BUCKET = f"""WITH {_EVENTOS}
SELECT {{0}} AS inicio, TORRE, {_ORDERS} AS n FROM eventos GROUP BY 1, 2"""

ORACLE: dict[str, str] = {
    "scan_gestiones": f"WITH {_LINES}\nSELECT {_FIVE} FROM lines",
    "normalise_columns": f"WITH {_LINES}\nSELECT {_FIVE} FROM lines",
    "clean_dates": f"""WITH {_LINES}
SELECT NUMERO_DE_PEDIDO, try_strptime(
  CASE linea WHEN 3 THEN 'no-date' WHEN 5 THEN strftime(FECHA, '%d/%m/%Y')
             ELSE strftime(FECHA, '%Y-%m-%d %H:%M:%S') END, '%Y-%m-%d %H:%M:%S') AS FECHA
FROM lines""",
    "clean_dates_detected": f"""WITH {_LINES}
SELECT NUMERO_DE_PEDIDO, CASE WHEN linea NOT IN (3, 5) THEN CASE linea WHEN 6 THEN date_trunc('day', FECHA) ELSE FECHA END END AS FECHA
FROM lines""",
    "date_format_votes": f"""WITH {_LINES},
t AS (SELECT linea % 2 = 1 AS a, linea % 2 = 0 AND linea % 3 = 1 AS b, day(FECHA) <= 12 AS low FROM lines)
SELECT CAST(0 AS BIGINT) AS iso, count(*) FILTER (WHERE a OR (b AND low)) AS mes_dia,
       count(*) FILTER (WHERE b OR (a AND low)) AS dia_mes,
       count(*) FILTER (WHERE NOT a AND NOT b) AS puntos
FROM t""",
    "clean_gestiones": _CLEAN_GESTIONES,
    "filter_allow_list": _filtered(f"EJECUTIVO IN {_SEVEN}"),
    "filter_allow_list_table": _filtered(
        "EJECUTIVO IN (SELECT EJECUTIVO FROM gestiones WHERE STATUS_REAL = 'Corregido' AND month(FECHA) = 12)"
    ),
    "calendar_columns": _over_gestiones(f"""
SELECT DISTINCT dia AS Fecha_Dia, {_MONTH.format('month(dia)')} AS Mes, isoyear(dia) AS Year,
       weekofyear(dia) AS Semana_Num, {_MONDAY} AS WeekStartDate, {_SUNDAY} AS WeekEndDate,
       {_LABEL} AS WeekLabel
FROM gestiones"""),
    "format_percent": _over_gestiones(f"""
SELECT DISTINCT a, b, printf('%.0f%%', r * 100) AS text_0, printf('%.2f%%', r * 100) AS text_2
FROM (SELECT p.n AS a, t.n AS b, coalesce(p.n::DOUBLE / nullif(t.n, 0), 0.0) AS r
      FROM (SELECT EJECUTIVO, dia, STATUS_REAL, {_ORDERS} AS n FROM gestiones GROUP BY 1, 2, 3) p
      JOIN (SELECT EJECUTIVO, dia, {_ORDERS} AS n FROM gestiones GROUP BY 1, 2) t USING (EJECUTIVO, dia))"""),
    "filter_month": _filtered("month(FECHA) IN (8, 12)"),
    "filter_fortnight": _filtered("day(FECHA) <= 15"),
    "filter_fortnight_second": _filtered("day(FECHA) > 15"),
    "filter_week": _filtered("weekofyear(FECHA) IN (35, 36)"),
    "filter_tower": _filtered("TORRE IN ('ASIA', 'EUROPE')"),
    "filter_executive": _filtered("EJECUTIVO IN (SELECT s_name FROM supplier ORDER BY s_name LIMIT 3)"),
    "filter_combined": _filtered(
        "month(FECHA) IN (8, 12) AND day(FECHA) <= 15 AND TORRE IN ('ASIA', 'EUROPE')"
    ),
    "filter_date_range": f"""WITH {_EVENTOS}
SELECT {_FIVE} FROM eventos
WHERE FECHA BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-10 00:00:00'""",
    "base_cuboid": _over_gestiones(f"""
SELECT TORRE, EJECUTIVO, STATUS_REAL, dia AS Fecha_Dia, {_ORDERS} AS n, count(*) AS filas
FROM gestiones GROUP BY 1, 2, 3, 4"""),
    "count_by_tower": _over_gestiones(f"SELECT TORRE, {_ORDERS} AS n FROM gestiones GROUP BY 1"),
    "count_by_executive": _over_gestiones(f"SELECT EJECUTIVO, {_ORDERS} AS n FROM gestiones GROUP BY 1"),
    "status_mix_by_executive": _over_gestiones(f"""
SELECT EJECUTIVO, STATUS_REAL, n, exec_order
FROM (SELECT EJECUTIVO, STATUS_REAL, {_ORDERS} AS n FROM gestiones GROUP BY 1, 2)
JOIN (SELECT EJECUTIVO, row_number() OVER (ORDER BY {_ORDERS} DESC, EJECUTIVO) AS exec_order
      FROM gestiones GROUP BY 1) USING (EJECUTIVO)"""),
    "kpi_cards": _cards(_EVENTOS, "eventos", "dias", "n - capacidad", 2),
    "kpi_cards_workbook": _cards(_EVENTOS, "eventos", "6", "n - capacidad", 0),
    "kpi_cards_v1": _cards(_EVENTOS, "eventos", "6", "n", 0),
    "kpi_cards_filtered": _cards(
        _GESTIONES,
        "(SELECT * FROM gestiones WHERE month(FECHA) IN (8, 12) AND day(FECHA) <= 15"
        " AND TORRE IN ('ASIA', 'EUROPE'))",
        "dias",
        "n - capacidad",
        2,
    ),
    "kpi_cards_stored": _cards(_GESTIONES, "gestiones", "dias", "n - capacidad", 2),
    "kpi_cards_stored_filtered": _cards(
        _GESTIONES,
        "(SELECT * FROM gestiones WHERE month(FECHA) IN (8, 12) AND day(FECHA) <= 15"
        " AND TORRE IN ('ASIA', 'EUROPE'))",
        "dias",
        "n - capacidad",
        2,
    ),
    "kpi_cards_stored_week": _cards(
        _GESTIONES,
        "(SELECT * FROM gestiones WHERE weekofyear(FECHA) IN (35, 40) AND year(FECHA) IN (1996, 1998))",
        "dias",
        "n - capacidad",
        2,
    ),
    "kpi_cards_stored_executives": _cards(
        _GESTIONES,
        "(SELECT * FROM gestiones WHERE day(FECHA) > 15"
        " AND EJECUTIVO IN (SELECT s_name FROM supplier ORDER BY s_name LIMIT 3))",
        "dias",
        "n - capacidad",
        2,
    ),
    "snapshot_reload": f"""WITH {_GESTIONES}
SELECT CAST(year(FECHA) * 100 + month(FECHA) AS INTEGER) AS mes, count(*) AS filas, {_ORDERS} AS n,
       CAST(CASE WHEN year(any_value(FECHA)) = 1996 AND month(any_value(FECHA)) = 10 THEN 1 ELSE 0 END AS BIGINT) AS version
FROM gestiones WHERE NOT (linea = 3 AND year(FECHA) = 1996 AND month(FECHA) = 10) GROUP BY 1""",
    "deliveries_add_up": f"""WITH {_EVENTOS}
SELECT TORRE, EJECUTIVO, STATUS_REAL, dia AS Fecha_Dia, {_ORDERS} AS n, count(*) AS filas
FROM eventos GROUP BY 1, 2, 3, 4""",
    "daily_count_by_tower": _daily("TORRE"),
    "daily_count_by_status": _daily("STATUS_REAL"),
    "daily_count_by_executive": _daily("EJECUTIVO"),
    "daily_totals_by_tower": _daily_totals("TORRE"),
    "daily_totals_by_status": _daily_totals("STATUS_REAL"),
    "daily_totals_by_executive": _daily_totals("EJECUTIVO"),
    "daily_totals_by_tower_workbook": _daily_totals("TORRE", grand=False),
    "daily_wide_by_tower": _DAILY_WIDE,
    "daily_wide_of_days_found": _over_gestiones(f"""
, d AS (SELECT DISTINCT dia FROM gestiones),
k AS (SELECT CASE WHEN GROUPING(TORRE) = 1 THEN 'Total General' ELSE TORRE END AS TORRE, {_ORDERS} AS total,
             CAST(GROUPING(TORRE) AS BIGINT) AS level FROM gestiones GROUP BY GROUPING SETS ((TORRE), ())),
c AS (SELECT CASE WHEN GROUPING(TORRE) = 1 THEN 'Total General' ELSE TORRE END AS TORRE, dia, {_ORDERS} AS n,
             CAST(GROUPING(TORRE) AS BIGINT) AS level FROM gestiones GROUP BY GROUPING SETS ((TORRE, dia), (dia)))
SELECT k.TORRE, k.total, k.level, strftime(d.dia, '%d-%m-%Y') AS dia, coalesce(c.n, 0) AS n
FROM k CROSS JOIN d LEFT JOIN c ON c.TORRE = k.TORRE AND c.level = k.level AND c.dia = d.dia"""),
    "daily_dense_by_tower": _dense("TORRE"),
    "daily_dense_by_status": _dense("STATUS_REAL"),
    "daily_dense_by_executive": _dense("EJECUTIVO"),
    "daily_dense_totals_by_tower": _dense_totals("TORRE"),
    "daily_dense_totals_by_status": _dense_totals("STATUS_REAL"),
    "daily_dense_totals_by_executive": _dense_totals("EJECUTIVO"),
    "daily_dense_span_of_all": _dense("EJECUTIVO", rows="TORRE IN ('ASIA', 'EUROPE')"),
    "daily_resolution_by_executive": _resolution(),
    "daily_resolution_dense": _dense("EJECUTIVO", resolution=True),
    "daily_resolution_wide": _RESOLUTION_WIDE,
    "monthly_count": _over_gestiones(f"""
SELECT TORRE, EJECUTIVO, {_MONTH.format('mes_num')} AS Mes, n
FROM (SELECT TORRE, EJECUTIVO, month(FECHA) AS mes_num, {_ORDERS} AS n FROM gestiones GROUP BY 1, 2, 3)"""),
    "monthly_report": _over_gestiones(f"""
SELECT TORRE, EJECUTIVO, mes_num, {_MONTH.format('mes_num')} AS Mes, n, level, torre_total
FROM (SELECT TORRE, EJECUTIVO, month(FECHA) AS mes_num, {_ORDERS} AS n,
             CAST(GROUPING(EJECUTIVO) * 2 + GROUPING(month(FECHA)) AS BIGINT) AS level
      FROM gestiones GROUP BY GROUPING SETS
        ((TORRE, EJECUTIVO, month(FECHA)), (TORRE, EJECUTIVO), (TORRE, month(FECHA)), (TORRE)))
JOIN (SELECT TORRE, {_ORDERS} AS torre_total FROM gestiones GROUP BY 1) USING (TORRE)"""),
    "monthly_wide": _MONTHLY_WIDE,
    "monthly_labels": _over_gestiones("SELECT DISTINCT '     ' || EJECUTIVO AS etiqueta FROM gestiones"),
    "share_by_tower": _share("TORRE"),
    "share_by_executive": _share("EJECUTIVO"),
    "chart_resolution_rate": _over_gestiones(f"""
SELECT EJECUTIVO, coalesce(co::DOUBLE / nullif(n, 0), 0.0) * 100 AS rate
FROM (SELECT EJECUTIVO, {_CORRECTED} AS co, {_ORDERS} AS n FROM gestiones GROUP BY 1)"""),
    "ranking_resolution": _ranked(
        """pos, EJECUTIVO, resolutividad, printf('%.2f%%', resolutividad * 100) AS text,
       CASE pos WHEN 1 THEN 'success' WHEN 2 THEN 'info' WHEN 3 THEN 'primary' ELSE 'secondary' END AS tier,
       CASE pos WHEN 1 THEN 'trophy' WHEN 2 THEN 'award' ELSE 'star' END AS icon""",
        _BEST,
    ),
    "ranking_quantity": _ranked(
        """pos, EJECUTIVO, corregidas, asignadas, resolutividad AS pct,
       printf('%.2f%%', resolutividad * 100) AS text""",
        _BEST,
    ),
    "ranking_everyone": _ranked("pos, EJECUTIVO, corregidas, asignadas, resolutividad", "true"),
    "ranking_export": _ranked("pos, EJECUTIVO, printf('%.2f%%', resolutividad * 100) AS text", _BEST),
    "options_month": _over_gestiones(f"""
SELECT DISTINCT {_MONTH.format('month(FECHA)')} AS value, month(FECHA) AS orden FROM gestiones"""),
    "options_month_v1": _over_gestiones(f"""
SELECT {_MONTH.format('month(FECHA)')} AS value, min(dia) AS orden FROM gestiones GROUP BY 1"""),
    "options_week": _over_gestiones(f"SELECT DISTINCT weekofyear(dia) AS value, {_LABEL} AS label FROM gestiones"),
    "options_week_v1": _over_gestiones(
        "SELECT DISTINCT weekofyear(dia) AS value, 'Semana ' || weekofyear(dia) AS label FROM gestiones"
    ),
    "options_tower": _over_gestiones("SELECT DISTINCT TORRE AS value FROM gestiones"),
    "options_executive": _over_gestiones("SELECT DISTINCT EJECUTIVO AS value FROM gestiones"),
    "date_bounds": _over_gestiones("SELECT min(dia) AS min_fecha, max(dia) AS max_fecha FROM gestiones"),
    "export_detail": f"""WITH {_EXPORT}
SELECT dia AS FECHA, EJECUTIVO, NUMERO_DE_PEDIDO, STATUS_REAL, TORRE,
       {_MONTH.format('month(dia)')} AS Mes
FROM elegidas""",
    "export_passthrough": f"""WITH {_EXPORT}
SELECT dia AS FECHA, EJECUTIVO, NUMERO_DE_PEDIDO, STATUS_REAL, TORRE, 'm' || day(FECHA) AS MES,
       'a' || year(FECHA) AS ANIO, {_MONTH.format('month(dia)')} AS " Mes"
FROM elegidas""",
    "export_daily_counts": _daily_totals("EJECUTIVO", _EXPORT, "elegidas"),
    "export_daily_resolution": _resolution(_EXPORT, "elegidas"),
    "export_row_count": f"WITH {_EXPORT}\nSELECT count(*) AS n FROM elegidas",
    "preview_detail": _over_gestiones(f"""
SELECT {_FIVE}, {_MONTH.format('month(FECHA)')} AS Mes FROM gestiones
ORDER BY FECHA, NUMERO_DE_PEDIDO NULLS FIRST, EJECUTIVO, TORRE, STATUS_REAL LIMIT 10"""),
    "events_tumbling_day": _BUCKET.format("dia"),
    "events_tumbling_week": _BUCKET.format(_MONDAY),
    "events_tumbling_fortnight": _BUCKET.format(
        "CASE WHEN day(dia) <= 15 THEN CAST(date_trunc('month', dia) AS DATE)"
        " ELSE CAST(date_trunc('month', dia) AS DATE) + 15 END"
    ),
    "events_tumbling_month": _BUCKET.format("CAST(date_trunc('month', dia) AS DATE)"),
}
